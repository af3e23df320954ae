"""Declared schemas. Nothing is inferred: keys and dirty numbers are text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TEXT, REAL, WHOLE, SMALL = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def columns(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


@dataclass(frozen=True)
class SourceSpec:
    """Where a source lies, how its columns are spelled there, what we call them.

    ``spelled`` maps our names to the header's names. Without it the file is read
    by position and must have exactly the declared columns.
    """

    file: str
    schema: T.StructType
    spelled: dict[str, str] | None = None


# File names and header spellings of the published sources.
SOURCES = {
    "income": SourceSpec(
        "median_individual_income_2023.csv",
        columns(zipcode=TEXT, median_income=REAL),
        {"zipcode": "Entity properties name", "median_income": "Variable observation value"},
    ),
    "population": SourceSpec(
        "population_2023.csv",
        columns(zipcode=TEXT, population=WHOLE),
        {"zipcode": "Entity properties name", "population": "Variable observation value"},
    ),
    "heat_index": SourceSpec(
        "heat_vulnerability_index_rankings_2020.csv",
        columns(zipcode=TEXT, hvi=SMALL),
        {
            "zipcode": "ZIP Code Tabulation Area (ZCTA) 2020",
            "hvi": "Heat Vulnerability Index (HVI)",
        },
    ),
    "greenstreets": SourceSpec(
        "greenstreets_2022.csv",
        columns(status=TEXT, zipcode=TEXT, acres=REAL),
        {"status": "FEATURESTATUS", "zipcode": "ZIPCODE", "acres": "ACRES"},
    ),
    "energy": SourceSpec(
        "ll84_2022_present.csv",
        columns(
            year=SMALL,
            postal_code=TEXT,
            score=TEXT,
            target_score=TEXT,
            electricity=TEXT,
            green_power=TEXT,
            natural_gas=TEXT,
        ),
        {
            "year": "Calendar Year",
            "postal_code": "Postal Code",
            "score": "ENERGY STAR Score",
            "target_score": "Target ENERGY STAR Score",
            "electricity": "Electricity Use – Generated from Onsite Renewable Systems (kWh)",
            "green_power": "Green Power - Onsite (kWh)",
            "natural_gas": "Natural Gas - Weather Normalized Site Natural Gas Use (therms)",
        },
    ),
    "parcels": SourceSpec(
        "pluto_2020.csv",
        columns(
            postcode=REAL,
            block=TEXT,
            borough=TEXT,
            landuse=TEXT,
            numbldgs=REAL,
            unitsres=REAL,
            unitstotal=REAL,
            bldgarea=REAL,
        ),
        {
            "postcode": "postcode",
            "block": "Tax block",
            "borough": "borough",
            "landuse": "landuse",
            "numbldgs": "numbldgs",
            "unitsres": "unitsres",
            "unitstotal": "unitstotal",
            "bldgarea": "bldgarea",
        },
    ),
    "gardens": SourceSpec(
        "greenthumb_community_gardens_2020.csv", columns(block=TEXT), {"block": "block"}
    ),
    "trees": SourceSpec(
        "street_tree_census_2015.csv",
        columns(tree_id=TEXT, status=TEXT, health=TEXT, postcode=TEXT, nta_name=TEXT),
        {
            "tree_id": "tree_id",
            "status": "status",
            "health": "health",
            "postcode": "postcode",
            "nta_name": "nta_name",
        },
    ),
    "college": SourceSpec(
        "college_percentages_2021.csv", columns(zipcode=TEXT, college_percent=REAL)
    ),
    "justice": SourceSpec(
        "justice_percentages_2021.csv",
        columns(
            zipcode=TEXT, white_percent=TEXT, black_percent=TEXT, jail_admissions_per_100k=TEXT
        ),
    ),
    "poverty": SourceSpec(
        "poverty_2020.csv",
        columns(name=TEXT, estimate=TEXT, total=TEXT),
        {"name": "NAME", "estimate": "S1701_C01_002E", "total": "S1701_C01_001E"},
    ),
}

# Where the tree census keeps the columns the health profile needs.
TREE_POSITIONS = (0, 6, 7, 25)
TREE_COLUMNS = ("tree_id", "status", "health", "postcode")
