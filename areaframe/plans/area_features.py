"""The area table in its final form: one complete row of 20 columns per area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    bucketize,
    parse_number,
    ratio,
    round_half_even,
    strip_prefix,
    zero_fill,
)
from ..operators.accounts import Accounts, NoAccounts
from ..operators.filters import keep_matching
from ..operators.gather import Part, assemble_parts, mean_of, present, total_of
from ..operators.joins import Branch, assemble
from ..operators.projection import percent_to_share, select_columns
from .common import (
    KEY,
    Sources,
    energy_of_year,
    keyed,
    keyed_parcels,
    open_greenstreets,
    parcel_cells,
    spine,
)

# Income thresholds and the form of a census area name.
INCOME_EDGES = (50_000, 100_000, 150_000)
AREA_PREFIX = "ZCTA5 "
AREA_NAME = r"^ZCTA5 [0-9]+$"

# The output columns in order.
AREA_COLUMNS = (
    "zipcode",
    "borough",
    "neighborhood",
    "population",
    "average_building_area",
    "res_units_per_capita",
    "mean_energy_star_score_50k_building",
    "electricity_onsite_renew_per_50k_building",
    "green_power_onsite_per_50k_building",
    "nat_gas_onsite_per_50k_building",
    "num_trees",
    "total_acres_greenstreets",
    "num_community_gardens",
    "white_percent",
    "black_percent",
    "poverty_percent",
    "college_percent",
    "jail_admissions_per_100k",
    "income_group",
    "hvi",
)


def greenstreet_part(sources: Sources, accounts: Accounts) -> Part:
    return Part(
        keyed(open_greenstreets(sources, accounts)),
        sums={"acres": F.col("acres")},
        measures={"total_acres_greenstreets": total_of("acres")},
        fill={"total_acres_greenstreets": 0.0},
    )


def energy_part(sources: Sources, year: int, accounts: Accounts) -> Part:
    """Rows that lack a field are dropped before the year is looked at. A field
    that is there but holds no number counts as a building all the same."""
    needed = ["year", "postal_code", "score", "electricity", "green_power", "natural_gas"]
    complete = accounts.keep_complete(select_columns(sources["energy"], needed), "incomplete buildings")
    buildings = energy_of_year(complete, year)
    numbers = {f"{c}_sum": parse_number(c) for c in needed[2:]}

    def per_building(name: str) -> Column:
        return ratio(total_of(name), "energy_rows")

    return Part(
        buildings,
        sums={**numbers, "score_count": present(parse_number("score")), "energy_rows": F.lit(1)},
        measures={
            "mean_energy_star_score_50k_building": mean_of("score_sum", "score_count"),
            "electricity_onsite_renew_per_50k_building": per_building("electricity_sum"),
            "green_power_onsite_per_50k_building": per_building("green_power_sum"),
            "nat_gas_onsite_per_50k_building": per_building("natural_gas_sum"),
        },
    )


def parcel_part(sources: Sources, distinct_gardens: bool) -> Part:
    """Lots and the gardens on their blocks, from one read of the lots."""
    totals = {"numbldgs": "buildings", "unitsres": "units", "bldgarea": "area"}
    cells = parcel_cells(
        keyed_parcels(sources["parcels"]), sources["gardens"], ("borough",), tuple(totals), distinct_gardens,
        most=sources["parcels"].count(),
    )
    return Part(
        cells,
        sums={**{f"{c}_sum": F.col(c) for c in totals}, "gardens": F.col("_gardens")},
        modes={"borough_mode": "borough"},
        weight=F.col("_lots"),
        measures={
            "borough": F.col("borough_mode"),
            **{name: total_of(f"{c}_sum") for c, name in totals.items()},
            "num_community_gardens": total_of("gardens"),
        },
        fill={"num_community_gardens": 0},
    )


def tree_part(sources: Sources) -> Part:
    """Living trees; the neighbourhood goes by all trees."""
    return Part(
        keyed(sources["trees"], "postcode"),
        sums={"alive": F.col("status").eqNullSafe("Alive").cast("bigint")},
        modes={"nta_mode": "nta_name"},
        measures={"neighborhood": F.col("nta_mode"), "num_trees": total_of("alive")},
        fill={"num_trees": 0},
    )


def college_shares(sources: Sources) -> DataFrame:
    shares = keyed(sources["college"])
    return shares.withColumn("college_percent", percent_to_share("college_percent"))


def justice_shares(sources: Sources) -> DataFrame:
    measures = ("white_percent", "black_percent", "jail_admissions_per_100k")
    return keyed(sources["justice"]).withColumns({name: parse_number(name) for name in measures})


def poverty_shares(sources: Sources, infinite: bool) -> DataFrame:
    """Counts must be whole numbers here; other text stops the job."""
    areas = keep_matching(sources["poverty"], "name", AREA_NAME)
    share = ratio(F.col("estimate").cast("bigint"), F.col("total").cast("bigint"), infinite)
    return areas.select(
        zero_fill(strip_prefix("name", AREA_PREFIX)).alias(KEY),
        round_half_even(share, 4).alias("poverty_percent"),
    )


def area_features(
    sources: Sources,
    year: int = 2022,
    distinct_gardens: bool = False,
    infinite_ratios: bool = False,
    accounts: Accounts = NoAccounts(),
) -> DataFrame:
    """Final area table. Over a zero denominator a ratio is missing, so the area
    is dropped; ``infinite_ratios`` makes it infinite, so the area stays. ``accounts``
    gets what each step drops once the table has been run."""
    counted = assemble_parts(
        spine(sources),
        KEY,
        [
            greenstreet_part(sources, accounts),
            energy_part(sources, year, accounts),
            parcel_part(sources, distinct_gardens),
            tree_part(sources),
        ],
    )
    wide = assemble(
        counted,
        KEY,
        [
            Branch(college_shares(sources)),
            Branch(justice_shares(sources)),
            Branch(poverty_shares(sources, infinite_ratios)),
        ],
    )
    full = wide.withColumns(
        {
            "income_group": bucketize("median_income", INCOME_EDGES),
            "res_units_per_capita": ratio("units", "population", infinite_ratios),
            "average_building_area": ratio("area", "buildings", infinite_ratios),
        }
    )
    return accounts.keep_complete(select_columns(full, AREA_COLUMNS), "incomplete areas")
