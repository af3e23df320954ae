"""The area table in model form: every area kept, gaps filled, categories coded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code_from_text, encode, parse_number, ratio
from ..operators.accounts import Accounts, NoAccounts
from ..operators.aggregates import histogram
from ..operators.filters import exclude_containing, exclude_values
from ..operators.gather import Part, assemble_parts, mean_of, present, total_of
from ..operators.projection import select_columns
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
from .tree_health import GOOD, kept_trees

# Land use codes to groups, group names, borough codes.
LAND_USE_GROUPS = {
    "01": 1,
    "02": 1,
    "03": 1,
    "04": 2,
    "05": 2,
    "06": 3,
    "07": 3,
    "08": 3,
    "10": 4,
    "11": 4,
}
LAND_USE_LABELS = {1: "Residential", 2: "Commercial", 3: "Industrial", 4: "Undeveloped"}
IGNORED_LAND_USE = "09"
BOROUGH_CODES = {"MN": 0, "SI": 1, "BX": 2, "QN": 3, "BK": 4}

# The output columns in order.
MODEL_COLUMNS = (
    "zipcode",
    "median_income",
    "population",
    "hvi",
    "num_greenstreets",
    "total_acres_greenstreets",
    "mean_energy_star_score_50k",
    "mean_gap_energy_star_score_50k",
    "electricity_onsite_renew_50k",
    "most_common_landuse_code",
    "total_units",
    "total_building_areas",
    "borough",
    "num_community_gardens",
    "num_trees",
    "proportion_healthy_trees",
)


def greenstreet_part(sources: Sources, accounts: Accounts) -> Part:
    """Streets that name a single area."""
    single = accounts.through(
        open_greenstreets(sources, accounts), "greenstreets of several areas",
        lambda streets: exclude_containing(streets, "zipcode", ","), ["zipcode"],
    )
    return Part(
        keyed(single),
        sums={"streets": F.lit(1), "acres": F.col("acres")},
        measures={"num_greenstreets": F.col("streets"), "total_acres_greenstreets": total_of("acres")},
        fill={"num_greenstreets": 0, "total_acres_greenstreets": 0.0},
    )


def energy_part(sources: Sources, year: int) -> Part:
    score, target = parse_number("score"), parse_number("target_score")
    gap = target - score
    measures = {
        "mean_energy_star_score_50k": mean_of("score_sum", "score_count"),
        "mean_gap_energy_star_score_50k": mean_of("gap_sum", "gap_count"),
        "electricity_onsite_renew_50k": total_of("electricity_sum"),
        "green_power_onsite_50k": total_of("green_power_sum"),
    }
    return Part(
        energy_of_year(sources["energy"], year),
        sums={
            "score_sum": score, "score_count": present(score), "gap_sum": gap, "gap_count": present(gap),
            "electricity_sum": parse_number("electricity"), "green_power_sum": parse_number("green_power"),
        },
        measures=measures,
        fill={name: 0.0 for name in measures},
    )


def used_parcels(sources: Sources, accounts: Accounts) -> DataFrame:
    """Lots with a land use, in one spelling of its code, without the ignored one."""
    known = accounts.keep_complete(sources["parcels"], "lots without land use", ["landuse"])
    lots = accounts.through(
        known.withColumn("landuse", code_from_text("landuse", 2)), "lots of ignored land use",
        lambda lots: exclude_values(lots, "landuse", IGNORED_LAND_USE),
    )
    return keyed_parcels(lots)


def parcel_part(sources: Sources, distinct_gardens: bool, accounts: Accounts) -> Part:
    """Lots and the gardens on their blocks, from one read of the lots."""
    totals = {"unitstotal": "total_units", "bldgarea": "total_building_areas"}
    cells = parcel_cells(
        used_parcels(sources, accounts), sources["gardens"], ("landuse", "borough"), tuple(totals), distinct_gardens,
        most=sources["parcels"].count(),
    )
    return Part(
        cells,
        sums={**{f"{c}_sum": F.col(c) for c in totals}, "gardens": F.col("_gardens")},
        modes={"landuse_mode": "landuse", "borough_mode": "borough"},
        weight=F.col("_lots"),
        measures={
            "most_common_landuse_code": encode("landuse_mode", LAND_USE_GROUPS),
            "borough": encode("borough_mode", BOROUGH_CODES),
            **{name: total_of(f"{c}_sum") for c, name in totals.items()},
            "num_community_gardens": total_of("gardens"),
        },
        fill={"total_units": 0.0, "total_building_areas": 0.0, "num_community_gardens": 0},
    )


def tree_part(sources: Sources, accounts: Accounts) -> Part:
    trees = accounts.through(sources["trees"], "trees that contradict themselves", kept_trees, ["health", "status"])
    return Part(
        keyed(trees, "postcode"),
        sums={
            "trees": F.lit(1),
            "good": (F.col("health") == GOOD).cast("bigint"),
            "judged": present(F.col("health")),
        },
        measures={"num_trees": F.col("trees"), "proportion_healthy_trees": ratio("good", "judged")},
    )


def model_features(
    sources: Sources, year: int = 2022, distinct_gardens: bool = False, accounts: Accounts = NoAccounts()
) -> DataFrame:
    """One row per area of the spine. ``accounts`` gets what each step drops once the table has been run."""
    wide = assemble_parts(
        spine(sources),
        KEY,
        [
            greenstreet_part(sources, accounts),
            energy_part(sources, year),
            parcel_part(sources, distinct_gardens, accounts),
            tree_part(sources, accounts),
        ],
    )
    return select_columns(wide, MODEL_COLUMNS).withColumn(KEY, F.col(KEY).cast("int"))


def land_use_histogram(features: DataFrame) -> DataFrame:
    """Areas per land use group, with group names, in order of the group."""
    return histogram(features, "most_common_landuse_code", LAND_USE_LABELS)
