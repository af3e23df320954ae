"""Tree health by area."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import encode
from ..operators.accounts import Accounts, NoAccounts
from ..operators.aggregates import contingency_shares, rows, share_of, summarise
from ..operators.filters import drop_missing_and_equal
from ..operators.projection import drop_columns

# Health in words to codes; no or any other word is dead.
HEALTH_CODES = {"Good": 0, "Fair": 1, "Poor": 2}
GOOD, FAIR, POOR, DEAD = 0, 1, 2, 3


def kept_trees(trees: DataFrame) -> DataFrame:
    """Trees with coded health, without those alive but of unknown health."""
    consistent = drop_missing_and_equal(trees, "health", "status", "Alive")
    return drop_columns(consistent, "status").withColumn(
        "health", encode("health", HEALTH_CODES, DEAD)
    )


def health_profile(
    trees: DataFrame, key: str = "postcode", accounts: Accounts = NoAccounts()
) -> DataFrame:
    """Number of trees and the share of each state. ``accounts`` gets how many trees were left out."""
    return summarise(
        accounts.through(trees, "trees that contradict themselves", kept_trees, ["health", "status"]),
        key,
        treeCount=rows(),
        deadProportion=share_of("health", DEAD),
        poorProportion=share_of("health", POOR),
        fairProportion=share_of("health", FAIR),
        goodProportion=share_of("health", GOOD),
    )


def health_summary(trees: DataFrame, key: str = "postcode") -> DataFrame:
    """Number of trees and the share of good ones, keyed ``zipcode``."""
    table = summarise(
        kept_trees(trees), key, treeCount=rows(), goodProportion=share_of("health", GOOD)
    )
    return table.withColumnRenamed(key, "zipcode")


def health_pivot(trees: DataFrame, key: str = "postcode") -> DataFrame:
    """One column of shares per health code, 0 where an area has none."""
    return contingency_shares(kept_trees(trees), key, "health", (GOOD, FAIR, POOR, DEAD))
