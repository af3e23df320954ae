"""Steps that the feature jobs share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code_from_text, first_five_digits, key_from_number, key_from_text
from ..operators.accounts import Accounts
from ..operators.aggregates import rows, summarise, total
from ..operators.filters import drop_incomplete, exclude_values, keep_equal
from ..operators.joins import inner_spine

Sources = Mapping[str, DataFrame]
KEY = "zipcode"


def keyed(df: DataFrame, column: str = KEY) -> DataFrame:
    """Rows with a text key, in its one spelling, under the name all joins use.

    The test for a missing key is made on the column as it is stored, where the
    scan can take it over. Past it the key is declared present, which spares the
    next step from working the key out a second time just to test it.
    """
    present = df.filter(F.col(column).isNotNull())
    keys = present.withColumn("_key", F.coalesce(key_from_text(column), F.lit("")))
    return keys.drop(column).withColumnRenamed("_key", KEY)


def spine(sources: Sources) -> DataFrame:
    """Income, population and target of the areas that have all three."""
    parts = [keyed(sources[name]) for name in ("income", "population", "heat_index")]
    return inner_spine(KEY, *parts)


def open_greenstreets(sources: Sources, accounts: Accounts) -> DataFrame:
    return accounts.through(
        sources["greenstreets"], "closed greenstreets",
        lambda streets: exclude_values(streets, "status", "Retired", "Archived"), ["status"],
    )


def energy_of_year(energy: DataFrame, year: int) -> DataFrame:
    """Buildings of one year, keyed by the digits in their postal code."""
    return keep_equal(energy, "year", year).withColumn(KEY, first_five_digits("postal_code"))


def keyed_parcels(parcels: DataFrame) -> DataFrame:
    """Lots with a numeric key, for the same reason tested before it is spelled."""
    present = drop_incomplete(parcels, ["postcode"])
    return present.withColumn(KEY, F.coalesce(key_from_number("postcode"), F.lit("")))


#: Cells that a task adds up by area: at most as many rows as its share of the lots, however many there are in all.
LOTS_PER_TASK = 200_000


def parcel_cells(
    lots: DataFrame, gardens: DataFrame, modes: tuple[str, ...], totals: tuple[str, ...], distinct: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Lots counted by area, block and ``modes``, with sums of ``totals`` and how many gardens lie on the block.

    Everything that lots are asked for can be added up from these cells, so they are read once: ``_lots`` rows stand behind a cell, ``_gardens`` is
    what it adds to its area, a garden once per lot on its block, or with ``distinct`` once per area. Both sides of
    the join come straight from an exchange, so a block that holds many lots or links is split. A task of the join gets the
    cells of whole blocks, in which an area seldom comes twice: nothing would be added up there, at the price of
    a table of all its cells. So they are dealt anew by area and first mode, with ``most``, a bound of the number of lots, in parts of a fixed size."""
    coded = lots.withColumn("block", code_from_text("block"))
    cells = coded.groupBy(KEY, "block", *modes).agg(rows().alias("_lots"), *[total(c).alias(c) for c in totals])
    on_block = summarise(
        gardens.select(code_from_text("block").alias("block")), "block", _items=rows()
    ).withColumnRenamed("block", "_block")
    placed = cells.join(on_block, F.col("block") == F.col("_block"), "left").drop("_block")
    links = F.col("_lots")
    if distinct:
        first = F.row_number().over(Window.partitionBy(KEY, "block").orderBy(*modes))
        placed = placed.withColumn("_first", first)
        links = (F.col("_first") == 1).cast("bigint")
    placed = placed.withColumn("_gardens", F.coalesce(F.col("_items") * links, F.lit(0).cast("bigint")))
    return placed if most is None else placed.repartition(max(1, -(-most // LOTS_PER_TASK)), KEY, modes[0])
