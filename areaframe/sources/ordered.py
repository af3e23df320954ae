"""A sink in total order that can be repeated: the same table leaves the same files, byte by byte.

A file begins where the number of rows with smaller keys passes a multiple of the file's size. That follows from the table
alone, so neither the number of tasks nor sampling has a say. Files are written to a staging folder, moved to their final names and
listed in a manifest that is moved into place last; only what it lists is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.missing import as_column
from ..session import cut_lineage

MANIFEST, STAGING = "_manifest.json", "_staging"
#: Ranges are no smaller: the sample behind them, which the driver holds, has a hundred keys or more for each.
ROWS_PER_RANGE = 100_000


def file_numbers(
    df: DataFrame, order: Sequence[str], rows_per_file: int, name: str = "_file", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per key of ``order`` with the number of its file. Keys are counted, sorted by ranges, and each gets what lies before it: in its
    range and in the ranges before. The window without a partition holds one row per range. How many ranges there are follows from the rows and not from
    the files, of which small ones may be many."""
    keys = df.groupBy(*[as_column(c) for c in order]).agg(F.count(F.lit(1)).alias("_n"))
    total = keys.agg(F.sum("_n")).first()[0] or 0
    ranged = keys.repartitionByRange(max(1, -(-total // max(rows_per_file, rows_per_range))), *[as_column(c) for c in order])
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_range").orderBy(*[as_column(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    placed = ranged.join(offsets, "_range").withColumn(name, F.floor(before / F.lit(rows_per_file)).cast("int"))
    return placed.select(*[as_column(c) for c in order], "_n", name)


class Folder:
    """A place that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.system = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        if not self.system.exists(self.at(name)):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at(name)))

    def move(self, old: str, new: str) -> None:
        """A file to its final name; what an attempt before left there goes."""
        self.remove(new)
        if not self.system.rename(self.at(old), self.at(new)):
            raise OSError(f"{old} could not be moved to {new}")

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def write(self, name: str, text: str) -> None:
        out = self.system.create(self.at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def write_ordered_csv(df: DataFrame, folder: str, order: Sequence[str], rows_per_file: int = 1_000_000) -> list[dict]:
    """CSV with a header in files ``part-00000.csv`` and on, sorted by ``order``, missing first, then by all other columns. Returns what the
    manifest lists: file and rows.

    Rows of one key share a file, so a file has ``rows_per_file`` rows and those of its last key. Keys count by their values, NULL too. A table that is there
    is replaced: until the new manifest stands none is, so a reader finds the whole table or nothing. Files that the
    manifest does not list are removed. An empty table leaves an empty manifest."""
    spark, columns = df.sparkSession, list(df.columns)
    rows = cut_lineage(df)
    numbered = cut_lineage(file_numbers(rows, order, rows_per_file))
    # One row per file: as many as the manifest lists.
    sizes = {r["_file"]: r["n"] for r in numbered.groupBy("_file").agg(F.sum("_n").alias("n")).collect()}
    renamed = numbered.select(*[as_column(c).alias(f"_key{i}") for i, c in enumerate(order)], "_file")
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & as_column(c).eqNullSafe(F.col(f"_key{i}"))
    rest = [c for c in columns if c not in order]
    sorting = ["_file", *[as_column(c) for c in order], *[as_column(c) for c in rest]]
    place, staging = Folder(spark, folder), f"{STAGING}-{uuid.uuid4().hex}"
    for name in place.names():
        if name.startswith(STAGING):
            place.remove(name)
    dealt = rows.join(renamed, same).select(*[as_column(c) for c in columns], "_file").repartition(max(1, len(sizes)), "_file")
    dealt.sortWithinPartitions(*sorting).write.partitionBy("_file").option("header", True).option("escape", '"').csv(f"{folder}/{staging}")
    place.remove(MANIFEST)
    listed = []
    for number in sorted(sizes):
        own, final = f"{staging}/_file={number}", f"part-{len(listed):05d}.csv"
        parts = [n for n in place.names(own) if n.startswith("part-")]
        if len(parts) != 1:
            raise OSError(f"{own} holds {len(parts)} files")
        place.move(f"{own}/{parts[0]}", final)
        listed.append({"file": final, "rows": sizes[number]})
    kept = {entry["file"] for entry in listed}
    for name in place.names():
        if name.startswith("part-") and name not in kept:
            place.remove(name)
    place.write(f"{staging}.json", json.dumps(listed))
    place.move(f"{staging}.json", MANIFEST)
    place.remove(staging)
    return listed


def manifest(spark: SparkSession, folder: str) -> list[dict]:
    """The files of a finished table, in order; none where a run did not come to its end."""
    place = Folder(spark, folder)
    return json.loads(place.read(MANIFEST)) if MANIFEST in place.names() else []
