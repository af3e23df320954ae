"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Runtime re-planning: merge small shuffle partitions, turn a join into a
    # broadcast only after the size of the side has been measured, split hot ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def get_session(app: str = "areaframe", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    extra = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    if spark.sparkContext.getConf().get("spark.sql.shuffle.partitions") is None:
        # A few tasks per core; partitions that turn out small are merged at run time.
        partitions = max(8, 3 * spark.sparkContext.defaultParallelism)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors reach, where the cluster or the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` for being read many times.

    Where a shared folder is named, it is written there once and read from its files: a
    lost executor re-reads them instead of re-running the joins behind them, and a pass
    that needs two columns reads two. The files lie under the application's id;
    :func:`clear_tables` removes them when results are written. Without a shared folder
    it is persisted, which recomputes what an executor loses.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    application = df.sparkSession.sparkContext.applicationId
    path = f"{folder}/{application}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Removes what :func:`cut_lineage` wrote or kept for this application."""
    spark.catalog.clearCache()
    folder = shared_folder(spark)
    if folder is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
