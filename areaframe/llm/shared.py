"""Intermediate tables in the shared folder, and Arrow batches cut as tasks need them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder inside the one that all executors reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that runs on
    one machine (tests) may go without; it gets a temporary folder. On a cluster a
    missing setting stops the job, since a local folder would lose rows silently.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="llm-"))
    return f"{named}/{sc.applicationId}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{work_folder(spark)}/{what}-{uuid.uuid4().hex}"


def save(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` once and go on from its files: lineage ends here, and a lost
    executor re-reads instead of running everything before it again."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> bool:
    """Remove this application's intermediate tables, once its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.delete(path, True)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(marks) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[marks[0] : marks[-1]]
    return whole, marks - marks[0]


def pieces(
    batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 19
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into runs of rows with about ``size`` bytes of text (always whole
    rows), so that work arrays stay near the cache and small beside the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, marks = texts(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(marks, marks[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield (
                batch.slice(start, stop - start),
                data[marks[start] : marks[stop]],
                marks[start : stop + 1] - marks[start],
            )
            start = stop


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups: batches of a partition sorted by ``key`` are
    cut where the key changes; what is open at a batch's end goes to the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        opens = int(changes[-1]) + 1 if len(changes) else 0
        if held:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if opens == 0 and keys[0] == last:
                held.append(batch)
                continue
        if opens:
            yield pa.Table.from_batches([*held, batch.slice(0, opens)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(opens)]
    if held:
        yield pa.Table.from_batches(held)


def binaries(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=dtype) for x in column.to_pylist()]


def extended(df: DataFrame, added: dict[str, str]) -> str:
    """The schema of ``df`` with computed columns after its own. An own column of a
    computed one's name gives way to it."""
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in added]
    return ", ".join([*own, *[f"`{name}` {kind}" for name, kind in added.items()]])


def extend(rows: pa.RecordBatch, added: dict[str, pa.Array], leave: tuple = ()) -> pa.RecordBatch:
    """A batch in the order of :func:`extended`; ``leave`` names columns that only the task needs."""
    names = [n for n in rows.schema.names if n not in added and n not in leave]
    arrays = [rows.column(rows.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *added.values()], names=[*names, *added])
