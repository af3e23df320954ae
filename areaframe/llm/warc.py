"""WARC archives: a deterministic sharded writer, and a reader of what it commits.

Records are range-sorted. Shards are cut where the bytes of all smaller ids pass a multiple of a
shard's size, which follows from the table alone, so the same table gives the same
archives however it is dealt over tasks and cores. Tasks write under temporary names, roll to a new file by compressed size and
report what they wrote; Spark's own commit keeps the report of one attempt per task. Only
files in that manifest are given their final names, and only they are read, so what a
failed or doubled attempt leaves behind is never seen.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .shared import new_path, save

LEAST_REVISIT = 1000
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n"
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = (
    "shard int, part int, temporary string, file string, bytes bigint, records bigint, "
    "sha256 string, first_id string, last_id string"
)


def _store(uri: str):
    """File system and path of a place that every executor reaches."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = LEAST_REVISIT,
) -> DataFrame:
    """(id, url, payload, size, sha1, refers_to) per page: payloads as bytes (null: empty), and
    for every page whose payload of ``least`` bytes or more a larger id holds as well, that id."""
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = save(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
        .select(
            "id", F.col("url").cast("string").alias("url"), "payload",
            F.length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1"),
            # Equal payloads are told by this digest itself.
            F.sha2("payload", 256).alias("body"),
        ),
        "records",
    )
    large = rows.filter((F.col("size") >= least) & F.col("id").isNotNull())
    repeats = (
        large.groupBy("body").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select("body", "holder")
    )
    # A page refers to the holder unless it is the holder; a body may hold most of the pages.
    named = spread_join(large.select("body", "id"), save(repeats, "holders"), "body", "inner")
    refers = save(
        named.filter("id != holder").select(F.col("id").alias("_id"), F.col("body").alias("_body"), "holder").distinct(), "refers"
    )
    joined = rows.join(refers, (F.col("id") == F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    return joined.select("id", "url", "payload", "size", "sha1", F.col("holder").alias("refers_to"))


def _name(value) -> str:
    return "none" if value is None else str(value)


def _urn(value) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + _name(value))}>"


def _clean(value: str) -> str:
    """A header value on one line: what would break the line is percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page, url, payload: bytes, sha1: str, refers_to, date: str = EPOCH) -> bytes:
    """One record with headers made anew. A revisit has no block; its headers still give the
    digest and size of the payload it stands for."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", date),
        ("X-Record-Key", _name(page)),
        ("X-Payload-Length", str(len(payload))),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        lines += [("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Key", _name(refers_to)), ("WARC-Profile", PROFILE)]
    lines += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = END.join([VERSION, *[f"{k}: {v}".encode() for k, v in lines], b"", b""])
    return head + block + END + END


def _packed(data: bytes, level: int) -> bytes:
    """A gzip member of its own, without a time in it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


Key = tuple[bool, object, int]


def shard_starts(records: DataFrame, shard_bytes: int) -> list[Key]:
    """The first key, (has an id, id, hash of the url), of every shard but the first, in order.

    A shard begins where the payload bytes of all smaller keys pass a multiple of ``shard_bytes``. Keys are sorted by ranges, sums of
    ranges added up, and each key gets what lies before it: exact, so where the ranges happened to be cut does not matter. A key
    for each ``shard_bytes`` reaches the driver and goes to every task, 4 MB for 100 TB and the default size."""
    total = records.agg(F.sum("size")).first()[0] or 0
    if total <= shard_bytes:
        return []
    keys = records.groupBy("id", F.xxhash64("url").alias("u")).agg(F.sum("size").alias("size"))
    ranged = keys.repartitionByRange(-(-total // shard_bytes), "id", "u").withColumn("range", F.spark_partition_id())
    ranged = save(ranged, "keys")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = save(sums.select("range", before.alias("_offset")), "offsets")
    within = Window.partitionBy("range").orderBy("id", "u").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, "range")
    shard = F.floor((F.col("_offset") + F.col("_within")) / F.lit(shard_bytes)).cast("bigint")
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("id", "u")).alias("first"))
    listed = sorted((r["shard"], r["first"]["id"], r["first"]["u"]) for r in firsts.filter("shard > 0").collect())
    return [_key(i, u) for _, i, u in listed]


def _key(page, url_hash: int) -> Key:
    return (page is not None, 0 if page is None else page, url_hash)


def sharded(records: DataFrame, starts: list[Key]) -> DataFrame:
    """``records`` with the number of their shard."""
    kinds = dict(records.dtypes)
    names = ["id", "url", "payload", "sha1", "refers_to"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(k).to_pylist() for k in (0, 5))
            numbers = [bisect_right(starts, _key(i, u)) for i, u in zip(ids, hashes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(numbers, pa.int32())], names=[*names, "shard"])

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", shard int"
    return records.select(*names, F.xxhash64("url").alias("_u")).mapInArrow(task, schema)


def write_archives(
    records: DataFrame, folder: str, shard_bytes: int = 128 << 20, roll_bytes: int = 16 << 20, level: int = 6
) -> DataFrame:
    """Writes what :func:`plan_records` gives to ``folder`` and returns the manifest.

    Range-sorted by id, in shards of about ``shard_bytes`` of payload; a file is closed when
    it has ``roll_bytes`` compressed bytes, so no file is larger than that and one record. Names, contents and digests of
    the files follow from the table and these sizes.
    """
    starts = shard_starts(records, shard_bytes)
    shards = len(starts) + 1
    mark = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        context = TaskContext.get()
        shard, part, sink, temporary = -1, 0, None, ""
        count = size = 0
        first = last = None
        sums = hashlib.sha256()

        def close() -> pa.RecordBatch:
            sink.close()
            row = [shard, part, temporary, f"part-{shard:06d}-{part:05d}.warc.gz", size, count, sums.hexdigest(), first, last]
            names = [c.split()[0] for c in MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page, url, payload, sha1, refers, own = (c[i].as_py() for c in columns)
                if own != shard:
                    if sink is not None:
                        yield close()
                    shard, part, sink = own, 0, None
                packed = _packed(record(page, url, payload, sha1, refers), level)
                if sink is None:
                    temporary = f"_temporary/{mark}/{shard}-{part}-{context.attemptNumber()}-{uuid.uuid4().hex}"
                    store.create_dir(f"{path}/_temporary/{mark}", recursive=True)
                    sink = store.open_output_stream(f"{path}/{temporary}")
                    count = size = 0
                    first, sums = _name(page), hashlib.sha256()
                sink.write(packed)
                sums.update(packed)
                count, size, last = count + 1, size + len(packed), _name(page)
                if size >= roll_bytes:
                    yield close()
                    part, sink = part + 1, None
        if sink is not None:
            yield close()

    # A shard is whole in one task; a task may have several, one after the other.
    dealt = sharded(records, starts).repartition(shards, "shard").sortWithinPartitions("shard", "id", "url", "sha1", "refers_to")
    return commit(save(dealt.mapInArrow(task, MANIFEST), "manifest"), folder)


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Gives the manifest's files their final names; doing it again changes nothing. The
    manifest itself is written beside them, last."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = _store(folder)
        for batch in batches:
            for old, new in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if store.get_file_info(f"{path}/{old}").type != fs.FileType.NotFound:
                    store.move(f"{path}/{old}", f"{path}/{new}")
            yield batch

    placed = manifest.repartition(max(1, manifest.count() // 16), "file").mapInArrow(task, MANIFEST)
    target = f"{folder}/_manifest"
    placed.write.mode("overwrite").parquet(target)
    return manifest.sparkSession.read.schema(MANIFEST).parquet(target)


def _header(stream: io.BufferedReader) -> dict[str, str] | None:
    line = stream.readline()
    if not line:
        return None
    if line.strip() != VERSION:
        raise ValueError(f"no record begins with {line[:40]!r}")
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        key, _, value = line.partition(b": ")
        out[key.decode()] = value.decode()
    return out


READ = (
    "page string, record_type string, target_uri string, payload binary, payload_bytes bigint, "
    "payload_digest string, refers_to string, file string"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files in the manifest: keys as text, digests as bare lower-case
    hex. Every block is checked against its digests; a damaged archive stops the job."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                raw = store.open_input_stream(f"{path}/{file}", compression="gzip")
                stream = io.BufferedReader(raw, 1 << 20)
                while (head := _header(stream)) is not None:
                    block = stream.read(int(head["Content-Length"]))
                    stream.readline(), stream.readline()
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    own = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                    revisit = head["WARC-Type"] == "revisit"
                    if own != head["WARC-Block-Digest"] or not revisit and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"{file}: the digest of {head['WARC-Record-ID']} differs")
                    key, refers = head["X-Record-Key"], head.get("X-Refers-To-Key")
                    if not revisit and len(block) != int(head["X-Payload-Length"]):
                        raise ValueError(f"{file}: the length of {head['WARC-Record-ID']} differs")
                    rows.append((
                        None if key == "none" else key, head["WARC-Type"], head.get("WARC-Target-URI"),
                        block if payloads else None, int(head["X-Payload-Length"]) if revisit else len(block), digest, refers, file,
                    ))
                    held += len(block) if payloads else 64
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 4096), "file").mapInArrow(task, READ)


def archive_round_trip(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Writes ``pages`` and reads the archives back, without the payloads.

    Defined cases: a null payload is empty, a null url has no header, a null id is a record
    without a key that never stands for others. Rows of one id and payload are one record each, all
    response or all revisit alike. Other columns are not archived. An empty table gives no
    file and no row.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "archives")
    write_archives(plan_records(pages, id_col, url_col, payload_col), folder)
    kind = pages.schema[id_col].dataType.simpleString()
    return read_archives(spark, folder, payloads=False).select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
