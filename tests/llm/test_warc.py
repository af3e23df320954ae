import gzip
import hashlib
import os
import random

import duckdb
import pytest

from areaframe.llm.queries import ORACLES
from areaframe.llm.shared import work_folder
from areaframe.llm.warc import archive_round_trip, commit, plan_records, read_archives, shard_starts, write_archives

SCHEMA = "page_id bigint, url string, html string"


def pages(n=300):
    rng = random.Random(6)
    big = ["<p>" + "".join(rng.choices("abcdef é\n", k=rng.randint(900, 4000))) for _ in range(40)]
    out = [(i, f"http://h/{i}", rng.choice(big) if i % 3 else "".join(rng.choices("xyz ", k=rng.randint(0, 900)))) for i in range(n)]
    out += [(n + 1, None, None), (n + 2, "", ""), (n + 3, "a\nb\x00c", "short"), (n + 4, "u", "short"), (n + 5, "u", "y" * 300_000)]
    out += [(3, "http://h/3", out[3][2]), (4, "http://other", "another text under an id")]
    return out + [(None, f"http://none/{i}", big[i % 4]) for i in range(30)]


def listing(manifest):
    return sorted((r.shard, r.part, r.file, r.bytes, r.records, r.sha256, r.first_id, r.last_id) for r in manifest.collect())


def test_the_same_table_gives_the_same_archives(spark, tmp_path):
    data = pages()
    seen = []
    for i, partitions in enumerate((1, 7)):
        random.Random(i).shuffle(data)
        frame = spark.createDataFrame(data, SCHEMA).repartition(partitions)
        spark.conf.set("spark.sql.shuffle.partitions", str(3 + 4 * i))
        folder = str(tmp_path / str(i))
        manifest = write_archives(plan_records(frame), folder, shard_bytes=100_000, roll_bytes=12_000)
        seen.append(listing(manifest))
        for r in manifest.collect():
            assert hashlib.sha256(open(f"{folder}/{r.file}", "rb").read()).hexdigest() == r.sha256
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
    shards = {r[0] for r in seen[0]}
    assert len(shards) > 3 and max(r[1] for r in seen[0]) >= 2  # several shards, some of several parts
    assert sum(r[4] for r in seen[0]) == len(data)
    # Ranges of ids, in order, none in two shards.
    ends = [(int(r[6]), int(r[7])) for r in seen[0] if r[6] != "none"]
    assert all(a <= b for a, b in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]) if y[0] >= 0)


def test_shards_begin_at_multiples_of_their_size(spark):
    data = [(i, "u", "x" * 100) for i in range(50)]
    records = plan_records(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert [k[1] for k in shard_starts(records, 1000)] == [10, 20, 30, 40]
    assert shard_starts(records, 10**9) == [] and shard_starts(records.limit(0), 10) == []


def test_round_trip_equals_the_sql(spark):
    data = [d for d in pages() if d[0] is not None and (d[0], d[1]) != (4, "http://other")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA + ", refers_to string, payload_bytes int")
    got = sorted(tuple(r) for r in archive_round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    connection = duckdb.connect()
    connection.register("pages", frame.select("page_id", "url", "html").toPandas())
    expected = sorted(connection.execute(ORACLES["op1_warc"]).fetchall())
    assert [tuple(map(str, r)) for r in got] == [tuple("None" if x is None or x != x else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in expected]
    assert sum(r[3] == "revisit" for r in got) > 100


def test_rows_without_an_id_and_no_rows(spark):
    frame = spark.createDataFrame(pages(), SCHEMA)
    none = [r for r in archive_round_trip(frame).collect() if r.page_id is None]
    assert len(none) == 30
    assert archive_round_trip(frame.limit(0)).collect() == []


def test_what_broken_attempts_leave_is_never_seen(spark, tmp_path):
    folder = str(tmp_path / "a")
    manifest = write_archives(plan_records(spark.createDataFrame(pages(40), SCHEMA)), folder, shard_bytes=20_000, roll_bytes=5_000)
    before = sorted(map(str, read_archives(spark, folder).collect()))
    mark = os.listdir(f"{folder}/_temporary")[0]
    for name in (f"_temporary/{mark}/0-0-1-second", "part-999999-00000.warc.gz"):
        with open(f"{folder}/{name}", "wb") as file:
            file.write(gzip.compress(b"WARC/1.1\r\nbroken"))
    # Committing once more changes nothing.
    again = spark.createDataFrame(manifest.collect(), manifest.schema)
    commit(again, folder)
    assert sorted(map(str, read_archives(spark, folder).collect())) == before
    assert work_folder(spark)


def test_a_damaged_file_stops_the_reader(spark, tmp_path):
    folder = str(tmp_path / "b")
    manifest = write_archives(plan_records(spark.createDataFrame([(1, "u", "text " * 300)], SCHEMA)), folder)
    path = f"{folder}/{manifest.first().file}"
    whole = gzip.open(path).read().replace(b"text text", b"tExt text", 1)
    with open(path, "wb") as file:
        file.write(gzip.compress(whole))
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, folder).collect()
