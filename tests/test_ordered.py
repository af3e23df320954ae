"""The ordered sink: total order, the same files every time, nothing half done in sight."""

import csv
import os
import random

import pytest
from conftest import rows

from areaframe.sources import manifest, write_ordered_csv
from areaframe.sources.ordered import Folder, file_numbers

SCHEMA = "k string, n int, x string"


def data():
    rng = random.Random(3)
    keys = [f"{rng.randint(0, 400):05d}" for _ in range(900)] + ["hot"] * 300 + [None] * 20
    return [(k, rng.choice([None, 1, 2, 3]), rng.choice(["a,b", 'q"q', "é", None])) for k in keys]


def files(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if not n.startswith((".", "_"))}


def read(folder):
    out = []
    for name, content in files(folder).items():
        lines = list(csv.reader(content.decode().splitlines()))
        assert lines[0] == ["k", "n", "x"]
        out.append(lines[1:])
    return out


def test_order_sizes_and_repetition(spark, tmp_path):
    listed = data()
    seen = []
    for i, partitions in enumerate((1, 6)):
        random.Random(i).shuffle(listed)
        folder = str(tmp_path / str(i))
        frame = spark.createDataFrame(listed, SCHEMA).repartition(partitions)
        done = write_ordered_csv(frame, folder, ["k", "n"], rows_per_file=100)
        assert done == manifest(spark, folder) and sum(e["rows"] for e in done) == len(listed)
        seen.append(files(folder))
        parts = read(folder)
        assert [len(p) for p in parts] == [e["rows"] for e in done] and len(parts) > 5
        flat = [tuple(x or None for x in r) for p in parts for r in p]
        expected = sorted(((k, None if n is None else str(n), x) for k, n, x in listed), key=lambda r: [(x is not None, x or "") for x in r])
        assert flat == expected
        # No key in two files.
        assert all(a[-1][:2] != b[0][:2] for a, b in zip(parts, parts[1:]))
    assert seen[0] == seen[1]


def test_a_broken_run_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    frame = spark.createDataFrame(data(), SCHEMA)
    write_ordered_csv(frame, folder, ["k", "n"], rows_per_file=200)
    before = files(folder)
    moved = []
    own = Folder.move

    def breaks(self, old, new):
        if len(moved) == 2:
            raise RuntimeError("lost")
        moved.append(new)
        own(self, old, new)

    monkeypatch.setattr(Folder, "move", breaks)
    with pytest.raises(RuntimeError):
        write_ordered_csv(frame.filter("k IS NOT NULL"), folder, ["k", "n"], rows_per_file=50)
    assert manifest(spark, folder) == []
    monkeypatch.setattr(Folder, "move", own)
    write_ordered_csv(frame, folder, ["k", "n"], rows_per_file=200)
    assert files(folder) == before and not [n for n in os.listdir(folder) if n.startswith("_staging")]


def test_no_rows_and_fewer_files(spark, tmp_path):
    folder = str(tmp_path / "e")
    frame = spark.createDataFrame(data(), SCHEMA)
    write_ordered_csv(frame, folder, ["k"], rows_per_file=100)
    assert write_ordered_csv(frame.limit(0), folder, ["k"]) == [] and files(folder) == {}
    assert manifest(spark, str(tmp_path / "none")) == []


def test_file_numbers_follow_from_counts(spark):
    frame = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [("c",)] * 25 + [("d",)], "k string")
    got = file_numbers(frame, ["k"], 10).select("k", "_file")
    assert rows(got) == [("a", 0), ("b", 0), ("c", 1), ("d", 3)]


def test_ranges_follow_from_rows_and_not_from_small_files(spark, monkeypatch):
    listed = [(None if r[0] is None else r[0], r[1]) for r in data()]
    frame = spark.createDataFrame(listed, "k string, n int")
    dealt, own = [], type(frame).repartitionByRange

    def seen(self, count, *columns):
        dealt.append(count)
        return own(self, count, *columns)

    monkeypatch.setattr(type(frame), "repartitionByRange", seen)
    few = rows(file_numbers(frame, ["k", "n"], 2))
    many = rows(file_numbers(frame, ["k", "n"], 2, rows_per_range=50))
    assert dealt == [1, -(-len(listed) // 50)] and few == many
    counts, before, expected = {}, 0, []
    for key in listed:
        counts[key] = counts.get(key, 0) + 1
    for key in sorted(counts, key=lambda r: [(x is not None, x or 0 if not isinstance(x, str) else x) for x in r]):
        expected.append((*key, counts[key], before // 2))
        before += counts[key]
    assert sorted(few, key=str) == sorted(expected, key=str)
