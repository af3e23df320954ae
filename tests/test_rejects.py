"""Bad records are set aside with their reasons, nothing is lost, and counts come from the same pass."""

import pytest
from conftest import rows
from pyspark.sql import types as T

from areaframe.sources import SourceSpec, parse_lines, read_checked, to_lines
from areaframe.sources.rejects import SURPLUS_REASON, reasons_of

SCHEMA = T.StructType([
    T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()),
])
LINES = [
    "a,1,2.5", "b,NA,", '"c, d",2.0,nan', "e,1.5,1", "f,x,y", "g,1,2,3", "h,99999999999,1", "i,3", "j", '"k""k", 4 , -1e3', "l,1,2,", "null,5,6", "m,x,1,2",
]
GOOD = [
    (None, 5, 6.0), ("a", 1, 2.5), ("b", None, None), ("c, d", 2, None), ("i", 3, None), ("j", None, None), ('k"k', 4, -1000.0),
]
BAD = {
    "e,1.5,1": ["n is not whole"], "f,x,y": ["n is no number", "x is no number"], "g,1,2,3": [SURPLUS_REASON],
    "h,99999999999,1": ["n is out of range"], "l,1,2,": [SURPLUS_REASON], "m,x,1,2": [SURPLUS_REASON, "n is no number"],
}


def judged(found, total):
    assert rows(found.rows) == sorted(GOOD, key=lambda r: [(x is not None, str(x)) for x in r])
    assert {r["record"]: r["reasons"] for r in found.rejected.collect()} == BAD
    counts = found.counts.get
    assert (counts["rows"], counts["rejected"]) == (total, len(BAD))
    for why in reasons_of(SCHEMA):
        assert counts[f"rejected_{why}"] == sum(why in own for own in BAD.values())


def test_lines(spark):
    frame = spark.createDataFrame([(x,) for x in [*LINES, None]], "line string")
    judged(parse_lines(frame, "line", SCHEMA), len(LINES))
    assert parse_lines(frame.limit(0), "line", SCHEMA).rows.collect() == []
    # Fields may stand in another order, and some may not be wanted.
    turned = spark.createDataFrame([("7,skip,a,x",)], "line string")
    assert rows(parse_lines(turned, "line", SCHEMA, ["n", "other", "k", "x"]).rejected.select("record")) == [("7,skip,a,x",)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_files(spark, tmp_path, multi_line):
    path = tmp_path / "s.csv"
    path.write_text("key,n,x\n" + "\n".join(LINES) + "\n")
    spec = SourceSpec("s.csv", SCHEMA, {"k": "key", "n": "n", "x": "x"})
    judged(read_checked(spark, str(path), spec, multi_line), len(LINES))


def test_a_line_break_in_quotes_stays_in_its_record(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('key,n,x\n"a\nb",1,2\nc,bad,3\n')
    found = read_checked(spark, str(path), SourceSpec("m.csv", SCHEMA, {"k": "key", "n": "n", "x": "x"}))
    assert rows(found.rows) == [("a\nb", 1, 2.0)] and found.counts.get["rejected"] == 1


def test_rows_written_as_lines_come_back(spark):
    frame = spark.createDataFrame([("a,b", 1, 0.5), ('q"q', None, None), (None, -3, 1e300), ("é", 0, -0.0)], SCHEMA)
    back = parse_lines(to_lines(frame), "record", SCHEMA)
    assert rows(back.rows) == rows(frame) and back.rejected.collect() == []
