"""The jobs on small CSV files, with the expected tables worked out by hand."""

import csv
import math
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areaframe.plans import (
    AREA_COLUMNS,
    MODEL_COLUMNS,
    area_features,
    health_pivot,
    health_profile,
    health_summary,
    land_use_histogram,
    model_features,
)
from areaframe.sources import SOURCES, read_csv, read_sources, read_tree_census, write_csv, write_parquet

CONTENT = {
    "income": [("10001", "60000"), ("10002", "150000"), ("10003", ""), ("00501", "49999"),
               ("10009", "1")],
    "population": [("10001", "1000"), ("10002", "2000"), ("10003", "500"), ("501", "0"),
                   ("10005", "7")],
    "heat_index": [("10001", "1"), ("10002", "5"), ("10003.0", "3"), ("501", "2")],
    "greenstreets": [
        ("Active", "10001", "1.5"), ("Retired", "10001", "9"), ("Archived", "10001", "9"),
        ("", "10001", "2.0"), ("Active", "10001, 10002", "4"), ("Active", "", "5"),
        ("Active", "10003", ""), ("Active", "99999", "7"),
    ],
    "energy": [
        ("2022", "10001-1234", "80", "85", "100", "1,000", "10"),
        ("2022", "10001", "Not Available", "90", "300", "5", " 20 "),
        ("2021", "10001", "10", "10", "10", "10", "10"),
        ("2022", "10002", "60", "70", "", "1", "1"),
        ("2022", "none", "50", "50", "50", "50", "50"),
        ("2022", "10003", "Not Available", "Not Available", "Not Available", "x", "1d"),
        ("2022", "10002", "40", "NaN", "7", "8", "9"),
    ],
    "parcels": [
        ("10001.0", "1", "MN", "01", "2", "10", "12", "1000"),
        ("10001", "1", "BX", "04", "1", "5", "6", "500"),
        ("10001.0", "2", "MN", "09", "1", "1", "1", "100"),
        ("10001.0", "2", "BX", "", "0", "0", "0", "0"),
        ("10002.0", "2", "MN", "05", "0", "4", "4", "300"),
        ("10002.0", "3", "MN", "10", "0", "", "1", ""),
        ("", "1", "MN", "01", "5", "5", "5", "5"),
        ("10003.0", "4", "QN", "07", "1", "1", "1", "50"),
        ("501.0", "5", "SI", "02", "1", "2", "3", "70"),
    ],
    "gardens": [("1",), ("1",), ("2",), ("9",), ("",)],
    "college": [("10001", "45.5"), ("10002", "30")],
    "justice": [("10001", "55.5", "20", "100"), ("10002", "1", "1", "2"), ("501", "*", "1", "1")],
    "poverty": [
        ("Geography", "Estimate", "Total"), ("a", "b", "c"), ("", "", ""),
        ("ZCTA5 10001", "125", "1000"), ("ZCTA5 10002", "1", "3"), ("ZCTA5 00501", "0", "0"),
    ],
}
TREES = [
    ("Alive", "Good", "10001", "A"), ("Alive", "Fair", "10001", "B"), ("Alive", "", "10001", "B"),
    ("Dead", "", "10001", "A"), ("Stump", "", "10001", ""), ("", "Good", "10002", "C"),
    ("Alive", "odd", "10002", "C"), ("Alive", "Poor", "", "D"),
]


def write_file(path, header, lines):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows(lines)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sources")
    for name, lines in CONTENT.items():
        spec = SOURCES[name]
        header = list(spec.spelled.values()) if spec.spelled else spec.schema.names
        # A column nobody asks for, with a quote and a comma in it.
        more = ["Extra"] if spec.spelled else []
        write_file(path / spec.file, more + header,
                   [(['say "x", y'] if more else []) + list(line) for line in lines])
    header = [f"c{i}" for i in range(27)]
    for i, name in ((0, "tree_id"), (6, "status"), (7, "health"), (25, "postcode"), (26, "nta_name")):
        header[i] = name
    lines = []
    for number, (status, health, postcode, area) in enumerate(TREES):
        line = ["x"] * 27
        line[0], line[6], line[7], line[25], line[26] = number, status, health, postcode, area
        lines.append(line)
    write_file(path / SOURCES["trees"].file, header, lines)
    return str(path)


@pytest.fixture(scope="module")
def sources(spark, folder):
    return read_sources(spark, folder)


AREA_10001 = ("10001", "BX", "A", 1000, 400.0, 0.016, 80.0, 200.0, 2.5, 15.0, 3, 3.5, 6,
              55.5, 20.0, 0.125, 0.455, 100.0, 1, 1)
AREA_10002 = ("10002", "MN", "C", 2000, math.inf, 0.002, 40.0, 7.0, 8.0, 9.0, 1, 0.0, 1,
              1.0, 1.0, 0.3333, 0.3, 2.0, 3, 5)


def test_area_features(sources):
    got = area_features(sources)
    assert tuple(got.columns) == AREA_COLUMNS
    assert rows(got) == [AREA_10001]
    assert dict(got.dtypes)["num_trees"] == "bigint"
    assert dict(got.dtypes)["income_group"] == "int"


def test_area_features_with_infinite_ratios(sources):
    assert rows(area_features(sources, infinite_ratios=True)) == [AREA_10001, AREA_10002]


def test_area_features_with_distinct_gardens(sources):
    got = area_features(sources, distinct_gardens=True)
    assert got.first()["num_community_gardens"] == 3


def test_model_features(sources):
    got = model_features(sources)
    assert tuple(got.columns) == MODEL_COLUMNS
    assert rows(got, "zipcode") == [
        (501, 49999.0, 0, 2, 0, 0.0, 0.0, 0.0, 0.0, 1, 3.0, 70.0, 1, 0, None, None),
        (10001, 60000.0, 1000, 1, 2, 3.5, 80.0, 5.0, 400.0, 1, 18.0, 1500.0, 2, 4, 4, 0.25),
        (10002, 150000.0, 2000, 5, 0, 0.0, 50.0, 10.0, 7.0, 2, 5.0, 300.0, 0, 1, 2, 0.5),
        (10003, None, 500, 3, 1, 0.0, 0.0, 0.0, 0.0, 3, 1.0, 50.0, 3, 0, None, None),
    ]
    assert [tuple(r) for r in land_use_histogram(got).collect()] == [
        (1, 2, "Residential"), (2, 1, "Commercial"), (3, 1, "Industrial")
    ]


def test_tree_health_by_position(spark, folder):
    trees = read_tree_census(spark, os.path.join(folder, SOURCES["trees"].file))
    assert trees.columns == ["tree_id", "status", "health", "postcode"]
    assert rows(health_profile(trees)) == [
        ("10001", 4, 0.5, 0.0, 0.25, 0.25), ("10002", 2, 0.5, 0.0, 0.0, 0.5)
    ]
    assert rows(health_summary(trees)) == [("10001", 4, 0.25), ("10002", 2, 0.5)]
    pivot = health_pivot(trees)
    assert pivot.columns == ["postcode", "0", "1", "2", "3"]
    shares = pivot.select(F.expr("`0` + `1` + `2` + `3`"))
    assert rows(shares) == [(1.0,), (1.0,)]


def test_sinks_round_trip(spark, sources, tmp_path):
    table = area_features(sources)
    write_csv(table, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert tuple(back.columns) == AREA_COLUMNS
    assert back.first()["zipcode"] == "10001" and back.first()["poverty_percent"] == "0.125"
    write_parquet(table, str(tmp_path / "parquet"))
    again = spark.read.parquet(str(tmp_path / "parquet"))
    assert again.schema.simpleString() == table.schema.simpleString()
    assert rows(again) == [AREA_10001]


def test_sources_are_also_read_from_parquet(spark, sources, tmp_path):
    from areaframe.sources import read_source

    spec = SOURCES["greenstreets"]
    spelled = sources["greenstreets"].toDF(*[spec.spelled[c] for c in spec.schema.names])
    write_parquet(spelled, str(tmp_path / "g"))
    again = read_source(spark, str(tmp_path / "g"), spec, form="parquet")
    assert rows(again) == rows(sources["greenstreets"])


def test_csv_parser_skips_unused_columns(sources):
    plan = sources["gardens"]._jdf.queryExecution().toString()
    assert "ReadSchema: struct<block:string>" in plan


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n"x\ny",1\nz,2\n')
    assert read_csv(spark, str(path), multi_line=True).count() == 2
