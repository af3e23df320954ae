"""One small frame per place where missing values decide the result."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from areaframe.functions import (
    MISSING_TOKENS,
    bucketize,
    encode,
    first_five_digits,
    key_from_number,
    key_from_text,
    nan_to_null,
    normalise_missing,
    parse_number,
    ratio,
    round_half_even,
    zero_fill,
)
from areaframe.operators.aggregates import (
    mean,
    mean_gap,
    missing_counts,
    mode_by_key,
    rows as row_count,
    share_of,
    summarise,
    summarise_with_modes,
    total,
    total_per_row,
)
from areaframe.operators.features import apply_scaling, fit_scaling
from areaframe.operators.filters import (
    drop_incomplete,
    drop_missing_and_equal,
    exclude_containing,
    exclude_values,
    show_missing_and_equal,
)
from areaframe.operators.joins import Branch, assemble, inner_spine, left_onto

NAN = float("nan")


def values(df):
    return [r[0] for r in df.collect()]


def column(spark, items, kind, expression):
    return values(spark.createDataFrame([(x,) for x in items], f"x {kind}").select(expression))


def test_excluding_values_keeps_missing(spark):
    df = spark.createDataFrame([("Retired",), ("Archived",), ("Open",), (None,)], "x string")
    assert rows(exclude_values(df, "x", "Retired", "Archived")) == [(None,), ("Open",)]


def test_missing_key_forms_no_group(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, x double")
    assert rows(summarise(df, "k", s=total("x"))) == [("a", 1.0)]


def test_sum_of_nothing_is_zero_but_mean_is_missing(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, x double")
    assert rows(summarise(df, "k", s=total("x"), m=mean("x"))) == [("a", 0.0, None)]


def test_nan_becomes_missing_before_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", 3.0)], "k string, x double")
    clean = normalise_missing(df)
    assert rows(summarise(clean, "k", s=total("x"), m=mean("x"), n=F.count("x"))) == [
        ("a", 4.0, 2.0, 2)
    ]


def test_bucketize_edges_missing_and_nan(spark):
    items = [49_999.99, 50_000.0, 99_999.0, 100_000.0, 149_999.0, 150_000.0, None, NAN, -1.0]
    got = column(spark, items, "double", bucketize("x", [50_000, 100_000, 150_000]))
    assert got == [0, 1, 1, 2, 2, 3, 0, 0, 0]


def test_missing_keys_do_not_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, y int")
    assert rows(inner_spine("k", left, right)) == [("a", 1, 3)]
    assert rows(left_onto(left, right, "k")) == [(None, 2, None), ("a", 1, 3)]


def test_ratio_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, 4.0)],
                               "a double, b double")
    assert values(df.select(ratio("a", "b"))) == [None, None, None, None, 0.25]
    assert values(df.select(ratio("a", "b", infinite=True))) == [
        math.inf, -math.inf, None, None, 0.25
    ]


def test_parse_number(spark):
    items = ["1", " 2.5 ", "-3e2", ".5", "5.", "+7", "1,000", "1d", "1f", "NaN", "", " ",
             "Not Available", None, "0x10", "inf"]
    assert column(spark, items, "string", parse_number("x")) == [
        1.0, 2.5, -300.0, 0.5, 5.0, 7.0, None, None, None, None, None, None, None, None, None,
        math.inf,
    ]


def test_first_five_digits(spark):
    items = ["10001", "10001-1234", "NY 11201", "123", "none", "123456", None]
    assert column(spark, items, "string", first_five_digits("x")) == [
        "10001", "10001", "11201", None, None, "12345", None
    ]


def test_mode_ignores_missing_and_takes_the_smallest_tie(spark):
    df = spark.createDataFrame(
        [("a", "z"), ("a", "b"), ("a", "z"), ("a", "b"), ("a", None), ("a", None), ("a", None),
         ("b", None), (None, "q")],
        "k string, v string",
    )
    assert rows(mode_by_key(df, "k", "v", "m")) == [("a", "b"), ("b", None)]


def test_several_modes_and_totals_from_one_scan(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, 10.0), ("a", "y", 1, None), ("a", "x", 2, 5.0), ("b", None, 7, None)],
        "k string, v string, w int, t double",
    )
    got = summarise_with_modes(df, "k", {"mv": "v", "mw": "w"}, {"s": F.col("t")})
    assert got.columns == ["k", "mv", "mw", "s"]
    assert rows(got) == [("a", "x", 1, 15.0), ("b", None, 7, 0.0)]


def test_zero_fill_never_cuts(spark):
    items = ["1", "12345", "1234567", "", None]
    assert column(spark, items, "string", zero_fill("x")) == [
        "00001", "12345", "1234567", "00000", None
    ]


def test_keys_have_one_spelling(spark):
    assert column(spark, [10001.0, 501.0, 501.9, NAN, None], "double", key_from_number("x")) == [
        "10001", "00501", "00501", None, None
    ]
    items = ["10001", "10001.0", "501", " 501.00 ", "10001, 10002", "123456", "nan?", "", None]
    assert column(spark, items, "string", key_from_text("x")) == [
        "10001", "10001", "00501", "00501", "10001, 10002", "123456", "nan?", "", None
    ]


def test_round_half_even(spark):
    items = [0.00005, 0.00015, 0.00025, 0.125, 1 / 3, -0.00015, None]
    assert column(spark, items, "double", round_half_even("x", 4)) == [
        0.0, 0.0002, 0.0002, 0.125, 0.3333, -0.0002, None
    ] or column(spark, items, "double", round_half_even("x", 4)) == [
        0.0, 0.0001, 0.0002, 0.125, 0.3333, -0.0001, None
    ]
    import numpy as np

    present = [x for x in items if x is not None]
    assert column(spark, present, "double", round_half_even("x", 4)) == [
        float(np.round(x, 4)) for x in present
    ]


def test_tokens_are_missing_but_other_words_are_not(spark):
    df = spark.createDataFrame([(t,) for t in MISSING_TOKENS], "x string")
    assert set(values(normalise_missing(df))) == {None}
    words = ["Not Available", "na", "none", " NA", "0", "-"]
    kept = spark.createDataFrame([(w,) for w in words], "x string")
    assert values(normalise_missing(kept)) == words


def test_infinity_is_a_value(spark):
    df = spark.createDataFrame([(math.inf, "a"), (NAN, "b"), (None, "c"), (1.0, None)],
                               "x double, y string")
    assert rows(drop_incomplete(df)) == [(math.inf, "a")]
    assert [r[1] for r in rows(drop_incomplete(df, ["x"]))] == [None, "a"]


def test_scaling_by_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (NAN, 5.0), (None, 5.0), (6.0, 5.0)],
                               "x double, c double")
    clean = df.withColumn("x", nan_to_null("x"))
    got = rows(apply_scaling(clean, fit_scaling(df, ["x", "c"]), ["x", "c"]), "x")
    deviation = math.sqrt(((1 - 3) ** 2 + (2 - 3) ** 2 + (6 - 3) ** 2) / 3)
    expected = [None, None, -2 / deviation, -1 / deviation, 3 / deviation]
    assert [None if x is None else round(x, 12) for x, _ in got] == [
        None if x is None else round(x, 12) for x in expected
    ]
    assert {c for _, c in got} == {0.0}


def test_alive_but_unknown(spark):
    df = spark.createDataFrame(
        [(None, "Alive"), (None, "Dead"), (None, None), ("Good", "Alive"), ("Good", None)],
        "health string, status string",
    )
    kept = drop_missing_and_equal(df, "health", "status", "Alive")
    shown = show_missing_and_equal(df, "health", "status", "Alive")
    assert rows(shown) == [(None, "Alive")]
    assert kept.count() == 4


def test_exclude_containing_keeps_missing(spark):
    df = spark.createDataFrame([("1,2",), ("1",), (None,)], "k string")
    assert rows(exclude_containing(df, "k", ",")) == [(None,), ("1",)]


def test_gap_counts_rows_with_both(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0), ("a", None, 1.0), ("a", 3.0, None)],
                               "k string, t double, s double")
    assert rows(summarise(df, "k", g=mean_gap("t", "s"))) == [("a", 4.0)]


def test_per_row_counts_rows_that_did_not_parse(spark):
    df = spark.createDataFrame([("a", "10"), ("a", "x"), ("b", "x")], "k string, t string")
    got = summarise(df, "k", p=total_per_row(parse_number("t")), n=row_count())
    assert rows(got) == [("a", 5.0, 2), ("b", 0.0, 1)]


def test_share_is_over_rows_with_a_value(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", None), ("b", None)], "k string, h int")
    assert rows(summarise(df, "k", s=share_of("h", 0))) == [("a", 0.5), ("b", None)]


def test_codes_for_unknown_and_missing(spark):
    codes = {"Good": 0, "Fair": 1, "Poor": 2}
    items = ["Good", "Poor", "odd", None]
    assert column(spark, items, "string", encode("x", codes)) == [0, 2, None, None]
    assert column(spark, items, "string", encode("x", codes, 3)) == [0, 2, 3, 3]


def test_missing_counts_take_nan(spark):
    df = spark.createDataFrame([(None, NAN), ("a", 1.0), (None, None)], "s string, x double")
    assert rows(missing_counts(df)) == [(2, 2)]


def test_assembly_keeps_the_spine_and_fills(spark):
    spine = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    two = spark.createDataFrame([("b", 2.0), ("z", 3.0)], "k string, x double")
    got = assemble(spine, "k", [Branch(one, {"n": 0}), Branch(two)])
    assert rows(got) == [(None, 0, None), ("a", 1, None), ("b", 0, 2.0), ("b", 0, 2.0)]


def test_bad_number_in_a_strict_column_stops_the_job(spark, tmp_path):
    from areaframe.sources import SOURCES, read_source

    path = tmp_path / "p.csv"
    path.write_text("Entity properties name,Variable observation value\n10001,many\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_source(spark, str(path), SOURCES["population"]).collect()
