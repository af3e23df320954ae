"""Projections, filters, parsing, keys and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    as_text,
    bucketize,
    encode,
    first_five_digits,
    is_missing,
    key_from_number,
    key_from_text,
    parse_number,
    ratio,
    strip_prefix,
    tokens_to_null,
    zero_fill,
)
from ..operators.aggregates import summarise
from ..operators.filters import (
    between,
    drop_incomplete,
    drop_missing_and_equal,
    exclude_containing,
    exclude_values,
    keep_equal,
    keep_matching,
    show_missing_and_equal,
)
from ..operators.projection import (
    difference,
    drop_columns,
    percent_to_share,
    rename,
    select_columns,
    select_positions,
    set_names,
    shift,
)
from .registry import LABELLED, labelled_documents, query, table

EDGES = (50_000, 100_000, 150_000)


@query("SELECT p_brand, p_name, p_size FROM part")
def named_project(spark: SparkSession, folder: str) -> DataFrame:
    return select_columns(table(spark, folder, "part"), ["p_brand", "p_name", "p_size"])


@query("SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def positional_project(spark: SparkSession, folder: str) -> DataFrame:
    return select_positions(
        table(spark, folder, "orders"), [0, 2, 3], ["order_id", "status", "price"]
    )


@query("SELECT p_partkey AS part_id, p_brand AS brand, p_type FROM part")
def rename_and_drop(spark: SparkSession, folder: str) -> DataFrame:
    parts = rename(table(spark, folder, "part"), {"p_partkey": "part_id", "p_brand": "brand"})
    return drop_columns(parts, "p_name", "p_size", "p_retailprice")


@query("SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def rename_all(spark: SparkSession, folder: str) -> DataFrame:
    return set_names(table(spark, folder, "region"), ["region_id", "region_name"])


@query(
    "SELECT l_orderkey, l_linenumber, l_extendedprice - l_tax AS gap, l_linenumber - 1 AS line_index, "
    "l_quantity / 100.0::DOUBLE AS quantity_share FROM lineitem"
)
def column_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        difference("l_extendedprice", "l_tax").alias("gap"),
        shift("l_linenumber", -1).alias("line_index"),
        percent_to_share("l_quantity").alias("quantity_share"),
    )


@query(
    "SELECT s_suppkey, s_acctbal / nullif(s_nationkey, 0) AS balance_ratio FROM supplier"
)
def ratio_or_missing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        "s_suppkey", ratio("s_acctbal", "s_nationkey").alias("balance_ratio")
    )


@query(f"WITH {LABELLED} SELECT * FROM d WHERE quality IS DISTINCT FROM 0")
def exclude_keep_missing(spark: SparkSession, folder: str) -> DataFrame:
    return exclude_values(labelled_documents(spark, folder), "quality", 0)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def equality_filter(spark: SparkSession, folder: str) -> DataFrame:
    customers = keep_equal(table(spark, folder, "customer"), "c_mktsegment", "BUILDING")
    return customers.select("c_custkey", "c_name")


@query(f"WITH {LABELLED} SELECT * FROM d WHERE NOT (quality IS NULL AND lang = 'en')", name="drop_missing_and_equal")
def drop_missing_and_equal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return drop_missing_and_equal(labelled_documents(spark, folder), "quality", "lang", "en")


@query(f"WITH {LABELLED} SELECT * FROM d WHERE quality IS NULL AND lang = 'en'", name="show_missing_and_equal")
def show_missing_and_equal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return show_missing_and_equal(labelled_documents(spark, folder), "quality", "lang", "en")


@query(
    f"WITH {LABELLED} SELECT * FROM d WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL "
    "AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL"
)
def drop_any_missing(spark: SparkSession, folder: str) -> DataFrame:
    return drop_incomplete(labelled_documents(spark, folder))


@query(f"WITH {LABELLED} SELECT doc_id, toxic FROM d WHERE toxic IS NOT NULL")
def drop_subset_missing(spark: SparkSession, folder: str) -> DataFrame:
    documents = labelled_documents(spark, folder)
    return drop_incomplete(documents, ["toxic"]).select("doc_id", "toxic")


@query("SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'red')")
def exclude_substring(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return exclude_containing(parts, "p_name", "red")


@query(
    "SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE o_totalprice >= 100000 AND o_totalprice < 150000"
)
def range_filter(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.filter(between("o_totalprice", 100_000, 150_000))


@query(
    "SELECT c_custkey AS row_key, nullif(regexp_extract(c_name, '[0-9]{5}'), '') AS digits "
    "FROM customer UNION ALL "
    "SELECT n_nationkey AS row_key, nullif(regexp_extract(n_name, '[0-9]{5}'), '') AS digits "
    "FROM nation"
)
def digits_from_text(spark: SparkSession, folder: str) -> DataFrame:
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    named = customers.select("c_custkey", "c_name").toDF("row_key", "name").union(
        nations.select(F.col("n_nationkey").cast("bigint"), "n_name")
    )
    return named.select("row_key", first_five_digits("name").alias("digits"))


@query(
    "SELECT n_nationkey, cast(replace(n_name, 'NATION_', '') AS INTEGER) AS number FROM nation "
    "WHERE regexp_full_match(n_name, 'NATION_[0-9]+')"
)
def strip_prefix_cast(spark: SparkSession, folder: str) -> DataFrame:
    nations = keep_matching(table(spark, folder, "nation"), "n_name", "^NATION_[0-9]+$")
    return nations.select(
        "n_nationkey", strip_prefix("n_name", "NATION_").cast("int").alias("number")
    )


@query(
    "SELECT page_id, try_cast(regexp_extract(url, '([^/]*)$', 1) AS DOUBLE) AS number FROM pages"
)
def numeric_or_missing(spark: SparkSession, folder: str) -> DataFrame:
    last = F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, folder, "pages").select("page_id", parse_number(last).alias("number"))


@query(
    "SELECT p_brand, count(*) AS parts, avg(try_cast(p_name AS DOUBLE)) AS mean_name "
    "FROM part GROUP BY p_brand"
)
def numeric_all_missing(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(
        table(spark, folder, "part"),
        "p_brand",
        parts=F.count(F.lit(1)),
        mean_name=F.avg(parse_number("p_name")),
    )


PADDED = (
    "CASE WHEN length({0}) < 5 THEN lpad({0}, 5, '0') ELSE {0} END"
)


@query(
    "WITH k AS (SELECT c_custkey, cast(c_custkey AS VARCHAR) AS t FROM customer) SELECT c_custkey, "
    + PADDED.format("t")
    + " AS from_number, "
    + PADDED.format("t")
    + " AS from_text, t AS plain, "
    + PADDED.format("t || 'x'")
    + " AS filled FROM k"
)
def pad_key(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey").cast("double")
    return table(spark, folder, "customer").select(
        "c_custkey",
        key_from_number(key).alias("from_number"),
        key_from_text(key.cast("decimal(20,1)").cast("string")).alias("from_text"),
        as_text(key).alias("plain"),
        zero_fill(F.concat(as_text(key), F.lit("x"))).alias("filled"),
    )


@query(
    "SELECT event_id, CASE WHEN event_type IN ('error') THEN NULL ELSE event_type END AS kind, "
    "event_type = 'error' AS kind_missing FROM events"
)
def missing_tokens(spark: SparkSession, folder: str) -> DataFrame:
    spelled = F.replace("event_type", F.lit("error"), F.lit("N/A"))
    kind = tokens_to_null(spelled)
    return table(spark, folder, "events").select(
        "event_id", kind.alias("kind"), is_missing(kind).alias("kind_missing")
    )


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 "
    "WHEN o_totalprice >= 50000 THEN 1 ELSE 0 END AS price_group FROM orders",
    name="bucketize",
)
def bucketize_prices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", bucketize("o_totalprice", EDGES).alias("price_group")
    )


@query(
    f"WITH {LABELLED} SELECT doc_id, CASE WHEN quality >= 1 THEN 1 ELSE 0 END AS quality_group FROM d"
)
def bucketize_missing(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_documents(spark, folder).select(
        "doc_id", bucketize("quality", [1]).alias("quality_group")
    )


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS status_code, "
    "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 3 END AS status_or_three FROM orders"
)
def constant_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = {"F": 0, "O": 1}
    return table(spark, folder, "orders").select(
        "o_orderkey",
        encode("o_orderstatus", codes).alias("status_code"),
        encode("o_orderstatus", codes, 3).alias("status_or_three"),
    )
