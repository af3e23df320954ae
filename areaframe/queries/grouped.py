"""Aggregates, pivots and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bucketize, ratio, round_half_even
from ..operators.aggregates import (
    contingency,
    contingency_shares,
    count_of,
    histogram,
    majority_group,
    mean,
    mean_gap,
    missing_counts,
    mode_by_key,
    rows,
    share_of,
    summarise,
    summarise_with_modes,
    top_column,
    total,
    total_over_total,
    total_per_row,
    value_counts,
)
from ..operators.filters import exclude_values, keep_equal
from ..operators.joins import (
    Branch,
    assemble,
    bridge_counts,
    inner_spine,
    left_onto,
    lookup_counts,
    outer_align,
)
from ..operators.projection import rename
from .registry import LABELLED, labelled_documents, query, table

CENTS = "round({0} * 100)::BIGINT"


def cents(column: str) -> Column:
    """Money as whole cents, so that sums are exact and the same in any order."""
    return F.rint(F.col(column) * 100).cast("bigint")


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
TYPE_GROUPS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 2, "PROMO": 3, "SMALL": 4}


@query(
    f"WITH t AS (SELECT o_custkey, sum({CENTS.format('o_totalprice')}) / 100.0::DOUBLE "
    "AS total_price FROM orders "
    "WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_orderstatus IS DISTINCT FROM 'P' "
    "AND o_custkey IS NOT NULL GROUP BY o_custkey) "
    "SELECT c_custkey, c_name, coalesce(total_price, 0) AS total_price "
    "FROM customer LEFT JOIN t ON c_custkey = o_custkey"
)
def filtered_sum_left_fill(spark: SparkSession, folder: str) -> DataFrame:
    orders = exclude_values(table(spark, folder, "orders"), "o_orderstatus", "F", "P")
    totals = summarise(
        rename(orders, {"o_custkey": "c_custkey"}),
        "c_custkey",
        total_price=total(cents("o_totalprice")) / 100.0,
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return left_onto(customers, totals, "c_custkey", {"total_price": 0.0})


@query(
    "SELECT o_custkey, round_even(10000 * (count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE "
    "/ count(o_orderstatus), 0) / 10000 AS finished_share FROM orders GROUP BY o_custkey"
)
def half_even_share(spark: SparkSession, folder: str) -> DataFrame:
    finished = ratio(count_of("o_orderstatus", "F"), F.count("o_orderstatus"))
    return summarise(
        table(spark, folder, "orders"),
        "o_custkey",
        finished_share=round_half_even(finished, 4),
    )


@query(
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey",
    name="inner_spine",
)
def inner_spine_rows(spark: SparkSession, folder: str) -> DataFrame:
    nations = inner_spine(
        "regionkey",
        rename(table(spark, folder, "nation"), {"n_regionkey": "regionkey"}),
        rename(table(spark, folder, "region"), {"r_regionkey": "regionkey"}),
    )
    customers = rename(table(spark, folder, "customer"), {"c_nationkey": "nationkey"})
    joined = inner_spine("nationkey", customers, rename(nations, {"n_nationkey": "nationkey"}))
    return joined.select("c_custkey", "n_name", "r_name")


@query(
    f"SELECT l_suppkey, sum({CENTS.format('l_extendedprice')})::DOUBLE / count(*) AS cents_per_row "
    "FROM lineitem GROUP BY l_suppkey"
)
def sum_per_row(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(
        table(spark, folder, "lineitem"),
        "l_suppkey",
        cents_per_row=total_per_row(cents("l_extendedprice")),
    )


@query(
    f"SELECT l_partkey, sum({CENTS.format('l_extendedprice')})::DOUBLE "
    "/ nullif(sum(l_quantity), 0) AS unit_cents, "
    f"sum({CENTS.format('l_tax')})::DOUBLE / nullif(sum({CENTS.format('l_discount')}), 0) "
    "AS tax_over_discount "
    "FROM lineitem GROUP BY l_partkey"
)
def sum_over_sum(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(
        table(spark, folder, "lineitem"),
        "l_partkey",
        unit_cents=total_over_total(cents("l_extendedprice"), "l_quantity"),
        tax_over_discount=total_over_total(cents("l_tax"), cents("l_discount")),
    )


@query(
    f"WITH t AS (SELECT o_custkey, sum({CENTS.format('o_totalprice')}) AS s FROM orders "
    "GROUP BY o_custkey) SELECT c_custkey, s::DOUBLE / nullif(c_acctbal, 0) AS cents_over_balance "
    "FROM customer LEFT JOIN t ON c_custkey = o_custkey"
)
def sum_per_spine_measure(spark: SparkSession, folder: str) -> DataFrame:
    orders = rename(table(spark, folder, "orders"), {"o_custkey": "c_custkey"})
    totals = summarise(orders, "c_custkey", price=total(cents("o_totalprice")))
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return left_onto(customers, totals, "c_custkey").select(
        "c_custkey", ratio("price", "c_acctbal").alias("cents_over_balance")
    )


@query(
    f"SELECT event_type, avg({CENTS.format('value')}) AS mean_cents FROM events GROUP BY event_type"
)
def mean_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(
        table(spark, folder, "events"), "event_type", mean_cents=mean(cents("value"))
    )


@query(
    f"SELECT l_suppkey, avg({CENTS.format('l_extendedprice')} - {CENTS.format('l_tax')}) AS mean_gap "
    "FROM lineitem GROUP BY l_suppkey"
)
def mean_gap_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(
        table(spark, folder, "lineitem"),
        "l_suppkey",
        mean_gap=mean_gap(cents("l_extendedprice"), cents("l_tax")),
    )


@query(
    f"SELECT p_brand, avg({CENTS.format('l_extendedprice')} - {CENTS.format('p_retailprice')}) AS mean_gap "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
)
def mean_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of one part are summed before the join, so that a part with a
    third of all rows is one row there; the gap is then taken on the sums."""
    items = rename(table(spark, folder, "lineitem"), {"l_partkey": "p_partkey"})
    per_part = summarise(items, "p_partkey", price=total(cents("l_extendedprice")), items=rows())
    priced = per_part.join(table(spark, folder, "part"), "p_partkey")
    gap = F.col("price") - F.col("items") * cents("p_retailprice")
    return summarise(
        priced, "p_brand", mean_gap=total_over_total(gap, "items")
    )


MODE_SQL = (
    "SELECT {key}, first({value} ORDER BY n DESC, {value}) AS {name} FROM ("
    "SELECT {key}, {value}, count(*) AS n FROM {table} GROUP BY {key}, {value}) "
    "WHERE {value} IS NOT NULL GROUP BY {key}"
)


@query(MODE_SQL.format(key="user_id", value="event_type", name="usual_event", table="events"), name="mode_by_key")
def mode_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return mode_by_key(table(spark, folder, "events"), "user_id", "event_type", "usual_event")


@query(
    "WITH f AS (" + MODE_SQL.format(
        key="l_suppkey", value="l_returnflag", name="usual_flag", table="lineitem"
    ) + "), s AS (" + MODE_SQL.format(
        key="l_suppkey", value="l_linenumber", name="usual_line", table="lineitem"
    ) + "), q AS (SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey) "
    "SELECT q.l_suppkey, usual_flag, usual_line, quantity "
    "FROM q JOIN f ON q.l_suppkey = f.l_suppkey JOIN s ON q.l_suppkey = s.l_suppkey"
)
def modes_with_totals(spark: SparkSession, folder: str) -> DataFrame:
    return summarise_with_modes(
        table(spark, folder, "lineitem"),
        "l_suppkey",
        modes={"usual_flag": "l_returnflag", "usual_line": "l_linenumber"},
        totals={"quantity": F.col("l_quantity")},
    )


@query(
    "SELECT p_brand, "
    + ", ".join(f"count(*) FILTER (WHERE p_type = '{t}') AS {t.lower()}" for t in PART_TYPES)
    + " FROM part GROUP BY p_brand",
    name="contingency",
)
def contingency_by_brand(spark: SparkSession, folder: str) -> DataFrame:
    names = [t.lower() for t in PART_TYPES]
    return contingency(table(spark, folder, "part"), "p_brand", "p_type", PART_TYPES, names)


@query(MODE_SQL.format(key="p_brand", value="p_type", name="top_type", table="part"))
def majority_column(spark: SparkSession, folder: str) -> DataFrame:
    counts = contingency(table(spark, folder, "part"), "p_brand", "p_type", PART_TYPES)
    return counts.select("p_brand", top_column(PART_TYPES, PART_TYPES).alias("top_type"))


@query(
    "SELECT p_brand, CASE top_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 2 "
    "WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 END AS type_group FROM ("
    + MODE_SQL.format(key="p_brand", value="p_type", name="top_type", table="part")
    + ")",
    name="majority_group",
)
def majority_group_code(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return majority_group(parts, "p_brand", "p_type", TYPE_GROUPS, "type_group")


@query(
    "SELECT o_orderstatus, count(*) AS count, CASE o_orderstatus WHEN 'F' THEN 'finished' "
    "WHEN 'O' THEN 'open' ELSE 'Unknown' END AS label FROM orders "
    "WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus ORDER BY o_orderstatus"
)
def histogram_labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = {"F": "finished", "O": "open"}
    return histogram(table(spark, folder, "orders"), "o_orderstatus", labels)


@query("SELECT source, count(*) AS documents FROM documents GROUP BY source")
def count_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return value_counts(table(spark, folder, "documents"), "source", "documents")


FLAG_SHARES = ", ".join(
    f"(count(*) FILTER (WHERE l_returnflag = '{f}'))::DOUBLE / count(l_returnflag) "
    f"AS share_{f.lower()}"
    for f in "ANR"
)


@query(
    f"SELECT l_suppkey, count(*) AS items, {FLAG_SHARES} FROM lineitem GROUP BY l_suppkey"
)
def shares_by_key(spark: SparkSession, folder: str) -> DataFrame:
    shares = {f"share_{f.lower()}": share_of("l_returnflag", f) for f in "ANR"}
    return summarise(table(spark, folder, "lineitem"), "l_suppkey", items=rows(), **shares)


@query(
    f"WITH {LABELLED} SELECT source, "
    "(count(*) FILTER (WHERE quality = 0))::DOUBLE / nullif(count(quality), 0) AS poor, "
    "(count(*) FILTER (WHERE quality = 1))::DOUBLE / nullif(count(quality), 0) AS good "
    "FROM d WHERE quality IS NOT NULL GROUP BY source"
)
def shares_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return contingency_shares(
        labelled_documents(spark, folder), "source", "quality", [0, 1], ["poor", "good"]
    )


@query(
    f"WITH {LABELLED} SELECT source, (count(*) FILTER (WHERE poor))::DOUBLE "
    "/ nullif(count(poor), 0) AS poor_share "
    "FROM (SELECT source, quality = 0 AS poor FROM d) GROUP BY source"
)
def flag_share(spark: SparkSession, folder: str) -> DataFrame:
    flagged = labelled_documents(spark, folder).withColumn("poor", F.col("quality") == 0)
    return summarise(flagged, "source", poor_share=share_of("poor", True))


@query(
    f"WITH {LABELLED} SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE {c} IS NULL) AS {c}"
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    )
    + " FROM d"
)
def missing_per_column(spark: SparkSession, folder: str) -> DataFrame:
    return missing_counts(labelled_documents(spark, folder))


@query(
    "WITH n AS (SELECT user_id, count(*) AS events FROM events GROUP BY user_id) "
    "SELECT c_custkey AS user_id, coalesce(events, 0) AS events "
    "FROM customer LEFT JOIN n ON c_custkey = user_id"
)
def count_lookup(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return lookup_counts(customers, table(spark, folder, "events"), "user_id", "events")


FANOUT_SQL = (
    "SELECT s_suppkey, count({what}) AS customers FROM customer "
    "JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal < 1000 GROUP BY s_suppkey"
)


def poor_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier").filter(F.col("s_acctbal") < 1000)
    return rename(suppliers, {"s_nationkey": "nationkey"})


@query(FANOUT_SQL.format(what="*"))
def fanout_count(spark: SparkSession, folder: str) -> DataFrame:
    customers = rename(table(spark, folder, "customer"), {"c_nationkey": "nationkey"})
    suppliers = poor_suppliers(spark, folder)
    return bridge_counts(customers, suppliers, "nationkey", "s_suppkey", "customers")


BRIDGE_SQL = (
    "SELECT l_suppkey, count({what}) AS events FROM events "
    "JOIN {bridge} ON user_id = l_partkey GROUP BY l_suppkey"
)


def events_and_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = rename(table(spark, folder, "events"), {"user_id": "l_partkey"})
    return items, table(spark, folder, "lineitem").select("l_partkey", "l_suppkey")


@query(BRIDGE_SQL.format(what="*", bridge="lineitem"))
def bridge_count(spark: SparkSession, folder: str) -> DataFrame:
    items, links = events_and_links(spark, folder)
    return bridge_counts(items, links, "l_partkey", "l_suppkey", "events")


@query(BRIDGE_SQL.format(what="DISTINCT event_id", bridge="lineitem"))
def bridge_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    items, links = events_and_links(spark, folder)
    return bridge_counts(items, links, "l_partkey", "l_suppkey", "events", distinct=True)


@query(
    "WITH c AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey), "
    "s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal < 1000 "
    "GROUP BY s_nationkey) SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, "
    "suppliers FROM c FULL JOIN s ON c_nationkey = s_nationkey",
    name="outer_align",
)
def outer_align_counts(spark: SparkSession, folder: str) -> DataFrame:
    customers = rename(table(spark, folder, "customer"), {"c_nationkey": "nationkey"})
    suppliers = poor_suppliers(spark, folder)
    return outer_align(
        "nationkey",
        value_counts(customers, "nationkey", "customers"),
        value_counts(suppliers, "nationkey", "suppliers"),
    )


@query(
    "WITH o AS (SELECT o_custkey, count(*) AS orders, "
    f"sum({CENTS.format('o_totalprice')}) / 100.0::DOUBLE AS price, "
    "(count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE / count(o_orderstatus) AS finished "
    f"FROM orders GROUP BY o_custkey), e AS (SELECT user_id, avg({CENTS.format('value')}) AS mean_cents FROM events "
    "GROUP BY user_id), p AS ("
    + MODE_SQL.format(
        key="o_custkey", value="o_orderpriority", name="usual_priority", table="orders"
    )
    + ") SELECT c_custkey, c_mktsegment, coalesce(orders, 0) AS orders, "
    "coalesce(price, 0) AS price, finished, usual_priority, mean_cents FROM customer LEFT JOIN o ON c_custkey = o_custkey "
    "LEFT JOIN p ON c_custkey = p.o_custkey LEFT JOIN e ON c_custkey = user_id"
)
def star_features(spark: SparkSession, folder: str) -> DataFrame:
    orders = rename(table(spark, folder, "orders"), {"o_custkey": "c_custkey"})
    events = rename(table(spark, folder, "events"), {"user_id": "c_custkey"})
    status = F.col("o_orderstatus")
    per_order = summarise_with_modes(
        orders,
        "c_custkey",
        modes={"usual_priority": "o_orderpriority"},
        totals={
            "orders": F.lit(1),
            "cents": cents("o_totalprice"),
            "done": (status == "F").cast("int"),
            "known": status.isNotNull().cast("int"),
        },
    )
    order_measures = per_order.select(
        "c_custkey",
        "orders",
        (F.col("cents") / 100.0).alias("price"),
        ratio("done", "known").alias("finished"),
        "usual_priority",
    )
    event_means = summarise(events, "c_custkey", mean_cents=mean(cents("value")))
    return assemble(
        table(spark, folder, "customer").select("c_custkey", "c_mktsegment"),
        "c_custkey",
        [Branch(order_measures, {"orders": 0, "price": 0.0}), Branch(event_means)],
    )


@query(
    "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS price, count(*) AS orders FROM orders "
    "WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) "
    "SELECT c_custkey, CASE WHEN price >= 500000 THEN 2 WHEN price >= 100000 THEN 1 ELSE 0 END "
    "AS price_group, coalesce(orders, 0) AS orders FROM customer "
    "LEFT JOIN t ON c_custkey = o_custkey"
)
def star_features_coded(spark: SparkSession, folder: str) -> DataFrame:
    urgent = keep_equal(table(spark, folder, "orders"), "o_orderpriority", "1-URGENT")
    measures = summarise(
        rename(urgent, {"o_custkey": "c_custkey"}),
        "c_custkey",
        price=total("o_totalprice"),
        orders=rows(),
    )
    customers = table(spark, folder, "customer").select("c_custkey")
    star = assemble(customers, "c_custkey", [Branch(measures, {"orders": 0})])
    return star.select(
        "c_custkey", bucketize("price", [100_000, 500_000]).alias("price_group"), "orders"
    )
