"""Records as text: parsed with bad ones set aside, written, and accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.accounts import Accounts
from ..sources.ordered import file_numbers
from ..sources.rejects import SURPLUS_REASON, parse_lines, to_lines
from .registry import LABELLED, labelled_documents, query, table

# Orders spelled as records, with missing, broken, fractional and surplus fields among them; read by both engines.
FIELDS = {
    "k": "cast(o_orderkey as string)",
    "n": "case o_orderkey % 11 when 0 then 'NA' when 1 then concat(cast(o_custkey as string), '.5') when 2 then 'x' "
    "else cast(o_custkey as string) end",
    "x": "case o_orderkey % 7 when 0 then '' when 1 then '\"1,000\"' else cast(cast(floor(o_totalprice) as bigint) as string) end",
    "p": "case o_orderkey % 13 when 0 then concat(o_orderpriority, ',') else concat('\"', o_orderpriority, '\"') end",
}
RECORD = "concat(" + ", ',', ".join(FIELDS.values()) + ")"
SCHEMA = T.StructType([
    T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("p", T.StringType()),
])
SPELLED = RECORD.replace("as string", "as varchar")
GOOD = "o_orderkey % 13 <> 0 AND o_orderkey % 11 NOT IN (1, 2) AND o_orderkey % 7 <> 1"


def records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.expr(RECORD).alias("line"))


@query(
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS n, "
    f"CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice) END AS x, o_orderpriority AS p FROM orders WHERE {GOOD}"
)
def csv_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(records(spark, folder), "line", SCHEMA).rows


@query(
    f"SELECT {SPELLED} AS record, concat_ws('; ', CASE WHEN o_orderkey % 13 = 0 THEN '{SURPLUS_REASON}' END, "
    "CASE o_orderkey % 11 WHEN 1 THEN 'n is not whole' WHEN 2 THEN 'n is no number' END, "
    f"CASE WHEN o_orderkey % 7 = 1 THEN 'x is no number' END) AS reasons FROM orders WHERE NOT ({GOOD})"
)
def csv_rejected(spark: SparkSession, folder: str) -> DataFrame:
    rejected = parse_lines(records(spark, folder), "line", SCHEMA).rejected
    return rejected.select("record", F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "SELECT concat(cast(o_orderkey as varchar), ',', CASE WHEN o_orderstatus = 'F' THEN '' ELSE "
    "concat('\"', o_orderpriority, ', \"\"', o_orderstatus, '\"\"\"') END, ',', cast(o_custkey as varchar)) AS record FROM orders"
)
def csv_written(spark: SparkSession, folder: str) -> DataFrame:
    spelled = "case when o_orderstatus = 'F' then null else concat(o_orderpriority, ', \"', o_orderstatus, '\"') end"
    return to_lines(table(spark, folder, "orders").select("o_orderkey", F.expr(spelled).alias("p"), "o_custkey"))


@query(
    f"WITH {LABELLED} SELECT step, measure, CAST(value AS BIGINT) AS value FROM ("
    "SELECT 'no quality' AS step, unnest(['rows', 'dropped', 'missing_quality', 'missing_source']) AS measure, "
    "unnest([count(*), count(*) FILTER (quality IS NULL), count(*) FILTER (quality IS NULL), count(*) FILTER (source IS NULL)]) AS value FROM d "
    "UNION ALL SELECT 'foreign', unnest(['rows', 'dropped']), unnest([count(*), count(*) FILTER (lang IS DISTINCT FROM 'en')]) "
    "FROM d WHERE quality IS NOT NULL)"
)
def rows_accounted_for(spark: SparkSession, folder: str) -> DataFrame:
    """What two filters drop, seen while a count by language runs."""
    accounts = Accounts()
    judged = accounts.keep(labelled_documents(spark, folder), "no quality", F.col("quality").isNotNull(), ["quality", "source"])
    own = accounts.keep(judged, "foreign", F.col("lang") == "en")
    own.groupBy("source").count().write.format("noop").mode("overwrite").save()
    return accounts.table(spark)


@query(
    "WITH k AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderstatus, "
    "CAST(coalesce(sum(n) OVER (ORDER BY o_custkey, o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS INTEGER) "
    "AS file FROM k"
)
def ordered_file_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Which file of the ordered sink each key of all orders goes to."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    return file_numbers(orders, ["o_custkey", "o_orderstatus"], 500, "file").drop("_n")
