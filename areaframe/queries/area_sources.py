"""The sources of the area jobs, derived from the given tables.

One area is one customer. Each source is a plain projection of a whole table (or
a count by customer), written as expressions that Spark and a SQL oracle both
read, with missing values, unparsable numbers, odd keys and ties among them. All
measures are whole or half numbers, so that sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

NUMBER = "cast(cast(floor({0}) as bigint) as string)"
CUSTOMER_KEY = "cast(c_custkey as string)"
PADDED_KEY = f"lpad({CUSTOMER_KEY}, 5, '0')"
PRICE = NUMBER.format("o_totalprice")

# Source: base table, then column by column its expression.
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "income": (
        "customer",
        {
            "zipcode": PADDED_KEY,
            "median_income": "case when c_nationkey = 3 then null else c_acctbal * 20 end",
        },
    ),
    "population": (
        "orders",
        {
            "zipcode": "cast(o_custkey as string)",
            "population": "cast(greatest(count(*) - 5, 0) * 100 as bigint)",
        },
    ),
    "heat_index": (
        "customer",
        {
            "zipcode": f"concat({CUSTOMER_KEY}, '.0')",
            "hvi": "case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 "
            "when 'FURNITURE' then 3 when 'HOUSEHOLD' then 4 else 5 end",
        },
    ),
    "greenstreets": (
        "orders",
        {
            "status": "case o_orderstatus when 'F' then 'Retired' when 'P' then null "
            "else 'Active' end",
            "zipcode": "case o_orderpriority when '5-LOW' then "
            "concat(cast(o_custkey as string), ',', cast(o_orderkey as string)) "
            "when '4-NOT SPECIFIED' then null else cast(o_custkey as string) end",
            "acres": "case when o_orderpriority = '3-MEDIUM' then null else cast(floor(o_totalprice) as double) end",
        },
    ),
    "energy": (
        "orders",
        {
            "year": "cast(extract(year from o_orderdate) as int)",
            "postal_code": "case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' "
            "then 'none' else concat(lpad(cast(o_custkey as string), 5, '0'), '-0001') end",
            "score": f"case when o_orderstatus = 'P' then 'Not Available' else {PRICE} end",
            "target_score": f"case when o_orderstatus = 'O' then '1d' else "
            f"{NUMBER.format('o_totalprice / 3')} end",
            "electricity": f"case when o_orderpriority = '5-LOW' then null else {PRICE} end",
            "green_power": f"case when o_orderpriority = '1-URGENT' then '1,000' else {PRICE} end",
            "natural_gas": f"concat(' ', {NUMBER.format('o_totalprice / 7')}, '.5 ')",
        },
    ),
    "parcels": (
        "lineitem",
        {
            "postcode": "case when l_tax = 0 then null else cast(l_partkey as double) end",
            "block": "cast(l_suppkey as string)",
            "borough": "case l_returnflag when 'A' then 'MN' when 'N' then 'BX' else 'BK' end",
            "landuse": "case when l_discount = 0 then null else lpad(cast(l_linenumber + "
            "case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end as string), 2, '0') end",
            "numbldgs": "cast(l_linenumber - 1 as double)",
            "unitsres": "l_quantity",
            "unitstotal": "l_quantity + l_linenumber",
            "bldgarea": "cast(floor(l_extendedprice) as double)",
        },
    ),
    "gardens": (
        "events",
        {"block": "case when event_type = 'error' then null else cast(user_id as string) end"},
    ),
    "trees": (
        "lineitem",
        {
            "tree_id": "cast(l_orderkey as string)",
            "status": "case when l_returnflag = 'R' then 'Dead' when l_discount = 0.1 then null "
            "else 'Alive' end",
            "health": "case when l_returnflag = 'R' then null when l_linenumber <= 3 then 'Good' "
            "when l_linenumber <= 5 then 'Fair' when l_linenumber = 6 then 'Poor' "
            "when l_linestatus = 'O' then 'odd' else null end",
            "postcode": "lpad(cast(l_partkey as string), 5, '0')",
            "nta_name": "case when l_linenumber = 1 then null else "
            "concat('area ', cast(l_linenumber as string)) end",
        },
    ),
    "college": (
        "customer",
        {"zipcode": CUSTOMER_KEY, "college_percent": "c_acctbal / 100"},
    ),
    "justice": (
        "customer",
        {
            "zipcode": CUSTOMER_KEY,
            "white_percent": f"case when c_nationkey = 7 then '*' else "
            f"{NUMBER.format('c_acctbal')} end",
            "black_percent": NUMBER.format("c_acctbal / 2"),
            "jail_admissions_per_100k": f"case when c_nationkey = 11 then '1,234' else "
            f"{NUMBER.format('abs(c_acctbal)')} end",
        },
    ),
    "poverty": (
        "customer",
        {
            "name": "case when c_nationkey = 19 then 'Geographic Area Name' else "
            f"concat('ZCTA5 ', lpad({CUSTOMER_KEY}, 5, '0')) end",
            "estimate": f"case when c_nationkey = 19 then 'Estimate' else "
            f"{NUMBER.format('abs(c_acctbal)')} end",
            "total": f"case when c_nationkey = 19 then 'Total' else "
            f"{NUMBER.format('abs(c_acctbal) * 3 + c_nationkey')} end",
        },
    ),
}
GROUPED = {"population": "o_custkey"}


def derived_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {base: table(spark, folder, base) for base in {base for base, _ in DERIVED.values()}}

    def frame(name: str) -> DataFrame:
        base, columns = DERIVED[name]
        rows = tables[base]
        expressions = [f"{expression} as {column}" for column, expression in columns.items()]
        if name in GROUPED:
            grouped = rows.groupBy(GROUPED[name]).agg(
                *[F.expr(e).alias(c) for c, e in columns.items() if c != "zipcode"]
            )
            return grouped.selectExpr(
                f"{columns['zipcode']} as zipcode", *[c for c in columns if c != "zipcode"]
            )
        return rows.selectExpr(*expressions)

    return {name: frame(name) for name in DERIVED}


def source_sql(*names: str) -> str:
    """The derived sources as common table expressions."""

    def one(name: str) -> str:
        base, columns = DERIVED[name]
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        group = f" GROUP BY {GROUPED[name]}" if name in GROUPED else ""
        return f"{name} AS (SELECT {listed} FROM {base}{group})"

    return ", ".join(one(name) for name in names)
