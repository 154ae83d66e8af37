"""The transactions view over the given tables, and small helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PLACE = "-43.60e0 + cast({0} % 997 as double) / 997e0 * 0.25e0", "172.45e0 + cast({0} % 991 as double) / 991e0 * 0.35e0"
_TEXTS = {
    "furnishings": "case o_orderkey % 8 when 0 then 'Furnished' when 1 then 'UNFURNISHED' when 2 then 'Partially Furnished' when 3 then 'fully furnished' when 4 then null when 5 then ' ' when 6 then 'nill' else 'semi furnished' end",
    "pets": "case o_orderkey % 8 when 0 then 'Pets OK' when 1 then 'no' when 2 then 'Negotiable' when 3 then 'Pets negotiable' when 4 then null when 5 then '' when 6 then 'nil' else 'cats only' end",
    "garage": "case o_orderkey % 8 when 0 then 'Y' when 1 then 'no garage here' when 2 then 'None' when 3 then 'double' when 4 then null when 5 then ' ' when 6 then '0' else 'YES' end",
    "property_type": "case o_orderkey % 6 when 0 then 'Big Apartment' when 1 then 'unit 4' when 2 then 'Town House' when 3 then 'HOUSE' when 4 then null else 'Studio' end",
    "price_text": "concat('$', cast(cast(floor(o_totalprice) as bigint) as string))",
    "street": "case o_orderkey % 5 when 0 then concat(cast(o_orderkey % 9 + 1 as string), '/', cast(o_custkey as string), ' Foo St') when 1 then concat('Unit 3 ', cast(o_custkey as string), 'A bar rd (rear)') when 2 then concat(cast(o_custkey as string), ' Long View Ave.,') when 3 then 'PO Box 17' else null end",
}
_COLS = f"""o_orderkey AS key, cast(o_orderdate as date) AS date, o_totalprice AS price, cast(substr(o_orderpriority, 1, 1) as int) AS bed,
  n_name AS suburb, c_mktsegment AS agency, o_custkey AS owner, c_acctbal AS land_value, 1900 + o_custkey % 126 AS year_built,
  {_PLACE[0].format("o_custkey")} AS lat, {_PLACE[1].format("o_custkey")} AS lon, {", ".join(f"{v} AS {k}" for k, v in _TEXTS.items())}"""
_FROM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_LINES = "SELECT l_orderkey, sum(l_quantity) AS floor_size, count(*) AS bath, sum(l_extendedprice) AS capital_value FROM lineitem GROUP BY l_orderkey"

TX = f"tx AS (SELECT {_COLS} {_FROM})"
TXL = f"tx AS (SELECT {_COLS}, floor_size, bath, capital_value {_FROM} LEFT JOIN ({_LINES}) AS lines ON l_orderkey = o_orderkey)"
_CATEGORY = "case s_suppkey % 5 when 0 then 'CBD' when 1 then 'PARK' when 2 then 'SCHOOL_HIGH' when 3 then 'SCHOOL_PRIMARY' else 'SCHOOL_INTERMEDIATE' end"
POIS = f"pois AS (SELECT s_suppkey AS poi, s_name AS name, {_CATEGORY} AS category, {_PLACE[0].format('s_suppkey')} AS latitude, {_PLACE[1].format('s_suppkey')} AS longitude FROM supplier)"
CATEGORIES = ["CBD", "PARK", "SCHOOL_HIGH", "SCHOOL_PRIMARY", "SCHOOL_INTERMEDIATE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    """One row for each order: dated, priced, located; lines adds sizes from lineitem (null without lines)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any size
    out = o.selectExpr("o_orderkey", *[c.strip() for c in _split(_COLS)])
    if lines:
        sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("floor_size"), F.count("*").alias("bath"), F.sum("l_extendedprice").alias("capital_value"))
        out = out.join(sums, F.col("key") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return out.drop("o_orderkey")


def _split(cols: str) -> list[str]:
    """Select list cut at its outer commas."""
    out, depth, quote, start = [], 0, False, 0
    for i, ch in enumerate(cols):
        quote ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and not depth and not quote:
            out.append(cols[start:i])
            start = i + 1
    return [*out, cols[start:]]


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS poi", "s_name AS name", f"{_CATEGORY} AS category", f"{_PLACE[0].format('s_suppkey')} AS latitude", f"{_PLACE[1].format('s_suppkey')} AS longitude")


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under name, with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rnd(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, cols: list[str], n: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c in cols})
