"""Registry of driver queries and the test-table inputs they share.

Role mapping (reference concept -> test table): payments -> lineitem joined
to orders (id o_custkey, from the earlier to the later of o_orderdate and
l_shipdate, amount l_extendedprice); filings -> orders; register -> customer; bills ->
lineitem by ship month. Money is exact fixed-point BIGINT
(``plans.panel.MONEY_SCALE``), converted to DOUBLE once at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.aggregates import int_div
from panelcraft.functions.scalar import parse_amount
from panelcraft.functions.scalar import to_fixed
from panelcraft.operators.impute import fill_global_mean
from panelcraft.plans.panel import to_money_fixed
from panelcraft.sources.io import read_parquet_table

# Fixed values of the test mapping: spine range, masked (target) quarter.
SPINE_LO, SPINE_HI = "1995-01-01", "2001-12-01"
TARGET_YEAR, TARGET_QUARTER = 2001, 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _fact_join_side(o: DataFrame) -> DataFrame:
    """Fact x fact join side: neither side has a size bound, so never broadcast; a shuffle merge
    join (AQE splits skewed keys) is also what this join is at full scale."""
    return o.hint("merge")


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_parquet_table(spark, d, name)


def payments(spark: SparkSession, d: str, as_recorded: bool = False) -> DataFrame:
    """Interval facts: one row per line item (id, start, end, fixed-point amount).

    The two dates of a test line are in no order, so the earlier one starts the
    interval. ``as_recorded`` keeps order date to ship date, half of them
    inverted, for the quarantine.
    """
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(_fact_join_side(o), li.l_orderkey == o.o_orderkey)
    return j.select(
        "l_orderkey",
        "l_linenumber",
        F.col("o_custkey").alias("id"),
        (F.col("o_orderdate") if as_recorded else F.least("o_orderdate", "l_shipdate")).alias("start"),
        (F.col("l_shipdate") if as_recorded else F.greatest("o_orderdate", "l_shipdate")).alias("end"),
        to_money_fixed("l_extendedprice").alias("amount"),
    )


# Oracle building blocks (DuckDB SQL text) ------------------------------------
def _sql_facts(start: str, end: str) -> str:
    return f"""
  SELECT l.l_orderkey, l.l_linenumber, o.o_custkey AS id,
         CAST(date_trunc('month', {start}) AS DATE) AS ms,
         CAST(date_trunc('month', {end}) AS DATE) AS me,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) * 1000000 AS amt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


SQL_FACTS = _sql_facts("least(o.o_orderdate, l.l_shipdate)", "greatest(o.o_orderdate, l.l_shipdate)")
SQL_FACTS_AS_RECORDED = _sql_facts("o.o_orderdate", "l.l_shipdate")
SQL_N = "((year(me) - year(ms)) * 12 + month(me) - month(ms) + 1)"


def sql_months(lo: str, hi: str) -> str:
    return f"CAST(unnest(generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 1 MONTH)) AS DATE)"


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings: one row per order (id, date, fixed-point price, priority code, status code)."""
    o = T(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderdate").alias("date"),
        to_money_fixed("o_totalprice").alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
        F.ascii("o_orderstatus").alias("status"),
    )


def capital_text(cents: F.Column) -> F.Column:
    """Register capital as text: 'X.YY万' when non-negative, '(X.YY)' (unparseable) when negative."""
    a = F.abs(cents)
    body = F.concat(int_div(a, F.lit(100)).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))
    return F.when(cents >= 0, F.concat(body, F.lit("万"))).otherwise(F.concat(F.lit("("), body, F.lit(")")))


def register(spark: SparkSession, d: str) -> DataFrame:
    """Register: id, capital text, capital parsed to cents (P4) with the global mean filled in."""
    c = T(spark, d, "customer")
    r = c.select(
        F.col("c_custkey").alias("id"),
        capital_text(to_fixed("c_acctbal")).alias("capital_text"),
        "c_mktsegment",
        "c_nationkey",
        "c_name",
    ).withColumn("capital", parse_amount("capital_text", scale=2))
    return fill_global_mean(r, ["capital"])


def bills(spark: SparkSession, d: str) -> DataFrame:
    """Bills: one row per line item dated by ship month (quantity, fixed-point price and net, two codes)."""
    li = T(spark, d, "lineitem")
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = li.join(_fact_join_side(o), li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("id"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        to_money_fixed("l_extendedprice").alias("price"),
        (to_fixed("l_extendedprice") * (F.lit(100) - to_fixed("l_discount")) * F.lit(10**4)).alias("net"),
        F.col("l_linenumber").alias("code_a"),
        F.col("l_returnflag").alias("code_b"),
    )


SQL_REGISTER_CTES = r"""
regt AS (SELECT c_custkey AS id, c_mktsegment, c_nationkey, c_name,
                CASE WHEN c >= 0 THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '万'
                     ELSE '(' || CAST(abs(c) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') || ')'
                END AS capital_text
         FROM (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer)),
regp AS (SELECT *, CASE WHEN regexp_matches(trim(replace(capital_text, '万', '')), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$')
                        THEN CAST(TRY_CAST(trim(replace(capital_text, '万', '')) AS DECIMAL(38,2)) * 100 AS BIGINT) END AS cap
         FROM regt),
reg AS (SELECT id, c_mktsegment, c_nationkey, c_name, capital_text,
               COALESCE(cap, (SELECT CAST(SUM(cap) // COUNT(cap) AS BIGINT) FROM regp)) AS capital FROM regp)
"""

SQL_BILLS = """
  SELECT o.o_custkey AS id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month,
         CAST(l.l_quantity AS BIGINT) AS qty,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) * 1000000 AS price,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT)) * 10000 AS net,
         l.l_linenumber AS code_a, l.l_returnflag AS code_b
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

SQL_FILINGS = """
  SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS price,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio, ascii(o_orderstatus) AS status
  FROM orders
"""
