"""Panel queries: interval proration, spine, monthly and quarterly panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.operators import interval as iv
from panelcraft.operators import spine as sp
from panelcraft.operators.monthly import PointFacts
from panelcraft.operators.monthly import monthly_panel
from panelcraft.plans.inputs import SPINE_HI
from panelcraft.plans.inputs import SPINE_LO
from panelcraft.plans.inputs import SQL_FACTS
from panelcraft.plans.inputs import SQL_FACTS_AS_RECORDED
from panelcraft.plans.inputs import SQL_FILINGS
from panelcraft.plans.inputs import SQL_N
from panelcraft.plans.inputs import TARGET_QUARTER
from panelcraft.plans.inputs import TARGET_YEAR
from panelcraft.plans.inputs import filings
from panelcraft.plans.inputs import payments
from panelcraft.plans.inputs import query
from panelcraft.plans.inputs import sql_months
from panelcraft.plans.panel import from_fixed
from panelcraft.plans.panel import quarterly_panel


# -------------------------------------------------------------------- flagship
SQL_QUARTERLY = f"""
WITH f AS ({SQL_FACTS}),
ids AS (SELECT DISTINCT id FROM f WHERE id IS NOT NULL),
v AS (SELECT id, ms, me, amt // {SQL_N} AS rate FROM f WHERE ms <= me),
e AS (SELECT id, rate, CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month FROM v),
m AS (SELECT id, month, CAST(SUM(rate) AS BIGINT) AS y FROM e GROUP BY id, month),
s AS (SELECT id, {sql_months(SPINE_LO, SPINE_HI)} AS month FROM ids),
p AS (SELECT s.id, CAST(year(s.month) AS INTEGER) AS year, CAST(quarter(s.month) AS INTEGER) AS quarter,
             CASE WHEN year(s.month) = {TARGET_YEAR} AND quarter(s.month) = {TARGET_QUARTER} THEN NULL ELSE m.y END AS y
      FROM s LEFT JOIN m ON s.id = m.id AND s.month = m.month),
fl AS (SELECT id, year, quarter,
              COALESCE(y, CAST(SUM(y) OVER (PARTITION BY id) // COUNT(y) OVER (PARTITION BY id) AS BIGINT)) AS y
       FROM p),
q AS (SELECT id, year, quarter, CAST(COALESCE(SUM(y), 0) AS BIGINT) AS y FROM fl GROUP BY id, year, quarter)
SELECT CAST(id AS VARCHAR) || CAST(year AS VARCHAR) || lpad(CAST(quarter AS VARCHAR), 2, '0') AS sid,
       id, year, quarter,
       y / 1e8 AS y,
       CAST(SUM(y) OVER (PARTITION BY id, quarter) // COUNT(y) OVER (PARTITION BY id, quarter) AS BIGINT) / 1e8 AS y_avg,
       CAST(SUM(y) OVER (PARTITION BY id, year) // COUNT(y) OVER (PARTITION BY id, year) AS BIGINT) / 1e8 AS year_y_avg
FROM q
"""


@query("quarterly_panel", SQL_QUARTERLY)
def q_quarterly_panel(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: prorated quarterly revenue per customer, gaps and the masked quarter imputed,
    with seasonal (id, quarter) and yearly (id, year) means."""
    p = quarterly_panel(
        payments(spark, d),
        id_col="id",
        start="start",
        end="end",
        amount="amount",
        lo=SPINE_LO,
        hi=SPINE_HI,
        mask=(TARGET_YEAR, TARGET_QUARTER),
    )
    return p.select(
        "sid",
        "id",
        "year",
        "quarter",
        from_fixed("y").alias("y"),
        from_fixed("y_avg").alias("y_avg"),
        from_fixed("year_y_avg").alias("year_y_avg"),
    )


# ------------------------------------------------------------ J1 J2 A1 / A12
SQL_INTERVAL_MONTHLY = f"""
WITH f AS ({SQL_FACTS}),
v AS (SELECT id, ms, me, amt // {SQL_N} AS rate FROM f WHERE ms <= me AND id IS NOT NULL),
e AS (SELECT id, rate, CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month FROM v)
SELECT id, month, CAST(SUM(rate) AS BIGINT) / 1e8 AS amount, COUNT(*) AS n_intervals
FROM e GROUP BY id, month
"""


@query("interval_monthly_sum", SQL_INTERVAL_MONTHLY)
def q_interval_monthly_sum(spark: SparkSession, d: str) -> DataFrame:
    """Every payment line spread over the months it covers, summed per (id, month)."""
    m = iv.monthly_totals(payments(spark, d), id_col="id", start="start", end="end", amount="amount")
    return m.select("id", "month", from_fixed("amount").alias("amount"), "n_intervals")


SQL_EXPLODED = f"""
WITH f AS ({SQL_FACTS}),
v AS (SELECT l_orderkey, l_linenumber, id, ms, me, CAST({SQL_N} AS INTEGER) AS n_months, amt // {SQL_N} AS rate
      FROM f WHERE ms <= me)
SELECT l_orderkey, l_linenumber, id, n_months, rate / 1e8 AS rate,
       CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month
FROM v
"""


@query("interval_expand", SQL_EXPLODED)
def q_interval_expand(spark: SparkSession, d: str) -> DataFrame:
    """J1 literal form: one row per (line, covered month) with its prorated share."""
    valid, _ = iv.split_intervals(payments(spark, d), "start", "end")
    p = iv.prorate(valid, "amount")
    e = iv.expand_months(p)
    return e.select("l_orderkey", "l_linenumber", "id", "n_months", from_fixed("rate").alias("rate"), "month")


SQL_QUARANTINE = f"""
WITH f AS ({SQL_FACTS_AS_RECORDED})
SELECT l_orderkey, l_linenumber, id, ms, me, amt / 1e8 AS amount,
       CASE WHEN ms IS NULL THEN 'null_start' WHEN me IS NULL THEN 'null_end' ELSE 'inverted' END AS reason
FROM f WHERE ms IS NULL OR me IS NULL OR ms > me
"""


@query("interval_quarantine", SQL_QUARANTINE)
def q_interval_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that cannot be expanded, with the reason."""
    _, bad = iv.split_intervals(payments(spark, d, as_recorded=True), "start", "end")
    return bad.select("l_orderkey", "l_linenumber", "id", "ms", "me", from_fixed("amount").alias("amount"), "reason")


SQL_AUDIT = f"""
WITH f AS ({SQL_FACTS_AS_RECORDED}),
v AS (SELECT *, {SQL_N} AS n, amt // {SQL_N} AS rate FROM f WHERE ms <= me)
SELECT (SELECT COUNT(DISTINCT id) FROM f) AS n_ids,
       (SELECT COUNT(*) FROM f) AS n_rows,
       COUNT(*) AS n_valid,
       (SELECT COUNT(*) FROM f) - COUNT(*) AS n_quarantined,
       CAST(SUM(n) AS BIGINT) AS n_month_rows,
       CAST(CAST(SUM(amt) AS VARCHAR) AS DOUBLE) / 1e8 AS total_amount,
       CAST(CAST(SUM(n * rate) AS VARCHAR) AS DOUBLE) / 1e8 AS total_prorated
FROM v
"""


@query("interval_audit", SQL_AUDIT)
def q_interval_audit(spark: SparkSession, d: str) -> DataFrame:
    """Shape and conservation audit of the proration (one row)."""
    f = iv.floor_interval(payments(spark, d, as_recorded=True), "start", "end")
    ok = iv.quarantine_reason(F.col("ms"), F.col("me")).isNull()
    n = iv.month_count(F.col("ms"), F.col("me"))
    rate = iv.prorate_expr(F.col("amount"), n, True)
    return f.agg(
        F.count_distinct("id").alias("n_ids"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(ok, 1)).alias("n_valid"),
        F.count(F.when(~ok, 1)).alias("n_quarantined"),
        F.sum(F.when(ok, n)).cast("bigint").alias("n_month_rows"),
        from_fixed(F.sum(F.when(ok, F.col("amount")).cast("decimal(38,0)"))).alias("total_amount"),
        from_fixed(F.sum(F.when(ok, n * rate).cast("decimal(38,0)"))).alias("total_prorated"),
    )


SQL_COVERAGE = f"""
WITH f AS ({SQL_FACTS})
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (ms IS NULL OR me IS NULL OR ms > me) AS n_quarantined,
       COUNT(*) FILTER (ms < DATE '{SPINE_LO}' OR me >= DATE '{SPINE_HI}' + INTERVAL 1 MONTH) AS n_clipped
FROM f
"""


@query("interval_coverage", SQL_COVERAGE)
def q_interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many payments the panels get, and how many lose months to the quarantine or the spine's ends."""
    f = iv.floor_interval(payments(spark, d), "start", "end")
    bad = iv.quarantine_reason(F.col("ms"), F.col("me")).isNotNull()
    end = F.add_months(F.to_date(F.lit(SPINE_HI)), 1)
    clipped = (F.col("ms") < F.to_date(F.lit(SPINE_LO))) | (F.col("me") >= end)
    return f.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(bad, 1)).alias("n_quarantined"),
        F.count(F.when(clipped, 1)).alias("n_clipped"),
    )


# ------------------------------------------------------------------ J3 J4 J5
SQL_SPINE = f"""
WITH f AS ({SQL_FACTS})
SELECT id, {sql_months(SPINE_LO, SPINE_HI)} AS month FROM (SELECT DISTINCT id FROM f WHERE id IS NOT NULL)
"""


@query("calendar_spine", SQL_SPINE)
def q_calendar_spine(spark: SparkSession, d: str) -> DataFrame:
    """Every payer id x every month of the spine range."""
    ids = sp.distinct_ids(payments(spark, d), "id")
    return sp.calendar_spine(ids, "id", SPINE_LO, SPINE_HI)


SQL_MONTHLY_PANEL = f"""
WITH f AS ({SQL_FACTS}),
ids AS (SELECT DISTINCT id FROM f WHERE id IS NOT NULL),
v AS (SELECT id, ms, me, amt // {SQL_N} AS rate FROM f WHERE ms <= me),
e AS (SELECT id, rate, CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month FROM v),
m AS (SELECT id, month, CAST(SUM(rate) AS BIGINT) AS y FROM e GROUP BY id, month),
fi AS ({SQL_FILINGS}),
fm AS (SELECT id, month, CAST(SUM(price) // COUNT(price) AS BIGINT) AS month_amount, MAX(prio) AS priority_max,
              MAX(status) AS status_max, COUNT(prio) AS n_filings
       FROM fi WHERE id IS NOT NULL AND month IS NOT NULL GROUP BY id, month),
s AS (SELECT id, {sql_months(SPINE_LO, SPINE_HI)} AS month FROM ids)
SELECT s.id, s.month, m.y / 1e8 AS y, fm.month_amount / 1e8 AS month_amount, fm.priority_max, fm.status_max,
       fm.n_filings
FROM s LEFT JOIN m ON s.id = m.id AND s.month = m.month
       LEFT JOIN fm ON s.id = fm.id AND s.month = fm.month
"""


@query("monthly_panel", SQL_MONTHLY_PANEL)
def q_monthly_panel(spark: SparkSession, d: str) -> DataFrame:
    """J5 + A2: the spine left-joined with monthly payments and monthly filing aggregates."""
    pts = PointFacts(
        filings(spark, d),
        "id",
        "date",
        {
            "month_amount": ("mean", "price"),
            "priority_max": ("max", "prio"),
            "status_max": ("max", "status"),
            "n_filings": ("count", "prio"),
        },
    )
    m = monthly_panel(
        payments(spark, d),
        id_col="id",
        start="start",
        end="end",
        amount="amount",
        lo=SPINE_LO,
        hi=SPINE_HI,
        value="y",
        points=[pts],
    )
    return m.select(
        "id",
        "month",
        from_fixed("y").alias("y"),
        from_fixed("month_amount").alias("month_amount"),
        "priority_max",
        "status_max",
        "n_filings",
    )
