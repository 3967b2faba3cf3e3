"""Sources/sinks round trips and the remaining reference variants."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.types import IntegerType
from pyspark.sql.types import LongType
from pyspark.sql.types import StringType
from pyspark.sql.types import StructField
from pyspark.sql.types import StructType

from panelcraft.functions.scalar import row_key
from panelcraft.functions.scalar import with_calendar_parts
from panelcraft.operators.features import leave_one_out_mean
from panelcraft.operators.impute import fill_group_mean
from panelcraft.operators.impute import impute_mean
from panelcraft.operators.impute import replace_tokens
from panelcraft.operators.linear import cross_validate_ridge
from panelcraft.operators.linear import fold_moments
from panelcraft.operators.monthly import monthly_panel
from panelcraft.operators.ordering import slice_rows
from panelcraft.operators.rollup import rollup_period
from panelcraft.operators.split import kfold_ids
from panelcraft.plans.inputs import SPINE_HI
from panelcraft.plans.inputs import SPINE_LO
from panelcraft.plans.inputs import SQL_FACTS
from panelcraft.plans.inputs import SQL_N
from panelcraft.plans.inputs import SQL_REGISTER_CTES
from panelcraft.plans.inputs import TARGET_QUARTER
from panelcraft.plans.inputs import TARGET_YEAR
from panelcraft.plans.inputs import T
from panelcraft.plans.inputs import payments
from panelcraft.plans.inputs import query
from panelcraft.plans.inputs import register
from panelcraft.plans.inputs import sql_months
from panelcraft.plans.panel import from_fixed
from panelcraft.plans.q_features import SQL_HOST_PANEL
from panelcraft.plans.q_features import q_host_panel
from panelcraft.plans import q_model as m
from panelcraft.plans.queries import SQL_QUARTERLY
from panelcraft.plans.queries import q_quarterly_panel
from panelcraft.session import scratch_table_dir
from panelcraft.sources.io import read_registered
from panelcraft.sources.io import read_table
from panelcraft.sources.io import register_table
from panelcraft.sources.io import rename
from panelcraft.sources.io import skip_extra_header
from panelcraft.sources.io import write_stage

# Raw header names of the exported register, and the extra header line the raw files carry.
RAW_HEADERS = {"c_custkey": "Company ID", "c_nationkey": "Region code", "c_acctbal": "Capital", "c_mktsegment": "Industry"}
NAMESPACE = "panel_tables"


# ------------------------------------------------------------------ S1-S3 S6
@query("raw_csv_roundtrip", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_raw_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """S6 + S1 + S3 + S2: export the register as raw CSV (raw headers, an extra header line as the
    first data row), read it back with an explicit schema, drop the extra header, rename to short names."""
    base = scratch_table_dir(spark, "raw_csv")
    c = T(spark, d, "customer").select(*RAW_HEADERS)
    as_text = c.select(*[F.col(k).cast("string").alias(v) for k, v in RAW_HEADERS.items()])
    extra = spark.createDataFrame([tuple(RAW_HEADERS)], [*RAW_HEADERS.values()])  # the English header line
    raw = extra.unionByName(as_text)
    raw.write.mode("overwrite").option("header", True).csv(os.path.join(base, "register"))
    schema = StructType(
        [
            StructField("Company ID", StringType()),
            StructField("Region code", StringType()),
            StructField("Capital", StringType()),
            StructField("Industry", StringType()),
        ]
    )
    back = read_table(spark, os.path.join(base, "register"), schema)
    back = skip_extra_header(back, {"Company ID": "c_custkey", "Region code": "c_nationkey"})
    back = rename(back, {v: k for k, v in RAW_HEADERS.items()})
    typed = back.select(
        F.col("c_custkey").cast(LongType()).alias("c_custkey"),
        F.col("c_nationkey").cast(IntegerType()).alias("c_nationkey"),
        F.col("c_acctbal").cast(DoubleType()).alias("c_acctbal"),
        "c_mktsegment",
    )
    return write_stage(typed, os.path.join(base, "stage"))


# ---------------------------------------------------------------------- S7 S8
@query("catalog_roundtrip", SQL_HOST_PANEL)
def q_catalog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """S7 + S8: the host panel registered as a named table (replaced if present) and read back by name."""
    loc = scratch_table_dir(spark, "catalog")
    register_table(q_host_panel(spark, d), "host_panel", NAMESPACE, replace=True, location=loc)
    return read_registered(spark, "host_panel", NAMESPACE)


# ------------------------------------------------------------------------- W4
SQL_LOO = f"""
WITH g AS ({SQL_QUARTERLY}),
q AS (SELECT sid, id, year, quarter, CAST(round(y * 1e8) AS BIGINT) AS y FROM g)
SELECT sid, y / 1e8 AS y,
       CAST(CASE WHEN COUNT(y) OVER (PARTITION BY id, quarter) - 1 > 0
                 THEN (SUM(y) OVER (PARTITION BY id, quarter) - y) // (COUNT(y) OVER (PARTITION BY id, quarter) - 1) END
            AS BIGINT) / 1e8 AS y_avg_loo,
       CAST(CASE WHEN COUNT(y) OVER (PARTITION BY id, year) - 1 > 0
                 THEN (SUM(y) OVER (PARTITION BY id, year) - y) // (COUNT(y) OVER (PARTITION BY id, year) - 1) END
            AS BIGINT) / 1e8 AS year_y_avg_loo
FROM q
"""


@query("leave_one_out_means", SQL_LOO)
def q_leave_one_out_means(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal and yearly means that exclude the row's own label (no leakage)."""
    from panelcraft.plans.panel import quarterly_panel

    p = quarterly_panel(
        payments(spark, d), id_col="id", start="start", end="end", amount="amount", lo=SPINE_LO, hi=SPINE_HI,
        mask=(TARGET_YEAR, TARGET_QUARTER),
    )
    p = leave_one_out_mean(p, {"y_avg_loo": ("y", ["id", "quarter"]), "year_y_avg_loo": ("y", ["id", "year"])})
    return p.select("sid", from_fixed("y").alias("y"), from_fixed("y_avg_loo").alias("y_avg_loo"),
                    from_fixed("year_y_avg_loo").alias("year_y_avg_loo"))


# ------------------------------------------------------------------------- J7
SQL_LEGACY = f"""
WITH f AS ({SQL_FACTS}),
ids AS (SELECT DISTINCT id FROM f WHERE id IS NOT NULL),
v AS (SELECT id, ms, me, amt // {SQL_N} AS rate FROM f WHERE ms <= me),
e AS (SELECT id, rate, CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month FROM v),
m AS (SELECT id, month, CAST(SUM(rate) AS BIGINT) AS y FROM e GROUP BY id, month),
s AS (SELECT id, {sql_months(SPINE_LO, SPINE_HI)} AS month FROM ids),
{SQL_REGISTER_CTES},
p AS (SELECT s.id, CAST(year(s.month) AS INTEGER) AS year, CAST(quarter(s.month) AS INTEGER) AS quarter, m.y, reg.capital
      FROM s LEFT JOIN m ON s.id = m.id AND s.month = m.month LEFT JOIN reg ON s.id = reg.id),
fl AS (SELECT id, year, quarter, capital,
              COALESCE(y, CAST(SUM(y) OVER (PARTITION BY id) // COUNT(y) OVER (PARTITION BY id) AS BIGINT)) AS y FROM p)
SELECT {"CAST(id AS VARCHAR) || CAST(year AS VARCHAR) || lpad(CAST(quarter AS VARCHAR), 2, '0')"} AS sid,
       CAST(COALESCE(SUM(y), 0) AS BIGINT) / 1e8 AS y, CAST(COALESCE(SUM(capital), 0) AS BIGINT) / 1e2 AS capital
FROM fl GROUP BY id, year, quarter
"""


@query("legacy_join_order", SQL_LEGACY)
def q_legacy_join_order(spark: SparkSession, d: str) -> DataFrame:
    """The legacy order (register joined to the monthly spine before the roll-up), whose
    quarterly roll-up sums the static capital three times: kept as a documented quirk."""
    m = monthly_panel(payments(spark, d), lo=SPINE_LO, hi=SPINE_HI, value="y")
    m = m.join(register(spark, d).select("id", "capital"), "id", "left")
    m = fill_group_mean(with_calendar_parts(m, "month"), ["y"], ["id"])
    q = rollup_period(m, ["id", "year", "quarter"], ["y", "capital"])
    return q.select(row_key("id", "year", "quarter").alias("sid"), from_fixed("y").alias("y"),
                    (F.col("capital") / F.lit(1e2)).alias("capital"))


# ------------------------------------------------------------------ E10 E11
@query(
    "impute_and_replace",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
                                          ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS price,
                         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio FROM orders)
       SELECT o_orderkey, COALESCE(price, (SELECT CAST(SUM(price) // COUNT(price) AS BIGINT) FROM o)) / 1e2 AS price,
              CASE WHEN prio IN (4, 5) THEN 0 ELSE prio END AS prio
       FROM o""",
)
def q_impute_and_replace(spark: SparkSession, d: str) -> DataFrame:
    """Missing values (here: prices of low-priority orders withheld) <- the global mean;
    E11: designated outlier codes (4, 5) -> 0."""
    o = T(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("price"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
    )
    o = impute_mean(o, ["price"])
    o = replace_tokens(o, ["prio"], [4, 5], 0)
    return o.select("o_orderkey", (F.col("price") / F.lit(1e2)).alias("price"), "prio")


# ------------------------------------------------------------------------- O4
@query("panel_slice", f"SELECT sid, y FROM ({SQL_QUARTERLY}) ORDER BY sid LIMIT 24 OFFSET 24")
def q_panel_slice(spark: SparkSession, d: str) -> DataFrame:
    """The positional slice [24:48) of the panel in key order (the preview the notebooks plot)."""
    p = q_quarterly_panel(spark, d).select("sid", "y")
    return slice_rows(p, [F.col("sid")], 24, 48)


# ------------------------------------------------------------------------- M3
def _sql_folds() -> str:
    sized = f"(SELECT *, row_number() OVER (ORDER BY key) - 1 AS i, COUNT(*) OVER () AS n FROM ({m.sql_guest_whole('NULL')}) WHERE split = 'valid')"
    fold = "CASE WHEN i < (n % 2) * (n // 2 + 1) THEN i // (n // 2 + 1) ELSE n % 2 + (i - (n % 2) * (n // 2 + 1)) // (n // 2) END"
    rows = f"SELECT key, CAST({fold} AS INTEGER) AS fold, y, {', '.join(m.FEATURES)} FROM {sized}"
    return f"""WITH RECURSIVE {m.ridge_ctes(rows, m.FEATURES, m.ALPHA)},
scored AS (SELECT d.fold, COUNT(*) AS "rows", sqrt(AVG((d.y - {m.ridge_prediction(m.FEATURES)}) * (d.y - {m.ridge_prediction(m.FEATURES)}))) / 1e2 AS rmse
           FROM data d JOIN fitted t ON d.fold = t.fold GROUP BY d.fold)
SELECT fold, "rows", round(rmse, 4) AS rmse, round(AVG(rmse) OVER (), 4) AS avg_rmse FROM scored"""


@query("linear_cross_validation", _sql_folds())
def q_linear_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """M3 + M6: unshuffled 2-fold cross-validation of the linear model, all folds from one scan (RMSE in currency)."""
    g = m._guest_whole(spark, d).where("split = 'valid'")
    folds = fold_moments(kfold_ids(g, ["sid"], 2), [*m.FEATURES, "label"], by="fold")
    scored = [(f, n, e / 1e2) for f, n, e in cross_validate_ridge(folds, m.FEATURES, m.ALPHA)]
    mean = sum(e for _, _, e in scored) / len(scored) if scored else None
    rows = [(f, n, round(e, 4), round(mean, 4)) for f, n, e in scored]
    return spark.createDataFrame(rows, "fold int, rows long, rmse double, avg_rmse double")
