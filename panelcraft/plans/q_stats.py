"""Profiling, scaling, binning and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.scalar import log1p
from panelcraft.functions.scalar import ratio
from panelcraft.functions.scalar import square
from panelcraft.functions.scalar import to_fixed
from panelcraft.operators.binning import bucketizer
from panelcraft.operators.binning import fit_approx_bins
from panelcraft.operators.binning import fit_exact_bins
from panelcraft.operators.binning import information_value
from panelcraft.operators.binning import woe_table
from panelcraft.operators.profile import column_stats
from panelcraft.operators.profile import describe
from panelcraft.operators.profile import histogram
from panelcraft.operators.profile import mean_std_by
from panelcraft.operators.profile import value_counts
from panelcraft.operators.scale import fit_robust
from panelcraft.operators.scale import robust_inverse
from panelcraft.operators.scale import robust_scale
from panelcraft.operators.scale import zscore
from panelcraft.operators.select import near_constant
from panelcraft.operators.select import outlier_filter
from panelcraft.operators.select import select_by_statistic
from panelcraft.operators.select import top_by_iv
from panelcraft.plans.inputs import T
from panelcraft.plans.inputs import query

# Fixed values of the test mapping: training period for fitted bins, number of bins.
BIN_TRAIN_BEFORE = "2000-01-01"
N_BINS = 10


def dbl(expr: str) -> str:
    """DuckDB: exact integer -> correctly rounded DOUBLE (through text, as Spark's decimal cast)."""
    return f"CAST(CAST(({expr}) AS VARCHAR) AS DOUBLE)"


def sql_about(n: str, s1: str, s2: str) -> str:
    """DuckDB: sum of squares about the mean from exact power sums, as ``centred_sums`` computes it."""
    m, rest = f"({s1} // {n})", f"CAST({s1} - {n} * ({s1} // {n}) AS DOUBLE)"
    return f"({dbl(f'{s2} - 2 * {m} * {s1} + {n} * {m} * {m}')} - {rest} * {rest} / CAST({n} AS DOUBLE))"


def sql_std(n: str, s1: str, s2: str, ddof: int) -> str:
    return f"sqrt({sql_about(n, s1, s2)} / CAST({n} - {ddof} AS DOUBLE))"


def lines_fixed(spark: SparkSession, d: str) -> DataFrame:
    li = T(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        to_fixed("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.lit(7).cast("bigint").alias("const"),
        "l_discount",
        "l_tax",
        "l_returnflag",
    )


SQL_LINES = """SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
                      CAST(l_quantity AS BIGINT) AS qty, CAST(7 AS BIGINT) AS const, l_discount, l_tax, l_returnflag
               FROM lineitem"""


def events_fixed(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "events")
    return e.select("event_id", "event_type", to_fixed("value").alias("value"))


SQL_EVENTS = "SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS value FROM events"


# ----------------------------------------------------------------- A7 A9
@query("value_counts", "SELECT l_returnflag, COUNT(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frequency table of a code column."""
    return value_counts(T(spark, d, "lineitem"), "l_returnflag")


SQL_DESCRIBE = f"""
WITH x AS ({SQL_LINES}),
s AS (SELECT COUNT(price) AS n, SUM(price) AS s1, SUM(CAST(price AS HUGEINT) * price) AS s2, MIN(price) AS mn,
             MAX(price) AS mx, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2,
             quantile_cont(price, 0.75) AS q3 FROM x)
SELECT n AS count, {dbl("s1")} / CAST(n AS DOUBLE) / 100.0 AS mean, {sql_std("n", "s1", "s2", 1)} / 100.0 AS std,
       CAST(mn AS DOUBLE) / 100.0 AS min, CAST(q1 AS DOUBLE) / 100.0 AS q25, CAST(q2 AS DOUBLE) / 100.0 AS q50,
       CAST(q3 AS DOUBLE) / 100.0 AS q75, CAST(mx AS DOUBLE) / 100.0 AS max
FROM s
"""


@query("describe_price", SQL_DESCRIBE)
def q_describe_price(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles, max of the line price."""
    return describe(lines_fixed(spark, d), "price", scale=100.0)


# ---------------------------------------------------------------- A10 A11
@query(
    "mean_std_by_group",
    f"""WITH x AS ({SQL_EVENTS}),
        s AS (SELECT event_type, COUNT(value) AS n, SUM(value) AS s1, SUM(CAST(value AS HUGEINT) * value) AS s2
              FROM x WHERE event_type IS NOT NULL GROUP BY event_type)
        SELECT event_type, {dbl("s1")} / CAST(n AS DOUBLE) / 100.0 AS mean,
               CASE WHEN n > 1 THEN {sql_std("n", "s1", "s2", 1)} END / 100.0 AS std
        FROM s""",
)
def q_mean_std_by_group(spark: SparkSession, d: str) -> DataFrame:
    """A10: per-group mean and sample std of the event value."""
    e = events_fixed(spark, d).where(F.col("event_type").isNotNull())
    return mean_std_by(e, ["event_type"], "value", scale=100.0)


SQL_HIST = """
WITH r AS (SELECT MIN(value) AS mn, MAX(value) AS mx FROM events),
c AS (SELECT CAST(least(floor((value - mn) * 50.0 / (mx - mn)), 49) AS INTEGER) AS bin, COUNT(*) AS n
      FROM events, r WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin)
SELECT g.bin, mn + g.bin * ((mx - mn) / 50) AS lo, mn + (g.bin + 1) * ((mx - mn) / 50) AS hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin
"""


@query("histogram_value", SQL_HIST)
def q_histogram_value(spark: SparkSession, d: str) -> DataFrame:
    """50 equal-width bins of the event value (last bin closed)."""
    return histogram(T(spark, d, "events"), "value", 50)


# --------------------------------------------------------------------- A13 E12 E13
def sql_colstats(col: str, rows: str = f"({SQL_LINES})") -> str:
    m, m2 = "(s1 // n)", sql_about("n", "s1", "s2")
    rest = f"CAST(s1 - n * {m} AS DOUBLE)"
    c2, c3 = f"s2 - 2 * {m} * s1 + n * {m} * {m}", f"s3 - 3 * {m} * s2 + 3 * {m} * {m} * s1 - n * {m} * {m} * {m}"
    off = f"({rest} / CAST(n AS DOUBLE))"
    m3 = f"({dbl(c3)} - 3.0::DOUBLE * {off} * {dbl(c2)} + 2.0::DOUBLE * {off} * {off} * {rest})"
    std = sql_std("n", "s1", "s2", 1)
    return f"""SELECT '{col}' AS column, n AS count, {dbl("s1")} / CAST(n AS DOUBLE) AS mean, {std} AS std,
                   CASE WHEN {m2} > 0 THEN sqrt(CAST(n AS DOUBLE)) * {m3} / ({m2} * sqrt({m2})) END AS skewness,
                   ({std}) / ({dbl("s1")} / CAST(n AS DOUBLE)) AS cv
              FROM (SELECT COUNT({col}) AS n, CAST(SUM({col}) AS HUGEINT) AS s1,
                           SUM(CAST({col} AS HUGEINT) * {col}) AS s2,
                           SUM(CAST({col} AS HUGEINT) * {col} * {col}) AS s3 FROM {rows})"""


STAT_COLS = ["qty", "price", "const"]
SQL_COLSTATS = " UNION ALL ".join(sql_colstats(c) for c in STAT_COLS)


@query("column_stats", SQL_COLSTATS)
def q_column_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, sample std, population skewness, coefficient of variation per column."""
    return column_stats(lines_fixed(spark, d), STAT_COLS)


@query(
    "select_by_statistic",
    f"""SELECT "column", cv, skewness, COALESCE(cv >= 0.001, false) AND COALESCE(skewness <= 1.0, false) AS keep
        FROM ({SQL_COLSTATS})""",
)
def q_select_by_statistic(spark: SparkSession, d: str) -> DataFrame:
    """Keep features with CV >= 0.001 (take high) and skewness <= 1.0 (take low)."""
    return select_by_statistic(lines_fixed(spark, d), STAT_COLS, cv_min=0.001, skew_max=1.0).select("column", "cv", "skewness", "keep")


@query(
    "near_constant",
    f"""SELECT 'qty' AS column, CAST(MAX(qty) AS DOUBLE) - CAST(MIN(qty) AS DOUBLE) AS spread,
               COALESCE(CAST(MAX(qty) AS DOUBLE) - CAST(MIN(qty) AS DOUBLE) > 1e-6, false) AS keep FROM ({SQL_LINES})
        UNION ALL
        SELECT 'l_discount', MAX(l_discount) - MIN(l_discount), COALESCE(MAX(l_discount) - MIN(l_discount) > 1e-6, false)
        FROM lineitem
        UNION ALL
        SELECT 'const', CAST(MAX(const) AS DOUBLE) - CAST(MIN(const) AS DOUBLE),
               COALESCE(CAST(MAX(const) AS DOUBLE) - CAST(MIN(const) AS DOUBLE) > 1e-6, false) FROM ({SQL_LINES})""",
)
def q_near_constant(spark: SparkSession, d: str) -> DataFrame:
    """Drop near-constant features (spread <= 1e-6)."""
    return near_constant(lines_fixed(spark, d), ["qty", "l_discount", "const"])


# ------------------------------------------------------------------ E15 P12-P14
@query(
    "outlier_filter",
    f"""WITH x AS ({SQL_EVENTS}),
        s AS (SELECT event_type, COUNT(value) AS n, SUM(value) AS s1, SUM(CAST(value AS HUGEINT) * value) AS s2
              FROM x GROUP BY event_type),
        g AS (SELECT event_type, {dbl("s1")} / CAST(n AS DOUBLE) AS m,
                     CASE WHEN n > 1 THEN {sql_std("n", "s1", "s2", 1)} END AS sd FROM s)
        SELECT x.event_id, x.event_type, x.value FROM x JOIN g ON x.event_type = g.event_type
        WHERE abs(CAST(x.value AS DOUBLE) - g.m) <= 2.0 * g.sd""",
)
def q_outlier_filter(spark: SparkSession, d: str) -> DataFrame:
    """Keep events within 2 sample standard deviations of their type's mean."""
    return outlier_filter(events_fixed(spark, d), "value", ["event_type"], 2.0)


@query(
    "scalar_features",
    """SELECT event_id, value * value AS value_sq,
              CASE WHEN user_id <> 0 THEN value / 10000.0 / user_id END AS value_ratio
       FROM events""",
)
def q_scalar_features(spark: SparkSession, d: str) -> DataFrame:
    """P12 + P14: ratio (NULL on a zero denominator, not inf) and square features."""
    e = T(spark, d, "events")
    return e.select("event_id", square("value").alias("value_sq"), ratio("value", "user_id", 10000.0).alias("value_ratio"))


@query(
    "log1p_value",
    "SELECT event_id, CASE WHEN value > -1 THEN round(ln(1 + value), 9) END AS value_log1p FROM events",
)
def q_log1p_value(spark: SparkSession, d: str) -> DataFrame:
    """ln(1 + x) of the event value to 9 places (NULL for x <= -1)."""
    e = T(spark, d, "events")
    return e.select("event_id", F.round(log1p("value"), 9).alias("value_log1p"))


# -------------------------------------------------------------------- E5 E7
SQL_ZSCORE = f"""
WITH x AS ({SQL_LINES}),
s AS (SELECT COUNT(price) AS n, SUM(price) AS s1, SUM(CAST(price AS HUGEINT) * price) AS s2,
             COUNT(qty) AS m, SUM(qty) AS t1, SUM(CAST(qty AS HUGEINT) * qty) AS t2 FROM x)
SELECT x.l_orderkey, x.l_linenumber,
       CAST(x.price * s.n - s.s1 AS DOUBLE) / sqrt({dbl("s.n * s.s2 - s.s1 * s.s1")}) AS price_z,
       CAST(x.qty * s.m - s.t1 AS DOUBLE) / sqrt({dbl("s.m * s.t2 - s.t1 * s.t1")}) AS qty_z,
       CAST(NULL AS DOUBLE) AS const_z
FROM x, s
"""


@query("zscore", SQL_ZSCORE)
def q_zscore(spark: SparkSession, d: str) -> DataFrame:
    """E5: (x - mean) / population std per column; a constant column gives NULL."""
    x = lines_fixed(spark, d)
    z = zscore(x, ["price", "qty", "const"], suffix="_z")
    return z.select("l_orderkey", "l_linenumber", "price_z", "qty_z", "const_z")


SQL_ROBUST = """
WITH x AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
q AS (SELECT CAST(quantile_cont(price, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(price, 0.5) AS DOUBLE) AS q2,
             CAST(quantile_cont(price, 0.75) AS DOUBLE) AS q3 FROM x)
SELECT o_orderkey, CAST(price AS DOUBLE) / (q3 - q1) AS price_robust,
       (CAST(price AS DOUBLE) - q2) / (q3 - q1) AS price_centered,
       ((CAST(price AS DOUBLE) - q2) / (q3 - q1)) * (q3 - q1) + q2 AS price_restored
FROM x, q
"""


@query("robust_scale", SQL_ROBUST)
def q_robust_scale(spark: SparkSession, d: str) -> DataFrame:
    """Divide by the interpolated IQR, with and without median centering, and the inverse."""
    o = T(spark, d, "orders").select("o_orderkey", to_fixed("o_totalprice").alias("price"))
    plain = fit_robust(o, ["price"], center=False)
    centered = fit_robust(o, ["price"], center=True)
    o = robust_scale(o, plain, "_robust")
    o = robust_scale(o, centered, "_centered")
    o = robust_inverse(o.withColumn("price_restored", F.col("price_centered")), {"price_restored": centered["price"]})
    return o.select("o_orderkey", "price_robust", "price_centered", "price_restored")


# --------------------------------------------------------------------- E8 E9 E14
SQL_BINS = f"""
WITH x AS (SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
tr AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS r FROM x WHERE o_orderdate < TIMESTAMP '{BIN_TRAIN_BEFORE}'),
n AS (SELECT COUNT(*) AS n FROM tr),
k AS (SELECT unnest(range(1, {N_BINS})) AS i),
e AS (SELECT DISTINCT tr.price AS edge FROM tr, n, k WHERE tr.r = ((n.n - 1) * k.i) // {N_BINS})
SELECT x.o_orderkey, CAST((SELECT COUNT(*) FROM e WHERE e.edge <= x.price) AS INTEGER) AS price_bin FROM x
"""


@query("quantile_bins_exact", SQL_BINS)
def q_quantile_bins_exact(spark: SparkSession, d: str) -> DataFrame:
    """E8 exact variant: decile edges fitted on the training period, applied to every order."""
    o = T(spark, d, "orders").select("o_orderkey", "o_orderdate", to_fixed("o_totalprice").alias("price"))
    edges = fit_exact_bins(o.where(F.col("o_orderdate").cast("date") < F.to_date(F.lit(BIN_TRAIN_BEFORE))), ["price"], N_BINS)
    b = bucketizer(edges).transform(o)
    return b.select("o_orderkey", F.col("price_bin").cast("int").alias("price_bin"))


@query("quantile_bins_approx")
def q_quantile_bins_approx(spark: SparkSession, d: str) -> DataFrame:
    """E8 approximate: 500 bins, relative error 1e-3 (sketch), fitted on train, applied to all. Rows-only."""
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate")
    train = li.where(F.col("l_shipdate").cast("date") < F.to_date(F.lit(BIN_TRAIN_BEFORE)))
    model = fit_approx_bins(train, ["l_extendedprice", "l_quantity"], 500, 1e-3)
    return model.transform(li).select("l_orderkey", "l_linenumber", "l_extendedprice_bin", "l_quantity_bin")


def _binned_lines(spark: SparkSession, d: str) -> DataFrame:
    x = lines_fixed(spark, d).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    edges = fit_exact_bins(x, ["qty"], N_BINS)
    return bucketizer(edges).transform(x).withColumn("qty_bin", F.col("qty_bin").cast("int"))


def _sql_binned() -> str:
    return f"""
x AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM ({SQL_LINES})),
tr AS (SELECT qty, row_number() OVER (ORDER BY qty) - 1 AS r FROM x WHERE qty IS NOT NULL),
n AS (SELECT COUNT(*) AS n FROM tr),
k AS (SELECT unnest(range(1, {N_BINS})) AS i),
e AS (SELECT DISTINCT tr.qty AS edge FROM tr, n, k WHERE tr.r = ((n.n - 1) * k.i) // {N_BINS}),
b AS (SELECT x.*, CAST((SELECT COUNT(*) FROM e WHERE e.edge <= x.qty) AS INTEGER) AS qty_bin FROM x),
w AS (SELECT qty_bin, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS events,
             CAST(SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS non_events FROM b GROUP BY qty_bin),
t AS (SELECT CAST(SUM(events) AS DOUBLE) AS et, CAST(SUM(non_events) AS DOUBLE) AS nt FROM w)"""


@query(
    "woe_table",
    f"""WITH {_sql_binned()}
        SELECT qty_bin, events, non_events,
               round(ln(((events + 0.5) / et) / ((non_events + 0.5) / nt)), 9) AS woe,
               round(((events + 0.5) / et - (non_events + 0.5) / nt) * ln(((events + 0.5) / et) / ((non_events + 0.5) / nt)), 9)
                 AS iv_part
        FROM w, t""",
)
def q_woe_table(spark: SparkSession, d: str) -> DataFrame:
    """Weight of evidence and IV contribution of quantity deciles against a binary return label."""
    w = woe_table(_binned_lines(spark, d), "qty_bin", "label", 0.5)
    return w.select("qty_bin", "events", "non_events", F.round("woe", 9).alias("woe"), F.round("iv_part", 9).alias("iv_part"))


@query("iv_merged_bins")
def q_iv_merged_bins(spark: SparkSession, d: str) -> DataFrame:
    """E9 merge step: quantity deciles merged to 4 bins by least IV loss; events per merged bin. Rows-only."""
    from panelcraft.operators.binning import apply_bin_merge
    from panelcraft.operators.binning import fit_iv_merge

    b = _binned_lines(spark, d)
    mapping = fit_iv_merge(b, "qty_bin", "label", 4)
    m = apply_bin_merge(b, "qty_bin", mapping, "qty_merged")
    return woe_table(m, "qty_merged", "label")


IV_FEATURES = {"qty": "qty", "disc": "CAST(round(l_discount * 100) AS BIGINT)", "tax": "CAST(round(l_tax * 100) AS BIGINT)",
               "price": "price"}


def _sql_iv(name: str, expr: str) -> str:
    return f"""SELECT '{name}_bin' AS feature, SUM(((events + 0.5) / et - (non_events + 0.5) / nt)
                      * ln(((events + 0.5) / et) / ((non_events + 0.5) / nt))) AS iv
    FROM (SELECT b, SUM(label) AS events, SUM(1 - label) AS non_events FROM (
            SELECT CAST((SELECT COUNT(*) FROM e_{name} WHERE e_{name}.edge <= v) AS INTEGER) AS b, label
            FROM (SELECT {expr} AS v, label FROM x) WHERE v IS NOT NULL) GROUP BY b) w,
         (SELECT CAST(SUM(label) AS DOUBLE) AS et, CAST(SUM(1 - label) AS DOUBLE) AS nt FROM x WHERE {expr} IS NOT NULL) t"""


def _sql_edges(name: str, expr: str) -> str:
    return f"""r_{name} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM (SELECT {expr} AS v FROM x) WHERE v IS NOT NULL),
e_{name} AS (SELECT DISTINCT v AS edge FROM r_{name}, (SELECT COUNT(*) AS n FROM r_{name}) n,
             (SELECT unnest(range(1, {N_BINS})) AS i) k WHERE r_{name}.r = ((n.n - 1) * k.i) // {N_BINS})"""


SQL_IV_TOP = f"""
WITH x AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM ({SQL_LINES})),
{", ".join(_sql_edges(n, e) for n, e in IV_FEATURES.items())}
SELECT feature, round(iv, 9) AS iv FROM ({" UNION ALL ".join(_sql_iv(n, e) for n, e in IV_FEATURES.items())})
ORDER BY iv DESC, feature LIMIT 2
"""


@query("iv_top_features", SQL_IV_TOP)
def q_iv_top_features(spark: SparkSession, d: str) -> DataFrame:
    """Features ranked by information value (decile bins vs the return label), top 2."""
    x = lines_fixed(spark, d).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    x = x.withColumns({"disc": to_fixed("l_discount"), "tax": to_fixed("l_tax")})
    edges = fit_exact_bins(x, ["qty", "disc", "tax", "price"], N_BINS)
    b = bucketizer(edges).transform(x)
    iv = information_value(b, [c + "_bin" for c in edges], "label")
    return top_by_iv(iv, k=2).select("feature", F.round("iv", 9).alias("iv"))
