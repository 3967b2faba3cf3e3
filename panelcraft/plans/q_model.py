"""Evaluation, splitting and modelling queries.

Evaluation queries use a deterministic "prediction" (the seasonal mean of
the flagship panel) so an oracle can compute them; model queries train real
MLlib pipelines and are checked by row counts and properties (tests).
"""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.functions.aggregates import int_div
from panelcraft.operators.boost import BoostedTrees
from panelcraft.operators.boost import Goss
from panelcraft.operators.boost import cross_validate_boosted
from panelcraft.operators.boost import fit_boosted_trees
from panelcraft.operators.evaluate import error_report
from panelcraft.operators.evaluate import quartile_split
from panelcraft.operators.evaluate import regression_metrics
from panelcraft.operators.evaluate import submission
from panelcraft.operators.impute import fill_group_mean
from panelcraft.operators.linear import fold_moments
from panelcraft.operators.linear import solve_ridge
from panelcraft.functions.scalar import parse_row_key
from panelcraft.operators.model import deploy
from panelcraft.operators.model import fit
from panelcraft.operators.model import spread
from panelcraft.operators.model import gbt_pipeline
from panelcraft.operators.model import iteration_history
from panelcraft.operators.model import load_model
from panelcraft.operators.model import partitions_by_rows
from panelcraft.operators.model import save_model
from panelcraft.operators.model import typed_label
from panelcraft.operators.monthly import monthly_panel
from panelcraft.operators.rollup import row_bucket_sum
from panelcraft.operators.split import goss_sample
from panelcraft.operators.split import kfold_ids
from panelcraft.operators.split import stratified_split
from panelcraft.plans.inputs import SPINE_HI
from panelcraft.plans.inputs import SPINE_LO
from panelcraft.plans.inputs import SQL_FACTS
from panelcraft.plans.inputs import SQL_N
from panelcraft.plans.inputs import TARGET_QUARTER
from panelcraft.plans.inputs import TARGET_YEAR
from panelcraft.plans.inputs import T
from panelcraft.plans.inputs import payments
from panelcraft.plans.inputs import query
from panelcraft.plans.inputs import sql_months
from panelcraft.plans.panel import from_fixed
from panelcraft.plans.q_features import SQL_GUEST
from panelcraft.plans.q_features import SQL_HOST
from panelcraft.plans.q_features import TEST_SEGMENTS
from panelcraft.plans.q_features import guest_build
from panelcraft.plans.q_features import host_build
from panelcraft.plans.q_stats import dbl
from panelcraft.plans.q_stats import sql_about
from panelcraft.plans.queries import SQL_QUARTERLY
from panelcraft.plans.sql_boost import boost_ctes
from panelcraft.plans.sql_linear import ridge_ctes
from panelcraft.plans.sql_linear import ridge_prediction
from panelcraft.plans.training import TrainingRun
from panelcraft.plans.training import train_predict_submit
from panelcraft.session import materialise
from panelcraft.session import scratch_table_dir

CENT = 10**6  # fixed-point units (1e-8) per cent


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(sid, id, year, quarter, label, prediction) in cents: label = quarterly amount, prediction = seasonal mean."""
    from panelcraft.plans.panel import quarterly_panel

    p = quarterly_panel(
        payments(spark, d), id_col="id", start="start", end="end", amount="amount", lo=SPINE_LO, hi=SPINE_HI,
        mask=(TARGET_YEAR, TARGET_QUARTER),
    )
    return p.select(
        "sid", "id", "year", "quarter",
        int_div(F.col("y"), F.lit(CENT)).alias("label"),
        int_div(F.col("y_avg"), F.lit(CENT)).alias("prediction"),
    )


SQL_PRED = f"""SELECT sid, id, year, quarter, CAST(round(y * 1e8) AS BIGINT) // {CENT} AS label,
                      CAST(round(y_avg * 1e8) AS BIGINT) // {CENT} AS prediction FROM ({SQL_QUARTERLY})"""


# ------------------------------------------------------------------------- V1
def _sql_metrics(by: str) -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
WITH p AS ({SQL_PRED}),
s AS (SELECT {sel}COUNT(*) AS n, SUM(CAST(label - prediction AS HUGEINT) * (label - prediction)) AS sse,
             SUM(CAST(label AS HUGEINT)) AS sy, SUM(CAST(label AS HUGEINT) * label) AS syy
      FROM p WHERE label IS NOT NULL AND prediction IS NOT NULL {grp})
SELECT {sel}n, {dbl("sse")} / CAST(n AS DOUBLE) / 10000.0 AS mse, sqrt({dbl("sse")} / CAST(n AS DOUBLE) / 10000.0) AS rmse,
       CASE WHEN {sql_about("n", "sy", "syy")} <> 0 THEN 1.0 - {dbl("sse")} / {sql_about("n", "sy", "syy")} END AS r2
FROM s"""


@query("regression_metrics", _sql_metrics(""))
def q_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    """V1: MSE, RMSE, R^2 of the seasonal-mean predictor (currency units)."""
    return regression_metrics(predictions(spark, d), "label", "prediction", scale=100.0)


@query("regression_metrics_by_quarter", _sql_metrics("quarter"))
def q_regression_metrics_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """V1 by group: the same metrics per quarter."""
    return regression_metrics(predictions(spark, d), "label", "prediction", by=["quarter"], scale=100.0)


# ------------------------------------------------------------------ V2 V3 V4
@query(
    "submission_extract",
    f"""SELECT CAST(substr(sid, 1, length(sid) - 6) AS BIGINT) AS id, prediction / 1e2 AS predict_result
        FROM ({SQL_PRED}) WHERE CAST(substr(sid, length(sid) - 5, 4) AS INTEGER) = {TARGET_YEAR}
          AND CAST(substr(sid, length(sid) - 1, 2) AS INTEGER) = {TARGET_QUARTER}""",
)
def q_submission_extract(spark: SparkSession, d: str) -> DataFrame:
    """V2 (P6 P8 S9 frame): parse the key, keep the target quarter, (id, predict_result)."""
    p = predictions(spark, d).select("sid", (F.col("prediction") / F.lit(100.0)).alias("predict_result"))
    return submission(p, "sid", "predict_result", TARGET_YEAR, TARGET_QUARTER)


SQL_ERRORS = f"""
WITH p AS ({SQL_PRED}),
g AS ({SQL_GUEST})
SELECT p.sid, CAST(substr(p.sid, 1, length(p.sid) - 6) AS BIGINT) AS id, p.label / 1e2 AS label,
       p.prediction / 1e2 AS prediction, (p.label - p.prediction) / 1e2 AS error,
       abs(p.label - p.prediction) / 1e2 AS error_abs, g.capital, g.month_amount
FROM p LEFT JOIN g ON p.sid = g.sid
WHERE NOT (p.year = {TARGET_YEAR} AND p.quarter = {TARGET_QUARTER})
"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    # the materialised guest features already hold the label (y) and the seasonal mean (y_avg):
    # take the predictions from them so the payment panel is computed once
    g = guest_build(spark, d)
    p = g.select(
        "sid",
        int_div(F.col("y"), F.lit(CENT)).alias("label"),
        int_div(F.col("y_avg"), F.lit(CENT)).alias("prediction"),
    )
    feats = g.select(
        "sid", (F.col("capital") / F.lit(1e2)).alias("capital"), (F.col("month_amount") / F.lit(1e8)).alias("month_amount")
    )
    return error_report(p, feats, "sid", "label", "prediction", TARGET_YEAR, TARGET_QUARTER)


@query("error_report", SQL_ERRORS)
def q_error_report(spark: SparkSession, d: str) -> DataFrame:
    """V3 (P11 J10 O3): residuals outside the target quarter joined with the features, worst first."""
    e = _errors(spark, d)
    cents = ["label", "prediction", "error", "error_abs"]
    return e.select("sid", "id", *[(F.col(c) / F.lit(100.0)).alias(c) for c in cents], "capital", "month_amount")


@query(
    "top_errors",
    f"""SELECT sid, error_abs FROM ({SQL_ERRORS}) ORDER BY error_abs DESC, id DESC, sid DESC LIMIT 20""",
)
def q_top_errors(spark: SparkSession, d: str) -> DataFrame:
    """The 20 worst predictions (the limit is the report)."""
    e = _errors(spark, d)
    return e.select("sid", (F.col("error_abs") / F.lit(100.0)).alias("error_abs")).limit(20)


@query(
    "error_quartiles",
    f"""WITH e AS (SELECT abs(label - prediction) AS err FROM ({SQL_PRED})
                   WHERE NOT (year = {TARGET_YEAR} AND quarter = {TARGET_QUARTER})),
        q AS (SELECT CAST(quantile_cont(err, 0.75) AS DOUBLE) AS q3 FROM e)
        SELECT CASE WHEN err >= q3 THEN 'bad' ELSE 'good' END AS "group", COUNT(*) AS n, q3,
               CAST(SUM(err) AS BIGINT) AS sum_err
        FROM e, q WHERE err IS NOT NULL GROUP BY 1, q3""",
)
def q_error_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """V4: errors at or above the third quartile ('bad') against the rest ('good')."""
    p = predictions(spark, d).where(~((F.col("year") == TARGET_YEAR) & (F.col("quarter") == TARGET_QUARTER)))
    e = p.select(F.abs(F.col("label") - F.col("prediction")).alias("err"))
    return quartile_split(e, "err", ["err"]).withColumn("sum_err", F.col("sum_err").cast("bigint"))


# ------------------------------------------------------------------------- A8
SQL_BUCKETS = f"""
WITH f AS ({SQL_FACTS}),
ids AS (SELECT DISTINCT id FROM f WHERE id IS NOT NULL),
v AS (SELECT id, ms, me, amt // {SQL_N} AS rate FROM f WHERE ms <= me),
e AS (SELECT id, rate, CAST(unnest(generate_series(ms, me, INTERVAL 1 MONTH)) AS DATE) AS month FROM v),
m AS (SELECT id, month, CAST(SUM(rate) AS BIGINT) AS y FROM e GROUP BY id, month),
s AS (SELECT id, {sql_months(SPINE_LO, SPINE_HI)} AS month FROM ids),
p AS (SELECT s.id, s.month, m.y FROM s LEFT JOIN m ON s.id = m.id AND s.month = m.month),
fl AS (SELECT id, month, COALESCE(y, CAST(SUM(y) OVER (PARTITION BY id) // COUNT(y) OVER (PARTITION BY id) AS BIGINT)) AS y
       FROM p),
b AS (SELECT id, y, CAST((row_number() OVER (PARTITION BY id ORDER BY month) - 1) // 3 AS INTEGER) AS bucket FROM fl)
SELECT id, bucket, CAST(SUM(y) AS BIGINT) / 1e8 AS y FROM b GROUP BY id, bucket
"""


@query("row_bucket_sum", SQL_BUCKETS)
def q_row_bucket_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums of every 3 consecutive filled months per id (the legacy roll-up by row position)."""
    m = monthly_panel(payments(spark, d), lo=SPINE_LO, hi=SPINE_HI, value="y")
    m = fill_group_mean(m, ["y"], ["id"])
    b = row_bucket_sum(m, "id", "month", 3, ["y"])
    return b.select("id", "bucket", (F.col("y") / F.lit(1e8)).alias("y"))


@query(
    "row_bucket_divided",
    SQL_BUCKETS.replace("SELECT id, y, CAST((row_number()", "SELECT id, month, y, CAST((row_number()").rsplit("SELECT id, bucket", 1)[0]
    + """SELECT id, bucket, CAST(SUM(y) AS BIGINT) / 1e8 AS y, CAST(SUM(year(month)) AS DOUBLE) / 3 AS year,
                CAST(SUM(quarter(month)) AS DOUBLE) / 3 AS quarter FROM b GROUP BY id, bucket""",
)
def q_row_bucket_divided(spark: SparkSession, d: str) -> DataFrame:
    """A8 as the legacy roll-up has it: every 3 consecutive months summed, year and quarter divided back by 3."""
    m = monthly_panel(payments(spark, d), lo=SPINE_LO, hi=SPINE_HI, value="y")
    m = fill_group_mean(m, ["y"], ["id"]).withColumns({"year": F.year("month"), "quarter": F.quarter("month")})
    b = row_bucket_sum(m, "id", "month", 3, ["y"], div_cols=["year", "quarter"])
    return b.select("id", "bucket", (F.col("y") / F.lit(1e8)).alias("y"), "year", "quarter")


# -------------------------------------------------------------------- M2 M3 M4
@query(
    "stratified_split",
    f"""WITH p AS ({SQL_PRED}),
        s AS (SELECT sid, CASE WHEN label < 1000000 THEN 0 WHEN label < 10000000 THEN 1 ELSE 2 END AS stratum FROM p),
        r AS (SELECT sid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sid) - 1 AS pos,
                     COUNT(*) OVER (PARTITION BY stratum) AS n FROM s)
        SELECT sid, pos < floor(n * 0.3) AS is_test FROM r""",
)
def q_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """M2: 30 % test rows per label stratum (split points 1e6 and 1e7 cents), ordered by key."""
    p = predictions(spark, d).select("sid", F.col("label").cast("double").alias("label"))
    s = stratified_split(p, "label", [1e6, 1e7], "sid", 0.3, seed=None)
    return s.select("sid", "is_test")


@query(
    "kfold_ids",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, COUNT(*) OVER () AS n FROM orders),
       k AS (SELECT *, n // 5 AS q, n % 5 AS rr FROM r)
       SELECT o_orderkey, CAST(CASE WHEN i < rr * (q + 1) THEN i // (q + 1) ELSE rr + (i - rr * (q + 1)) // q END AS INTEGER)
              AS fold FROM k""",
)
def q_kfold_ids(spark: SparkSession, d: str) -> DataFrame:
    """M3: unshuffled 5-fold ids over the order key order (contiguous blocks)."""
    return kfold_ids(T(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@query("goss_sample")
def q_goss_sample(spark: SparkSession, d: str) -> DataFrame:
    """M4: gradient one-side sample of the seasonal-mean residuals (top 20 %, 10 % of the rest). Rows-only."""
    p = predictions(spark, d).withColumn("gradient", (F.col("prediction") - F.col("label")).cast("double"))
    return goss_sample(p.select("sid", "gradient"), "gradient", 0.2, 0.1, seed=3)


# ----------------------------------------------------------------- M5-M10 S10
FEATURES = ["month_amount", "quarter", "capital", "year", "month_amount_avg", "y_avg", "year_y_avg", "year_month_amount_avg"]


#: least partitions that the models of these queries are trained in; more for more than a million rows each
TRAIN_PARTITIONS = 8


def _train_frames(spark: SparkSession, d: str):
    g = guest_build(spark, d)
    g = typed_label(g, "y").withColumns({c: F.col(c).cast("double") for c in FEATURES})
    train = g.where(F.col("split") == "valid")
    return g, train


def _fit(spark: SparkSession, d: str):
    g, train = _train_frames(spark, d)
    train = spread(train, partitions_by_rows(train, TRAIN_PARTITIONS)).cache()
    model = gbt_pipeline(FEATURES, n_trees=14, depth=4, step=0.2, max_bins=1000, bin_features=500).fit(train)
    return g, train, model


@query("gbt_predict")
def q_gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on binned features, saved, reloaded, deployed on every row. Rows-only."""
    g, train, model = _fit(spark, d)
    path = os.path.join(scratch_table_dir(spark, "models"), "gbt")
    save_model(model, path)
    served = deploy(load_model(path))
    out = served.transform(g).select("sid", "label", "prediction", "split")
    train.unpersist()
    return out


#: parameters of the boosted trees: 14 trees of depth 4, step 0.2, 500 bins, one-side sampling of 20 and 10 %
BOOST = dict(n_trees=14, depth=4, step=0.2, n_bins=500)
SQL_BOOST = BOOST | {"penalty": 0.1, "goss": (20, 10)}
MONEY = ["month_amount", "month_amount_avg", "y_avg", "year_y_avg", "year_month_amount_avg"]
#: models fitted in this application, by application, tables and plan: a few hundred nodes each
_FITTED: dict[tuple[str, str, str], BoostedTrees] = {}


def _guest_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Guest features in currency, the label in cents."""
    g = guest_build(spark, d).withColumn("label", int_div(F.col("y"), F.lit(CENT)))
    g = g.withColumns({c: from_fixed(c) for c in MONEY} | {"capital": F.col("capital") / F.lit(1e2)})
    return g.select("sid", "label", "split", *FEATURES)


def _goss_trees(spark: SparkSession, d: str) -> tuple[DataFrame, BoostedTrees]:
    """The guest features and the trees grown on their known quarters, reloaded from the node table."""
    at = (spark.sparkContext.applicationId, d, "guest")
    g = _guest_scaled(spark, d)
    if at not in _FITTED:
        model = fit_boosted_trees(g, FEATURES, "label", key="sid", split_col="split", train="valid", goss=Goss(20, 10), **BOOST)
        path = os.path.join(scratch_table_dir(spark, "models"), "boosted")
        model.save(spark, path)
        _FITTED[at] = replace(BoostedTrees.load(spark, path), history=model.history)
    return g, _FITTED[at]


SQL_GUEST_LABELLED = f"""SELECT sid AS key, CASE split WHEN 'valid' THEN 'train' ELSE split END AS role,
  CAST(round(y * 1e8) AS BIGINT) // {CENT} AS y, {', '.join(FEATURES)} FROM ({SQL_GUEST})"""
SQL_GUEST_TREES = boost_ctes(SQL_GUEST_LABELLED, FEATURES, **SQL_BOOST)


@query(
    "goss_boost_predict",
    f"""WITH {SQL_GUEST_TREES} SELECT key AS sid, y / 1e2 AS label, p / 1e2 AS prediction,
        CASE role WHEN 'train' THEN 'valid' ELSE role END AS split FROM s{BOOST["n_trees"]}""",
)
def q_goss_boost_predict(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees with one-side sampling on 500 bins, grown on the known quarters, saved as a
    node table, reloaded, scoring every row by one expression."""
    g, model = _goss_trees(spark, d)
    return g.select("sid", (F.col("label") / F.lit(1e2)).alias("label"), (model.prediction() / F.lit(1e2)).alias("prediction"), "split")


@query("boost_nodes", f"WITH {SQL_GUEST_TREES} SELECT * FROM nodes")
def q_boost_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table of those trees; the row of tree 0 has the initial prediction (cents)."""
    return _goss_trees(spark, d)[1].node_table(spark)


@query(
    "boost_history",
    f"WITH {SQL_GUEST_TREES} SELECT iteration, CASE split WHEN 'train' THEN 'valid' ELSE split END AS split, n, mse / 1e4 AS mse FROM history",
)
def q_boost_history(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error after every second tree, on the known quarters and on the masked one."""
    return _goss_trees(spark, d)[1].history_table(spark).withColumn("mse", F.col("mse") / F.lit(1e4))


@query(
    "boost_importances",
    f"""WITH {SQL_GUEST_TREES} SELECT feature, COUNT(*) AS splits, CAST(CAST(SUM(CAST(floor(gain) AS HUGEINT)) AS VARCHAR) AS DOUBLE) AS gain
        FROM nodes WHERE feature IS NOT NULL GROUP BY feature""",
)
def q_boost_importances(spark: SparkSession, d: str) -> DataFrame:
    """Splits and summed gain (whole units) of every feature used."""
    return _goss_trees(spark, d)[1].importances(spark)


CV = dict(n_trees=6, depth=6, step=0.3, n_bins=32)
CV_FOLDS = 5
SQL_CV_ROWS = f"""SELECT *, CAST(CASE WHEN i < (n % {CV_FOLDS}) * (n // {CV_FOLDS} + 1) THEN i // (n // {CV_FOLDS} + 1)
  ELSE n % {CV_FOLDS} + (i - (n % {CV_FOLDS}) * (n // {CV_FOLDS} + 1)) // (n // {CV_FOLDS}) END AS INTEGER) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i, COUNT(*) OVER () AS n FROM ({SQL_GUEST_LABELLED}) WHERE role = 'train')"""


def _sql_cv_fold(fold: int) -> str:
    base = f"SELECT * REPLACE (CASE WHEN fold = {fold} THEN 'valid' ELSE 'train' END AS role) FROM cv_rows"
    ctes = boost_ctes(base, FEATURES, **CV, penalty=0.1, goss=None)
    return f"SELECT * FROM (WITH {ctes} SELECT {fold} AS fold, n AS \"rows\", mse / 1e4 AS mse FROM history WHERE split = 'valid' AND iteration = {CV['n_trees']})"


@query(
    "boosted_cross_validation",
    f"WITH cv_rows AS MATERIALIZED ({SQL_CV_ROWS}) " + " UNION ALL ".join(map(_sql_cv_fold, range(CV_FOLDS))),
)
def q_boosted_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """M3 + M5: unshuffled 5-fold cross-validation of 6 trees of depth 6: each fold's error under the trees of the others."""
    g = _guest_scaled(spark, d).where("split = 'valid'").drop("split")
    folded = materialise(kfold_ids(g, ["sid"], CV_FOLDS), "folds")
    found = cross_validate_boosted(folded, FEATURES, "label", key="sid", fold_col="fold", **CV)
    return spark.createDataFrame([(f, n, mse / 1e4) for f, n, mse in found], "fold int, rows long, mse double")


HOST_FEATURES = ["qty", "price", "net", "price_avg", "qty_avg", "code_a", "code_b"]
SQL_SUBMISSION_BASE = f"""
SELECT g.sid AS key, CASE WHEN c.c_custkey IS NULL THEN 'train'
         WHEN CAST(substr(g.sid, length(g.sid) - 5, 4) AS INTEGER) = {TARGET_YEAR} AND CAST(substr(g.sid, length(g.sid) - 1, 2) AS INTEGER) = {TARGET_QUARTER}
         THEN 'predict' ELSE 'valid' END AS role,
       CAST(round(g.y * 1e8) AS BIGINT) // {CENT} AS y, {", ".join(f"g.{c}" for c in FEATURES)}, {", ".join(f"h.{c}" for c in HOST_FEATURES)}
FROM ({SQL_GUEST}) g JOIN ({SQL_HOST}) h ON g.sid = h.sid
     LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment IN {TEST_SEGMENTS}) c ON c.c_custkey = g.id"""
SQL_SUBMISSION_TREES = boost_ctes(SQL_SUBMISSION_BASE, FEATURES + HOST_FEATURES, **SQL_BOOST)


def _submission_run(spark: SparkSession, d: str) -> TrainingRun:
    at = (spark.sparkContext.applicationId, d)
    if at not in _RUNS:
        guest = _guest_scaled(spark, d).drop("split")
        host = host_build(spark, d).withColumns({c: from_fixed(c) for c in ("price", "net", "price_avg")}).select("sid", *HOST_FEATURES)
        test_ids = T(spark, d, "customer").where(F.col("c_mktsegment").isin(*TEST_SEGMENTS)).select("c_custkey")
        _RUNS[at] = train_predict_submit(
            guest, host, test_ids, key="sid", label="label", features=FEATURES + HOST_FEATURES, target=(TARGET_YEAR, TARGET_QUARTER),
            scale=1e2, goss=Goss(20, 10), **BOOST,
        )
    return _RUNS[at]


_RUNS: dict[tuple[str, str], TrainingRun] = {}


@query(
    "boosted_submission",
    f"""WITH {SQL_SUBMISSION_TREES} SELECT CAST(substr(key, 1, length(key) - 6) AS BIGINT) AS id, p / 1e2 AS predict_result
        FROM s{BOOST["n_trees"]} WHERE role = 'predict'""",
)
def q_boosted_submission(spark: SparkSession, d: str) -> DataFrame:
    """Section 3.3 end to end: guest x host features on the row key, boosted trees with one-side sampling trained on
    the train entities, validated on the test entities' known quarters, submission for their target quarter."""
    return _submission_run(spark, d).submission


@query("boosted_history", f"WITH {SQL_SUBMISSION_TREES} SELECT * REPLACE (mse / 1e4 AS mse) FROM history")
def q_boosted_history(spark: SparkSession, d: str) -> DataFrame:
    """M10 of that run: errors on train, valid and predict rows after every second tree."""
    return _submission_run(spark, d).history.withColumn("mse", F.col("mse") / F.lit(1e4))


@query("gbt_lineitem")
def q_gbt_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """M5 on the line items: 14 trees, depth 4, 1000 bins, 3 features (price from quantity, discount, tax),
    trained on all lines and scoring them. Rows-only."""
    li = T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label")
    )
    model = fit(gbt_pipeline(["l_quantity", "l_discount", "l_tax"], n_trees=14, depth=4, step=0.2, max_bins=1000,
                             bin_features=None), li, partitions_by_rows(li, TRAIN_PARTITIONS))
    return model.transform(li).select("l_orderkey", "l_linenumber", "label", "prediction")


@query("gbt_history")
def q_gbt_history(spark: SparkSession, d: str) -> DataFrame:
    """Squared loss per boosting iteration on a held-out period (M1): trained on the years before the
    target year, scored on the target year's known quarters. Rows-only."""
    _, known = _train_frames(spark, d)
    year = parse_row_key("sid")["year"].cast("int")  # the year column itself is a category code
    early = known.where(year < TARGET_YEAR)
    model = fit(gbt_pipeline(FEATURES, n_trees=14, depth=4, step=0.2, max_bins=1000, bin_features=500), early, partitions_by_rows(early, TRAIN_PARTITIONS))
    return iteration_history(model, known.where(year == TARGET_YEAR))


def _guest_whole(spark: SparkSession, d: str) -> DataFrame:
    """Guest features and label as whole numbers: money in cents, codes as they are."""
    g = guest_build(spark, d).withColumn("label", int_div(F.col("y"), F.lit(CENT)))
    return g.withColumns({c: int_div(F.col(c), F.lit(CENT)) for c in MONEY}).select("sid", "split", *FEATURES, "label")


def sql_guest_whole(fold: str = "NULL::INTEGER") -> str:
    whole = ", ".join(f"CAST(round({c} * {'1e2' if c == 'capital' else '1e8'}) AS BIGINT) // {1 if c == 'capital' else CENT} AS {c}" if c in (*MONEY, "capital") else c for c in FEATURES)
    return f"SELECT sid AS key, {fold} AS fold, CAST(round(y * 1e8) AS BIGINT) // {CENT} AS y, {whole}, split FROM ({SQL_GUEST})"


ALPHA = 0.01
SQL_RIDGE = ridge_ctes(f"SELECT * EXCLUDE (split) FROM ({sql_guest_whole()}) WHERE split = 'valid'", FEATURES, ALPHA)


def _ridge(spark: SparkSession, d: str):
    g = _guest_whole(spark, d)
    return g, solve_ridge(fold_moments(g.where("split = 'valid'"), [*FEATURES, "label"])[None], FEATURES, ALPHA)


@query(
    "linear_predict",
    f"""WITH RECURSIVE {SQL_RIDGE} SELECT key AS sid, d.y / 1e2 AS label, round({ridge_prediction(FEATURES)} / 1e2, 2) AS prediction
        FROM ({sql_guest_whole()}) d, fitted t""",
)
def q_linear_predict(spark: SparkSession, d: str) -> DataFrame:
    """M6 + E6: L2 linear regression on standard-scaled features, from the known quarters' sums, scoring every row."""
    g, model = _ridge(spark, d)
    return g.select("sid", (F.col("label") / F.lit(1e2)).alias("label"), F.round(model.prediction() / F.lit(1e2), 2).alias("prediction"))


@query(
    "linear_coefficients",
    f"""WITH RECURSIVE {SQL_RIDGE} SELECT unnest([{", ".join(f"'{c}'" for c in FEATURES)}]) AS feature, round(unnest(mean), 4) AS mean,
        round(unnest(sd), 4) AS scale, round(unnest(w), 4) AS coefficient, round(b, 4) AS intercept FROM fitted""",
)
def q_linear_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """M6: that model's scaling and coefficients (cents)."""
    _, m = _ridge(spark, d)
    rows = [(f, round(a, 4), round(s, 4), round(c, 4), round(m.intercept, 4)) for f, a, s, c in zip(m.features, m.mean, m.scale, m.coefficients)]
    return spark.createDataFrame(rows, "feature string, mean double, scale double, coefficient double, intercept double")


@query("feature_export", f"SELECT split, COUNT(*) AS rows FROM ({SQL_GUEST}) GROUP BY split")
def q_feature_export(spark: SparkSession, d: str) -> DataFrame:
    """S5 + S9: guest features written partitioned by split and read back (rows per split); the
    submission is written headerless."""
    from panelcraft.sources.io import export_headerless
    from panelcraft.sources.io import write_features

    base = scratch_table_dir(spark, "features")
    g = guest_build(spark, d)
    write_features(g, os.path.join(base, "guest"), "split")
    sub = submission(g.select("sid", (F.col("y_avg") / F.lit(1e8)).alias("predict_result")), "sid", "predict_result", TARGET_YEAR, TARGET_QUARTER)
    export_headerless(sub, os.path.join(base, "submit"), ["id", "predict_result"])
    back = spark.read.parquet(os.path.join(base, "guest"))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))

