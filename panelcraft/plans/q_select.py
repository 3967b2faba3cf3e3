"""Fitted selection, quantile sketches and optimal bins."""

from __future__ import annotations

import os

from pyspark.ml import Pipeline
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.operators.binning import optimal_bins
from panelcraft.operators.binning import quantile_sketches
from panelcraft.operators.binning import rank_errors
from panelcraft.operators.binning import sketched_quantiles
from panelcraft.operators.scale import feature_scale_stages
from panelcraft.operators.select import FeatureSelector
from panelcraft.operators.select import FeatureSelectorModel
from panelcraft.plans.inputs import T
from panelcraft.plans.inputs import query
from panelcraft.plans.q_model import FEATURES
from panelcraft.plans.q_model import _guest_whole
from panelcraft.plans.q_model import sql_guest_whole
from panelcraft.plans.q_stats import SQL_LINES
from panelcraft.plans.q_stats import lines_fixed
from panelcraft.plans.q_stats import sql_colstats
from panelcraft.session import materialise
from panelcraft.session import scratch_table_dir

# ----------------------------------------------------------------- E12 E13
CANDIDATES = [*FEATURES, "const"]
CV_MIN, SKEW_MAX = 0.001, 1.0
SQL_KNOWN = f"(SELECT *, 7::BIGINT AS const FROM ({sql_guest_whole()}) WHERE split = 'valid')"
SQL_NEW = f"(SELECT *, 7::BIGINT AS const FROM ({sql_guest_whole()}) WHERE split = 'predict')"
SQL_KEPT = " UNION ALL ".join(
    f"""SELECT s."column", (SELECT MAX({c}) - MIN({c}) FROM known) > 1e-6 AND COALESCE(cv >= {CV_MIN}, false) AND COALESCE(skewness <= {SKEW_MAX}, false) AS keep,
  (SELECT COUNT({c}) FROM fresh) AS n, (SELECT CAST(SUM({c}) AS BIGINT) FROM fresh) AS total FROM ({sql_colstats(c, "known")}) s"""
    for c in CANDIDATES
)


@query(
    "selection_applied",
    f"""WITH known AS MATERIALIZED {SQL_KNOWN}, fresh AS MATERIALIZED {SQL_NEW} SELECT "column", n, total FROM ({SQL_KEPT}) WHERE keep""",
)
def q_selection_applied(spark: SparkSession, d: str) -> DataFrame:
    """E12 + E13: selection fitted on the known quarters, saved, reloaded and applied to the masked quarter: the
    columns it leaves there, with their rows and sums."""
    g = _guest_whole(spark, d).withColumn("const", F.lit(7).cast("long"))
    g = materialise(g, "selection")
    path = os.path.join(scratch_table_dir(spark, "models"), "selector")
    FeatureSelector(CANDIDATES, cvMin=CV_MIN, skewMax=SKEW_MAX).fit(g.where("split = 'valid'")).write().overwrite().save(path)
    model = FeatureSelectorModel.load(path)
    out = model.transform(g.where("split = 'predict'"))
    left = [c for c in out.columns if c in CANDIDATES]
    sums = F.array(*(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(F.col(c).cast("long")).alias("total")) for c in left))
    return out.agg(sums.alias("s")).select(F.inline("s"))


# ---------------------------------------------------------------------- M7
TEXT_FEATURES = ["chars", "words", "lines", "word_length", "digits", "capitals", "signs", "distinct_words", "const"]


def text_features(docs: DataFrame) -> DataFrame:
    """Shape of a text: sizes, and shares of kinds of characters and of distinct words; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    x = docs.select("doc_id", text.alias("t"), words.alias("w"))
    size = F.greatest(F.length("t"), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count("t", F.lit(pattern)) / size
    return x.select(
        "doc_id",
        F.log1p(F.length("t")).alias("chars"),
        F.log1p(F.size("w")).alias("words"),
        F.log1p(F.regexp_count("t", F.lit("\n"))).alias("lines"),
        (size / (F.size("w") + 1)).alias("word_length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        share(r"[^\p{L}\p{N}\s]").alias("signs"),
        (F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))).alias("distinct_words"),
        F.lit(1.0).alias("const"),
    )


@query("logistic_quality")
def q_logistic_quality(spark: SparkSession, d: str) -> DataFrame:
    """Selection, scaling and logistic regression of document quality on the shape of the texts, fitted
    on three quarters of the labels, saved, reloaded and applied to all of them. Rows-only."""
    lab = T(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).where("label is not null")
    x = materialise(lab.join(text_features(T(spark, d, "documents")), "doc_id"), "text-features")
    stages = [FeatureSelector(TEXT_FEATURES, cvMin=CV_MIN, outputCol="raw_features"), *feature_scale_stages("raw_features", "features")]
    stages.append(LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01, elasticNetParam=0.0, maxIter=10))
    path = os.path.join(scratch_table_dir(spark, "models"), "quality")
    Pipeline(stages=stages).fit(x.where("doc_id % 4 <> 0")).write().overwrite().save(path)
    return PipelineModel.load(path).transform(x).select("doc_id", "label", "prediction", "probability")


# --------------------------------------------------------- E8, mergeable
SKETCHED = ["l_extendedprice", "l_quantity", "l_discount"]
SKETCH_BINS = 500


@query(
    "quantile_sketch_bins",
    " UNION ALL ".join(f"SELECT '{c}' AS column, COUNT({c}) AS n, true AS within FROM lineitem" for c in SKETCHED),
)
def q_quantile_sketch_bins(spark: SparkSession, d: str) -> DataFrame:
    """E8 approximate: a sketch per column and month, stored and merged; whether all ranks of 500 bins are within 1e-3."""
    li = T(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), *SKETCHED)
    stored = materialise(quantile_sketches(li, SKETCHED, ["month"]), "sketches")
    errors = rank_errors(li, sketched_quantiles(stored, SKETCH_BINS))
    return errors.select("column", "n", (F.col("worst") <= 1e-3).alias("within"))


# ------------------------------------------------------------------ E9
MERGED = {"qty_bin": "(qty - 1) // 5", "discount_bin": "CAST(round(l_discount * 100) AS BIGINT)", "tax_bin": "CAST(round(l_tax * 100) AS BIGINT)"}
MAX_GROUPS = 4
SQL_OPTIMAL = f"""
WITH x AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM ({SQL_LINES})),
counted AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({e} AS INTEGER) AS bin, label FROM x" for f, e in MERGED.items())}),
cells AS (SELECT feature, bin, SUM(label) AS e, COUNT(*) - SUM(label) AS ne, row_number() OVER (PARTITION BY feature ORDER BY bin) - 1 AS i,
                 COUNT(*) OVER (PARTITION BY feature) AS n, CAST(SUM(SUM(label)) OVER (PARTITION BY feature) AS DOUBLE) AS et,
                 CAST(SUM(COUNT(*) - SUM(label)) OVER (PARTITION BY feature) AS DOUBLE) AS nt
          FROM counted WHERE bin IS NOT NULL GROUP BY feature, bin),
cuts AS (SELECT c.*, m FROM cells c, range(0, 2048) r(m) WHERE m < (1 << (n - 1)::INT) AND bit_count(m) < {MAX_GROUPS}),
grouped AS (SELECT feature, m, bit_count(m & ((1 << i::INT) - 1)) AS grp, MIN(bin) AS first_bin, MAX(bin) AS last_bin,
                   CAST(SUM(e) AS BIGINT) AS events, CAST(SUM(ne) AS BIGINT) AS non_events, any_value(et) AS et, any_value(nt) AS nt
            FROM cuts GROUP BY ALL),
weighed AS (SELECT *, ln(((events + 0.5) / et) / ((non_events + 0.5) / nt)) AS woe,
                   ((events + 0.5) / et - (non_events + 0.5) / nt) * ln(((events + 0.5) / et) / ((non_events + 0.5) / nt)) AS iv FROM grouped),
stepped AS (SELECT *, woe - lag(woe) OVER (PARTITION BY feature, m ORDER BY grp) AS step FROM weighed),
ranked AS (SELECT feature, m, row_number() OVER (PARTITION BY feature ORDER BY SUM(iv) DESC, COUNT(*)) AS place
           FROM stepped GROUP BY feature, m HAVING COUNT(*) FILTER (step <= 0) = 0 OR COUNT(*) FILTER (step >= 0) = 0)
SELECT feature, CAST(grp AS INTEGER) AS grp, first_bin, last_bin, events, non_events, round(woe, 9) AS woe, round(iv, 9) AS iv
FROM weighed JOIN ranked USING (feature, m) WHERE place = 1
"""


@query("optimal_bins", SQL_OPTIMAL)
def q_optimal_bins(spark: SparkSession, d: str) -> DataFrame:
    """Adjacent bins of three columns merged to at most 4 with monotone WOE and the largest information value."""
    x = lines_fixed(spark, d).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    cent = lambda c: F.round(F.col(c) * 100).cast("int")
    x = x.select("label", F.floor((F.col("qty") - 1) / 5).cast("int").alias("qty_bin"), cent("l_discount").alias("discount_bin"), cent("l_tax").alias("tax_bin"))
    out = optimal_bins(x, list(MERGED), "label", MAX_GROUPS)
    return out.withColumns({"woe": F.round("woe", 9), "iv": F.round("iv", 9)})
