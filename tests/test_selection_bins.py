"""Fitted selection, mergeable sketches and optimal bins."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelcraft.operators.binning import contingency
from panelcraft.operators.binning import optimal_merge
from panelcraft.operators.binning import quantile_sketches
from panelcraft.operators.binning import rank_errors
from panelcraft.operators.binning import sketched_quantiles
from panelcraft.operators.select import FeatureSelector
from panelcraft.operators.select import FeatureSelectorModel


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(500).select(
        "id", F.lit(3).cast("long").alias("flat"), (F.col("id") % 9).alias("cycle"), (F.lit(10**6) + F.col("id") % 2).alias("steady"),
        F.exp(F.col("id") / 40.0).alias("skewed"), F.lit(None).cast("double").alias("missing"),
    )


def test_selector_is_fitted_saved_and_applied(spark, frame, tmp_path):
    cols = ["flat", "cycle", "steady", "skewed", "missing"]
    fitted = FeatureSelector(cols, cvMin=0.001, skewMax=1.0).fit(frame)
    assert fitted.selected() == ["cycle"]
    assert FeatureSelector(cols, cvMin=0.001).fit(frame).selected() == ["cycle", "skewed"]
    assert FeatureSelector(cols).fit(frame).selected() == ["cycle", "steady", "skewed"]
    fitted.write().overwrite().save(str(tmp_path / "m"))
    again = FeatureSelectorModel.load(str(tmp_path / "m"))
    other = frame.where("id < 3").withColumn("kept", F.lit(1))
    assert again.transform(other).columns == ["id", "cycle", "kept"]  # also columns that are constant in the new rows


def test_selector_as_a_stage(spark, frame, tmp_path):
    stages = [FeatureSelector(["flat", "cycle", "steady"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="skewed")]
    model = Pipeline(stages=stages).fit(frame)
    model.write().overwrite().save(str(tmp_path / "p"))
    a = [r.prediction for r in model.transform(frame).orderBy("id").collect()]
    b = [r.prediction for r in PipelineModel.load(str(tmp_path / "p")).transform(frame).orderBy("id").collect()]
    assert a == b and len(model.stages[-1].coefficients) == 2


def test_selector_without_rows(spark, frame):
    assert FeatureSelector(["cycle", "skewed"]).fit(frame.limit(0)).selected() == []


def test_sketches_merge_within_their_error(spark):
    rnd = random.Random(1)
    rows = [(k % 5, rnd.gauss(0, 1), float(rnd.randint(0, 3)), None if k % 7 else math.nan) for k in range(20_000)]
    df = spark.createDataFrame(rows, "day int, a double, b double, c double")
    sketches = quantile_sketches(df, ["a", "b", "c"], ["day"])
    assert sketches.count() == 10  # a column without values has none
    quantiles = sketched_quantiles(sketches, 500)
    found = {r.column: r for r in rank_errors(df, quantiles).collect()}
    assert set(found) == {"a", "b"} and len(set(quantiles["b"])) == 4
    assert all(r.worst <= 1e-3 and r.n == 20_000 for r in found.values())
    assert rank_errors(df, {"a": [v + 0.1 for v in quantiles["a"]]}).first().worst > 0.01


def test_contingency_of_several_columns(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, None, 0), (1, 1, 1), (1, 1, None)], "a int, b int, y int")
    got = {tuple(r) for r in contingency(df, ["a", "b"], "y").collect()}
    assert got == {("a", 0, 1, 1), ("a", 1, 1, 0), ("b", 1, 2, 0)}


def iv_of(groups, e_t, ne_t):
    woe = [math.log(((e + 0.5) / e_t) / ((ne + 0.5) / ne_t)) for e, ne in groups]
    steps = [b - a for a, b in zip(woe, woe[1:])]
    if any(s <= 0 for s in steps) and any(s >= 0 for s in steps):
        return None
    return sum(((e + 0.5) / e_t - (ne + 0.5) / ne_t) * w for (e, ne), w in zip(groups, woe))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=7), st.integers(1, 4))
def test_optimal_merge_equals_exhaustive_search(cells, max_bins):
    n, e_t, ne_t = len(cells), float(sum(e for e, _ in cells)) or 1.0, float(sum(x for _, x in cells)) or 1.0
    best = -math.inf
    for k in range(min(max_bins, n)):
        for cuts in itertools.combinations(range(1, n), k):
            ends = [0, *cuts, n]
            groups = [tuple(map(sum, zip(*cells[a:b]))) for a, b in zip(ends, ends[1:])]
            iv = iv_of(groups, e_t, ne_t)
            if iv is not None:
                best = max(best, iv)
    got = optimal_merge([(10 * i, e, x) for i, (e, x) in enumerate(cells)], max_bins)
    assert len(got) <= max_bins and got[0][0] == 0 and got[-1][1] == 10 * (n - 1)
    assert all(a[1] + 10 == b[0] for a, b in zip(got, got[1:]))
    assert math.isclose(sum(g[5] for g in got), best, rel_tol=1e-9, abs_tol=1e-12)
    assert optimal_merge([], 3) == []
