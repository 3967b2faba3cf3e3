import os
import re
import tempfile

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import __spark_entry__ as E
from panelcraft.operators.gbt import PackedGBTRegressor
from panelcraft.operators.model import deploy
from panelcraft.operators.model import gbt_pipeline
from panelcraft.operators.model import iteration_history
from panelcraft.operators.model import load_model
from panelcraft.operators.model import partitions_by_rows
from panelcraft.operators.model import save_model
from panelcraft.operators.split import goss_sample
from panelcraft.operators.split import kfold_ids
from panelcraft.operators.split import period_split
from panelcraft.operators.split import stratified_split
from panelcraft.session import materialised
from tests.conftest import rows

SMOKE = "/root/testdata/sf0.001"


def test_kfold_sizes(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k").repartition(5)
    f = kfold_ids(df, ["k"], 5)
    sizes = [r["count"] for r in f.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    # contiguous blocks in key order
    got = [r.fold for r in f.orderBy("k").collect()]
    assert got == sorted(got)


def test_stratified_split(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("y"))
    s = stratified_split(df, "y", [3.0, 7.0], "k", 0.3, seed=None)
    per = {r["s"]: r["n"] for r in s.where("is_test").groupBy(F.floor(F.col("y") / 1).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert sum(per.values()) == 90 + 120 + 90  # floor(0.3 * 300), floor(0.3 * 400), floor(0.3 * 300)


def test_period_split(spark):
    panel = spark.createDataFrame([(1, 2021, 4), (1, 2021, 3), (2, 2021, 4)], "id long, year int, quarter int")
    test_ids = spark.createDataFrame([(1,)], "id long")
    got = rows(period_split(panel, test_ids, "id", "year", "quarter", 2021, 4))
    assert got == [(1, 2021, 3, "valid"), (1, 2021, 4, "predict"), (2, 2021, 4, "train")]


def test_goss_keeps_top_and_weights(spark):
    df = spark.range(0, 2000).select("id", ((F.col("id") * 37) % 2000).cast("double").alias("g"))
    s = goss_sample(df, "g", 0.2, 0.1, seed=1)
    top = s.where(F.col("weight") == 1.0).count()
    assert 380 <= top <= 420
    assert s.where(F.col("weight") != 1.0).agg(F.min("weight")).first()[0] == 8.0


def test_gbt_train_save_load(spark):
    df = spark.range(0, 600).select(
        (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")
    ).withColumn("label", F.col("a") * 3.0 + F.col("b") ** 2)
    model = gbt_pipeline(["a", "b"], n_trees=6, depth=3, max_bins=32, bin_features=16).fit(df)
    hist = [r.loss for r in iteration_history(model, df).orderBy("iteration").collect()]
    assert len(hist) == 6 and all(b <= a + 1e-9 for a, b in zip(hist, hist[1:]))
    var = df.agg(F.var_pop("label")).first()[0]
    assert hist[-1] < var  # better than the constant predictor
    path = os.path.join(tempfile.mkdtemp(prefix="pc-model-"), "m")
    save_model(model, path)
    a = model.transform(df).select("prediction").collect()
    b = deploy(load_model(path)).transform(df).select("prediction").collect()
    assert a == b


def test_entry_and_registry(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert out.columns == ["sid", "id", "year", "quarter", "y", "y_avg", "year_y_avg"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_train_predict_submit(spark):
    q = E.queries()
    sub = q["boosted_submission"](spark, SMOKE)
    rows_ = sub.collect()
    assert sub.columns == ["id", "predict_result"] and rows_
    test_ids = {r.c_custkey for r in spark.read.parquet(f"{SMOKE}/customer.parquet")
                .where(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")).collect()}
    ids = [r.id for r in rows_]
    assert len(ids) == len(set(ids)) and set(ids) <= test_ids  # one target-quarter row per test entity
    assert all(r.predict_result is not None for r in rows_)


def test_training_partitions_grow_with_the_rows(spark):
    df = spark.range(1001)
    assert partitions_by_rows(df, 8) == 8
    assert partitions_by_rows(df, 8, rows_each=100) == 11
    assert partitions_by_rows(df.limit(0), 8, rows_each=100) == 8


@pytest.mark.parametrize("max_bins", [32, 500])  # thresholds at strides of the rows, and between any two values
def test_packed_trees_equal_those_of_mllib(spark, max_bins):
    df = spark.range(0, 900).select(
        (F.col("id") * 7919 % 211).cast("double").alias("a"), (F.col("id") * 31 % 101 - 50).cast("double").alias("b"), F.lit(3.0).alias("c")
    ).withColumn("label", 1e12 * (F.col("a") * 3.0 + F.col("b") ** 2) + F.col("a") * F.col("b") * 1e10).repartition(3)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    how = dict(featuresCol="features", labelCol="label", maxIter=5, maxDepth=4, stepSize=0.2, maxBins=max_bins, seed=1)
    old, new = GBTRegressor(**how).fit(df), PackedGBTRegressor(**how).fit(df)
    assert new.getNumTrees == 5 and new.treeWeights == old.treeWeights and new.numFeatures == 3
    assert "/gbt-" not in "".join(materialised())
    shape = lambda m: [re.sub(r"(?<=Predict: ).*|DecisionTree.*|^GBT.*", "", t) for t in m.toDebugString.splitlines()]
    assert shape(new) == shape(old)
    a, b = ([r.prediction for r in m.transform(df).orderBy("label", "a").collect()] for m in (old, new))
    assert b == pytest.approx(a, rel=1e-9)
    assert new.featureImportances.toArray() == pytest.approx(old.featureImportances.toArray())
    assert new.evaluateEachIteration(df, "squared") == pytest.approx(old.evaluateEachIteration(df, "squared"))


def test_packed_trees_refuse_what_mllib_refuses(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, 5.0)], "a double, label double")
    with pytest.raises(Exception, match="NaN"):
        gbt_pipeline(["a"], n_trees=2, bin_features=None).fit(df)
    with pytest.raises(Exception, match="Labels MUST NOT be"):
        gbt_pipeline(["label"], label="a", n_trees=2, bin_features=None).fit(df)
