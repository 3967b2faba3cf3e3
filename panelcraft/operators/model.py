"""MLlib pipelines for the panel (boosted trees, linear and logistic models).

The modelling DAG of the reference (readers -> typing -> intersection ->
binning -> boosted trees -> evaluation, then deploy + predict) maps onto
one ``pyspark.ml.Pipeline``: the intersection is a key join done before
(J8), binning is a fitted ``Bucketizer``/``QuantileDiscretizer`` stage, the
model is an MLlib estimator and evaluation is ``RegressionEvaluator`` or the
SQL metrics of ``operators.evaluate``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import QuantileDiscretizer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.operators.gbt import PackedGBTRegressor
from panelcraft.operators.scale import feature_scale_stages


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Training input in so many partitions, or as it is.

    Iterative learners run every pass with the input's partitioning, so an
    input read from a few large files trains in a few tasks. The count is the
    caller's: tree learners sample split points by partition, and a model must
    not depend on the cluster it is trained on.
    """
    return df if partitions is None else df.repartition(partitions)


def partitions_by_rows(df: DataFrame, least: int, rows_each: int = 1_000_000) -> int:
    """Partitions for :func:`spread` that grow with the rows and depend on nothing else."""
    return max(least, -(-df.count() // rows_each))


def fit(pipeline: Pipeline, df: DataFrame, partitions: int | None = None) -> PipelineModel:
    """Fit a pipeline on a cached copy of ``df`` (the cache is released afterwards)."""
    data = spread(df, partitions).cache()
    try:
        return pipeline.fit(data)
    finally:
        data.unpersist()


def typed_label(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    """Label column as DOUBLE (a party without a label simply has none)."""
    return df.withColumn(out, F.col(label).cast("double"))


def binning_stage(features: list[str], n_bins: int = 500, relative_error: float = 1e-3, suffix: str = "_bin"):
    """E8 as a pipeline stage: fitted quantile edges reused on validation and test."""
    return QuantileDiscretizer(
        numBuckets=n_bins,
        relativeError=relative_error,
        inputCols=features,
        outputCols=[f + suffix for f in features],
        handleInvalid="keep",
    )


def gbt_pipeline(
    features: list[str],
    label: str = "label",
    *,
    n_trees: int = 14,
    depth: int = 4,
    step: float = 0.2,
    max_bins: int = 1000,
    bin_features: int | None = 500,
    subsampling: float = 1.0,
    seed: int = 42,
) -> Pipeline:
    """M5 + M8: optional quantile binning (E8) -> assembler -> squared-loss boosted trees."""
    stages = []
    cols = features
    if bin_features:
        stages.append(binning_stage(features, bin_features))
        # bin numbers are ordinal: the cast drops the nominal metadata the discretizer
        # attaches, so trees split on bin thresholds instead of treating bins as categories
        casts = ", ".join(f"CAST(`{f}_bin` AS DOUBLE) AS `{f}_ord`" for f in features)
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        cols = [f + "_ord" for f in features]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    stages.append(
        PackedGBTRegressor(
            featuresCol="features",
            labelCol=label,
            lossType="squared",
            maxIter=n_trees,
            maxDepth=depth,
            stepSize=step,
            maxBins=max_bins,
            subsamplingRate=subsampling,
            seed=seed,
        )
    )
    return Pipeline(stages=stages)


def linear_pipeline(features: list[str], label: str = "label", *, reg: float = 0.01, max_iter: int = 10, scale: bool = True) -> Pipeline:
    """M6 (+ E6): L2 linear regression on standard-scaled features."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")]
    if scale:
        stages += feature_scale_stages("raw_features", "features")
    else:
        stages[0].setOutputCol("features")
    stages.append(LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0, maxIter=max_iter))
    return Pipeline(stages=stages)


def logistic_pipeline(features: list[str], label: str = "label", *, reg: float = 0.01, max_iter: int = 10) -> Pipeline:
    """M7 (+ E6): L2 logistic regression; the label must be binary."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")]
    stages += feature_scale_stages("raw_features", "features")
    stages.append(LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0, maxIter=max_iter))
    return Pipeline(stages=stages)


def iteration_history(model: PipelineModel, data: DataFrame) -> DataFrame:
    """Squared loss after each boosting iteration on ``data`` (a few rows, one per tree)."""
    gbt = model.stages[-1]
    prepared = PipelineModel(stages=model.stages[:-1]).transform(data)
    losses = gbt.evaluateEachIteration(prepared, "squared")
    spark = data.sparkSession
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")


def feature_importances(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """Feature importances of the fitted trees."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, imp, strict=False)), "feature string, importance double")


def deploy(model: PipelineModel, stage_indexes: list[int] | None = None) -> PipelineModel:
    """M9: a prediction pipeline from chosen fitted stages (all by default)."""
    stages = model.stages if stage_indexes is None else [model.stages[i] for i in stage_indexes]
    return PipelineModel(stages=stages)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Load a fitted pipeline."""
    return PipelineModel.load(path)


def cross_validate(pipeline: Pipeline, data: DataFrame, fold_col: str, num_folds: int, label: str = "label") -> tuple:
    """M3 with fixed fold ids in [0, num_folds): ``CrossValidator(foldCol=...)`` scoring RMSE; returns (model, avg metrics)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, foldCol=fold_col, numFolds=num_folds
    )
    m = cv.fit(data)
    return m, list(m.avgMetrics)
