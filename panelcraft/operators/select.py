"""Feature selection and the k-sigma outlier filter."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param
from pyspark.ml.param import Params
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable
from pyspark.ml.util import DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.operators.profile import column_stats
from panelcraft.operators.profile import mean_std_exprs


def near_constant(df: DataFrame, cols: list[str], eps: float = 1e-6) -> DataFrame:
    """Per column, max - min and whether it passes (spread > eps). One pass, one row per column."""
    g = df.agg(*[F.max(c).cast("double").alias(f"{i}_mx") for i, c in enumerate(cols)],
               *[F.min(c).cast("double").alias(f"{i}_mn") for i, c in enumerate(cols)])
    parts = [
        g.select(
            F.lit(c).alias("column"),
            (F.col(f"{i}_mx") - F.col(f"{i}_mn")).alias("spread"),
            F.coalesce(F.col(f"{i}_mx") - F.col(f"{i}_mn") > F.lit(eps), F.lit(False)).alias("keep"),
        )
        for i, c in enumerate(cols)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_by_statistic(df: DataFrame, cols: list[str], cv_min: float | None = 0.001, skew_max: float | None = None) -> DataFrame:
    """Keep columns with cv >= cv_min (take high) and skewness <= skew_max (take low)."""
    st = column_stats(df, cols)
    keep = F.lit(True)
    if cv_min is not None:
        keep = keep & F.coalesce(F.col("cv") >= F.lit(cv_min), F.lit(False))
    if skew_max is not None:
        keep = keep & F.coalesce(F.col("skewness") <= F.lit(skew_max), F.lit(False))
    return st.withColumn("keep", keep)


def top_by_iv(iv: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Features by information value, top-k and/or above a threshold."""
    out = iv
    if threshold is not None:
        out = out.where(F.col("iv") >= F.lit(threshold))
    out = out.orderBy(F.col("iv").desc(), F.col("feature"))
    return out.limit(k) if k is not None else out


def outlier_filter(df: DataFrame, col: str, by: list[str], k: float = 2.0) -> DataFrame:
    """Keep rows with |x - mean_g| <= k * std_g (sample std of the row's group).

    Group statistics are a partial aggregate joined back on the group key
    (not a window), so a group holding a third of all rows is never sorted
    or buffered in one task. Single-row groups have a NULL std and drop out.
    """
    aggs, mean, std = mean_std_exprs(df, col, 1, prefix="__")
    stats = df.groupBy(*by).agg(*aggs).select(*by, mean.alias("__mean"), std.alias("__std"))
    j = df.join(stats, by, "inner")
    keep = F.abs(F.col(col).cast("double") - F.col("__mean")) <= F.lit(k) * F.col("__std")
    return j.where(keep).select(*df.columns)


class FeatureSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """E12 + E13 (+ E14) as a pipeline stage, fitted by two aggregations without a shuffle of rows.

    A column of ``inputCols`` is kept if ``max - min > eps``, its coefficient of
    variation is at least ``cvMin`` and its skewness at most ``skewMax`` (each only if
    set). The fitted stage drops the other input columns, keeps all names, and with
    ``outputCol`` also gives the kept columns as a vector for the next stage.
    """

    inputCols = Param(Params._dummy(), "inputCols", "columns to choose from", TypeConverters.toListString)
    eps = Param(Params._dummy(), "eps", "least spread", TypeConverters.toFloat)
    cvMin = Param(Params._dummy(), "cvMin", "least coefficient of variation", TypeConverters.toFloat)
    skewMax = Param(Params._dummy(), "skewMax", "largest skewness", TypeConverters.toFloat)
    outputCol = Param(Params._dummy(), "outputCol", "vector of the kept columns", TypeConverters.toString)

    def __init__(
        self, inputCols: list[str] | None = None, eps: float = 1e-6, cvMin: float | None = None, skewMax: float | None = None,
        outputCol: str | None = None,
    ):
        super().__init__()
        given = {"inputCols": inputCols, "eps": eps, "cvMin": cvMin, "skewMax": skewMax, "outputCol": outputCol}
        self._set(**{k: v for k, v in given.items() if v is not None})

    def statistics(self, df: DataFrame) -> DataFrame:
        """``column, spread, cv, skewness, keep``."""
        names = self.getOrDefault("inputCols")
        bounds = [
            F.struct(F.lit(c).alias("column"), (F.max(f"`{c}`").cast("double") - F.min(f"`{c}`").cast("double")).alias("spread")) for c in names
        ]
        spread = df.agg(F.array(*bounds).alias("s")).select(F.inline("s"))
        stats = column_stats(df, names).select("column", "cv", "skewness")
        keep = F.col("spread") > self.getOrDefault("eps")
        if self.isDefined("cvMin"):
            keep = keep & (F.col("cv") >= self.getOrDefault("cvMin"))
        if self.isDefined("skewMax"):
            keep = keep & (F.col("skewness") <= self.getOrDefault("skewMax"))
        return spread.join(F.broadcast(stats), "column").withColumn("keep", F.coalesce(keep, F.lit(False)))  # a row for each column

    def _fit(self, df: DataFrame) -> FeatureSelectorModel:
        kept = {r.column for r in self.statistics(df).where("keep").collect()}
        names = self.getOrDefault("inputCols")
        model = FeatureSelectorModel(names, [c for c in names if c in kept])
        if self.isDefined("outputCol"):
            model._set(outputCol=self.getOrDefault("outputCol"))
        return model


class FeatureSelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns that were not selected."""

    inputCols = Param(Params._dummy(), "inputCols", "columns chosen from", TypeConverters.toListString)
    selectedCols = Param(Params._dummy(), "selectedCols", "columns kept", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of the kept columns", TypeConverters.toString)

    def __init__(self, inputCols: list[str] | None = None, selectedCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, selectedCols=selectedCols)

    def selected(self) -> list[str]:
        return list(self.getOrDefault("selectedCols"))

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = self.selected()
        out = df.drop(*(c for c in self.getOrDefault("inputCols") if c not in kept))
        if self.isDefined("outputCol"):
            out = VectorAssembler(inputCols=kept, outputCol=self.getOrDefault("outputCol"), handleInvalid="keep").transform(out)
        return out
