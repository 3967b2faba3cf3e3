"""Frequency tables, describe, grouped mean/std, histogram, column statistics.

All statistics are partial-aggregated (bounded buffers per group); exact
quantiles come from ``functions.quantiles`` (distributed selection), never
from a single-task percentile buffer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.quantiles import centred_sums
from panelcraft.functions.quantiles import exact_mean
from panelcraft.functions.quantiles import exact_std
from panelcraft.functions.quantiles import interpolated_quantiles
from panelcraft.functions.quantiles import power_sums
from panelcraft.functions.scalar import is_integral


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Frequency per value (NULL values dropped, as pandas does)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def mean_std_exprs(df: DataFrame, col: str, ddof: int = 1, prefix: str = "") -> tuple[list[Column], Column, Column]:
    """(aggregates, mean expr, std expr) for use after ``agg``: exact for integral columns."""
    if is_integral(df, col):
        aggs = power_sums(df, col, 2, prefix)
        n, s1, s2 = (F.col(f"{prefix}{k}") for k in ("n", "s1", "s2"))
        return aggs, exact_mean(n, s1), exact_std(n, s1, s2, ddof)
    std = F.stddev_samp(col) if ddof == 1 else F.stddev_pop(col)
    aggs = [F.avg(col).alias(f"{prefix}mean"), std.alias(f"{prefix}std")]
    return aggs, F.col(f"{prefix}mean"), F.col(f"{prefix}std")


def describe(df: DataFrame, col: str, scale: float = 1.0) -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles, max (one row).

    ``scale`` divides every value statistic (fixed-point input -> units).
    """
    aggs, mean, std = mean_std_exprs(df, col, 1, prefix="__")
    base = df.agg(*aggs, F.count(col).alias("__count"), F.min(col).alias("__min"), F.max(col).alias("__max"))
    q = interpolated_quantiles(df, col, [0.25, 0.5, 0.75])
    sc = F.lit(float(scale))
    return base.select(
        F.col("__count").alias("count"),
        (mean / sc).alias("mean"),
        (std / sc).alias("std"),
        (F.col("__min").cast("double") / sc).alias("min"),
        *[(F.lit(q[p]).cast("double") / sc).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))],
        (F.col("__max").cast("double") / sc).alias("max"),
    )


def mean_std_by(df: DataFrame, by: list[str], col: str, scale: float = 1.0) -> DataFrame:
    """A10: per-group mean and sample std."""
    aggs, mean, std = mean_std_exprs(df, col, 1)
    g = df.groupBy(*by).agg(*aggs)
    return g.select(*by, (mean / F.lit(scale)).alias("mean"), (std / F.lit(scale)).alias("std"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width counts over [min, max], last bin closed; every bin listed.

    bin = floor((x - min) * bins / (max - min)), capped at bins - 1; when
    min = max every value falls in bin 0.
    """
    st = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    mn, mx = st["mn"], st["mx"]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    x = F.col(col).cast("double")
    width = float(mx) - float(mn)
    if width == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((x - F.lit(float(mn))) * F.lit(float(bins)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # all bins, generated from the fitted range (bins rows, a parameter)
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = grid.withColumns(
        {
            "lo": F.lit(float(mn)) + F.col("bin") * F.lit(width / bins),
            "hi": F.lit(float(mn)) + (F.col("bin") + 1) * F.lit(width / bins),
        }
    )
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")
    )


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: count, mean, sample std, coefficient of variation, population skewness.

    One aggregation for all columns. Integral columns use exact power sums
    about the mean: skewness = sqrt(n) * M3 / M2^1.5 (the population form
    Spark's ``skewness`` computes).
    """
    aggs, rows = [], []
    for i, c in enumerate(cols):
        k = f"c{i}_"
        if is_integral(df, c):
            aggs += power_sums(df, c, 3, k)
            n, s1, s2, s3 = (F.col(k + x) for x in ("n", "s1", "s2", "s3"))
            m2, m3 = centred_sums(n, s1, s2, s3)
            skew = F.when(m2 > 0, F.sqrt(n.cast("double")) * m3 / (m2 * F.sqrt(m2)))
            rows.append((c, n, exact_mean(n, s1), exact_std(n, s1, s2, 1), skew))
        else:
            stats = (F.count, F.avg, F.stddev_samp, F.skewness)
            aggs += [f(c).alias(f"{k}{j}") for j, f in enumerate(stats)]
            rows.append((c, *(F.col(f"{k}{j}") for j in range(len(stats)))))
    names = ("column", "count", "mean", "std", "skewness")
    listed = F.array(*(F.struct(F.lit(c).alias(names[0]), *(x.alias(y) for x, y in zip(r, names[1:]))) for c, *r in rows))
    out = df.agg(*aggs).select(F.explode(listed).alias("r")).select("r.*")
    return out.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))
