"""Z-score (population std), MLlib standard scaling, robust (IQR) scaling.

Fit steps are one-row aggregates (or the distributed exact quantiles) whose
results are a handful of scalars; transforms apply them as literals, so the
transform is a narrow projection with no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.quantiles import interpolated_quantiles
from panelcraft.functions.quantiles import power_sums
from panelcraft.functions.scalar import is_integral


@dataclass
class ZScoreStats:
    integral: bool
    n: int
    s1: object  # exact int for integral columns
    s2: object
    mean: float | None = None
    std: float | None = None


def fit_zscore(df: DataFrame, cols: list[str]) -> dict[str, ZScoreStats]:
    """E5 fit: population statistics per column (one pass for all columns)."""
    aggs, plan = [], {}
    for i, c in enumerate(cols):
        if is_integral(df, c):
            aggs += power_sums(df, c, 2, prefix=f"c{i}_")
            plan[c] = (True, i)
        else:
            aggs += [F.count(c).alias(f"c{i}_n"), F.avg(c).alias(f"c{i}_m"), F.stddev_pop(c).alias(f"c{i}_sd")]
            plan[c] = (False, i)
    row = df.agg(*aggs).first().asDict()
    out = {}
    for c, (integral, i) in plan.items():
        if integral:
            s1, s2 = row[f"c{i}_s1"], row[f"c{i}_s2"]
            out[c] = ZScoreStats(True, row[f"c{i}_n"], None if s1 is None else int(s1), None if s2 is None else int(s2))
        else:
            out[c] = ZScoreStats(False, row[f"c{i}_n"], None, None, row[f"c{i}_m"], row[f"c{i}_sd"])
    return out


def transform_zscore(df: DataFrame, stats: dict[str, ZScoreStats], suffix: str = "") -> DataFrame:
    """E5 transform: (x - mean) / population std; NULL for a constant column (no error).

    Integral columns: (n*x - s1) / sqrt(n*s2 - s1^2), exact numerator and a
    single rounding of the exact variance numerator.
    """
    cols = {}
    for c, st in stats.items():
        x = F.col(c)
        if st.integral:
            if not st.n:
                cols[c + suffix] = F.lit(None).cast("double")
                continue
            d = st.n * st.s2 - st.s1 * st.s1
            num = (x.cast("decimal(38,0)") * F.lit(st.n) - F.lit(st.s1).cast("decimal(38,0)")).cast("double")
            den = F.lit(math.sqrt(float(d)))  # d is a whole number of any size here
            cols[c + suffix] = F.when(den > 0, num / den)
        else:
            cols[c + suffix] = F.when(F.lit(st.std) > 0, (x - F.lit(st.mean)) / F.lit(st.std)) if st.std else F.lit(None).cast("double")
    return df.withColumns(cols)


def zscore(df: DataFrame, cols: list[str], fitted: dict[str, ZScoreStats] | None = None, suffix: str = "") -> DataFrame:
    """E5: each split scaled by its own statistics unless ``fitted`` (train statistics) is given."""
    return transform_zscore(df, fitted if fitted is not None else fit_zscore(df, cols), suffix)


def feature_scale_stages(input_col: str, output_col: str):
    """MLlib standard scaling (mean and *sample* std) as a pipeline stage."""
    from pyspark.ml.feature import StandardScaler

    return [StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)]


@dataclass
class RobustStats:
    center: float
    iqr: float


def fit_robust(df: DataFrame, cols: list[str], center: bool = False) -> dict[str, RobustStats]:
    """E7 fit: exact interpolated quartiles (IQR, and the median when centering)."""
    out = {}
    for c in cols:
        q = interpolated_quantiles(df, c, [0.25, 0.5, 0.75])
        if q[0.25] is None:
            out[c] = RobustStats(0.0, 0.0)
            continue
        out[c] = RobustStats(q[0.5] if center else 0.0, q[0.75] - q[0.25])
    return out


def robust_scale(df: DataFrame, stats: dict[str, RobustStats], suffix: str = "") -> DataFrame:
    """E7 transform: (x - center) / IQR; an IQR of 0 leaves the values only centered."""
    cols = {}
    for c, st in stats.items():
        scale = st.iqr if st.iqr != 0 else 1.0
        cols[c + suffix] = (F.col(c).cast("double") - F.lit(st.center)) / F.lit(scale)
    return df.withColumns(cols)


def robust_inverse(df: DataFrame, stats: dict[str, RobustStats], suffix: str = "") -> DataFrame:
    """E7 inverse: x * IQR + center."""
    cols = {}
    for c, st in stats.items():
        scale = st.iqr if st.iqr != 0 else 1.0
        cols[c + suffix] = F.col(c) * F.lit(scale) + F.lit(st.center)
    return df.withColumns(cols)
