"""Masking and imputation.

Group means broadcast to rows are windows partitioned by the group key (no
global ordering); global means are fitted as one-row aggregates, brought to
the driver as scalars (a single row, so bounded) and applied as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelcraft.functions.aggregates import mean_expr
from panelcraft.functions.scalar import in_period
from panelcraft.functions.scalar import is_integral


def mask_period(df: DataFrame, cols: list[str], year: str, quarter: str, target_year: int, target_quarter: int) -> DataFrame:
    """Set ``cols`` to NULL in the target period (apply before filling)."""
    cond = in_period(year, quarter, target_year, target_quarter)
    return df.withColumns({c: F.when(~cond, F.col(c)) for c in cols})


def fill_group_mean(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """NULL <- mean of the observed values of the same group."""
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.coalesce(F.col(c), mean_expr(df, c, w)) for c in cols})


def global_means(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """One-row fit: mean per column (fixed-point columns: exact ``sum div count``)."""
    exprs = []
    for c in cols:
        if is_integral(df, c):
            exprs += [F.sum(F.col(c).cast("decimal(38,0)")).alias(f"{c}__s"), F.count(c).alias(f"{c}__n")]
        else:
            exprs.append(F.avg(c).alias(c))
    row = df.agg(*exprs).first().asDict()
    out = {}
    for c in cols:
        if is_integral(df, c):
            s, n = row[f"{c}__s"], row[f"{c}__n"]
            out[c] = None if not n else int(_trunc_div(int(s), int(n)))
        else:
            out[c] = row[c]
    return out


def _trunc_div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a >= 0) == (b >= 0) else -q


def fill_global_mean(df: DataFrame, cols: list[str], means: dict[str, object] | None = None) -> DataFrame:
    """NULL <- global mean (fitted on ``df`` unless ``means`` is given)."""
    means = means if means is not None else global_means(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast(df.schema[c].dataType)) for c in cols})


def fill_value(df: DataFrame, cols: list[str], value) -> DataFrame:
    """A6 variant: NULL <- a constant (e.g. 0)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in cols})


def replace_zero_with_mean(df: DataFrame, col: str, mean=None) -> DataFrame:
    """O6 (intended behaviour): ``col == 0`` <- mean of ``col`` over all rows (zeros included)."""
    m = mean if mean is not None else global_means(df, [col])[col]
    return df.withColumn(col, F.when(F.col(col) == 0, F.lit(m).cast(df.schema[col].dataType)).otherwise(F.col(col)))


def overwrite_rows(df: DataFrame, col: str, mean=None) -> DataFrame:
    """O7 (parity flag): rows where ``col == 0`` get the mean in *every* numeric column."""
    m = mean if mean is not None else global_means(df, [col])[col]
    cond = F.col(col) == 0
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType):
            out.append(F.when(cond, F.lit(m).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean imputation at load time (same as A6, kept as its own name)."""
    return fill_global_mean(df, cols)


def replace_tokens(df: DataFrame, cols: list[str], tokens: list, value) -> DataFrame:
    """Designated outlier values -> replacement value."""
    return df.withColumns(
        {c: F.when(F.col(c).isin(*tokens), F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in cols}
    )
