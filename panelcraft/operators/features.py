"""Group-mean features broadcast back to rows.

The windows are partitioned by keys that start with the entity id, so on a
panel already hash-partitioned by id (see ``operators.monthly``) they add a
sort but no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.functions.aggregates import int_div
from panelcraft.functions.aggregates import mean_expr
from panelcraft.functions.scalar import is_integral


def group_mean(df: DataFrame, specs: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``{out: (col, by)}``, each ``out = mean(col) over (partition by by)``.

    Includes the row's own value (the reference formula, which leaks the
    label into its own feature; see :func:`leave_one_out_mean`).
    """
    return df.withColumns({out: mean_expr(df, col, Window.partitionBy(*by)) for out, (col, by) in specs.items()})


def leave_one_out_mean(df: DataFrame, specs: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Mean of the *other* rows of the group; NULL for a single-row group."""
    cols = {}
    for out, (col, by) in specs.items():
        w = Window.partitionBy(*by)
        s = F.sum(col).over(w) - F.coalesce(F.col(col), F.lit(0))
        n = F.count(col).over(w) - F.when(F.col(col).isNotNull(), 1).otherwise(0)
        if is_integral(df, col):
            cols[out] = F.when(n > 0, int_div(s, n))
        else:
            cols[out] = F.try_divide(s, n)
    return df.withColumns(cols)
