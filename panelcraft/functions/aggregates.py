"""Aggregate helpers shared by the operators.

Fixed-point convention: money columns may be carried as BIGINT in units of
``10**-scale``. For those, sums are exact and a mean is ``sum div count``
(integer, truncated toward zero at the fixed-point resolution), so every
engine computes bit-identical results regardless of summation order. For
floating columns the ordinary ``avg`` is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import WindowSpec


def int_div(a: Column, b: Column) -> Column:
    """Integer division (SQL ``div``), NULL when either side is NULL."""
    return F.call_function("div", a, b)


def _integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, IntegralType)


def mean_expr(df: DataFrame, name: str, window: WindowSpec | None = None) -> Column:
    """Mean of ``name`` as an aggregate (or over ``window``).

    Integral columns: ``sum div count`` (BIGINT); NULL when there is no
    non-NULL value. Floating columns: ``avg``.
    """
    c = F.col(name)
    if _integral(df, name):
        s, n = F.sum(c), F.count(c)
        if window is not None:
            s, n = s.over(window), n.over(window)
        return F.when(n > 0, int_div(s, n))
    a = F.avg(c)
    return a.over(window) if window is not None else a


def exact_sum_expr(df: DataFrame, name: str) -> Column:
    """Sum that never overflows for integral inputs (DECIMAL(38,0) accumulator)."""
    c = F.col(name)
    if _integral(df, name):
        return F.sum(c.cast("decimal(38,0)"))
    return F.sum(c)
