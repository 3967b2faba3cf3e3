"""Interval facts spread over calendar months.

An interval fact (id, start, end, amount) covers every calendar month from
``start`` to ``end`` inclusive after both are floored to the month. The
amount is divided equally over those ``n`` months. Inverted or incomplete
intervals cannot be expanded; they go to a quarantine frame instead of
failing the job (``sequence`` raises on start > end).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.functions.aggregates import int_div
from panelcraft.functions.scalar import is_integral
from panelcraft.functions.scalar import month_floor


def month_count(ms: Column, me: Column) -> Column:
    """Number of calendar months from ``ms`` to ``me`` inclusive (both month starts)."""
    return (F.year(me) - F.year(ms)) * 12 + F.month(me) - F.month(ms) + 1


def quarantine_reason(ms: Column, me: Column) -> Column:
    return (
        F.when(ms.isNull(), F.lit("null_start"))
        .when(me.isNull(), F.lit("null_end"))
        .when(ms > me, F.lit("inverted"))
    )


def floor_interval(df: DataFrame, start: str, end: str, ms: str = "ms", me: str = "me") -> DataFrame:
    return df.withColumns({ms: month_floor(start), me: month_floor(end)})


def split_intervals(
    df: DataFrame, start: str, end: str, ms: str = "ms", me: str = "me"
) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine). Quarantine rows carry a ``reason`` column."""
    floored = floor_interval(df, start, end, ms, me)
    reason = quarantine_reason(F.col(ms), F.col(me))
    valid = floored.where(reason.isNull())
    bad = floored.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return valid, bad


def prorate_expr(amount: Column, n: Column, integral: bool) -> Column:
    """Equal share of ``amount`` per month: exact ``div`` for fixed-point amounts."""
    return int_div(amount, n) if integral else F.try_divide(amount, n)


def prorate(
    valid: DataFrame,
    amount: str,
    ms: str = "ms",
    me: str = "me",
    n_col: str = "n_months",
    rate: str = "rate",
) -> DataFrame:
    """Add the month count and the per-month share. ``n`` is computed without exploding."""
    n = month_count(F.col(ms), F.col(me))
    out = valid.withColumn(n_col, n)
    return out.withColumn(rate, prorate_expr(F.col(amount), F.col(n_col), is_integral(valid, amount)))


def expand_months(df: DataFrame, ms: str = "ms", me: str = "me", month: str = "month") -> DataFrame:
    """J1 literal form: one row per covered month (a Generate, no shuffle).

    Only call on valid intervals (see :func:`split_intervals`).
    """
    seq = F.sequence(F.col(ms), F.col(me), F.expr("INTERVAL 1 MONTH"))
    return df.withColumn(month, F.explode(seq))


def monthly_sum(expanded: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """A1: total per key and month (partial aggregation happens before the shuffle)."""
    return expanded.groupBy(*keys).agg(F.sum(value).alias(out))


def monthly_totals(
    df: DataFrame,
    *,
    id_col: str,
    start: str,
    end: str,
    amount: str,
    out: str = "amount",
    count_out: str | None = "n_intervals",
) -> DataFrame:
    """J1 + J2 + A1 without materialising every (interval, month) pair.

    Each valid interval emits ``+rate`` at its first month and ``-rate`` at
    the month after its last (a difference array); one ``groupBy(id, month)``
    with map-side partial aggregation folds them, one window per id takes the
    running sums, and each change point is expanded to the months up to the
    next change point. Work and shuffle volume are proportional to the input
    rows plus the output months, not to the sum of interval lengths. With
    fixed-point amounts the result equals exploding and summing bit for bit.
    Months covered by no interval produce no row.
    """
    valid, _ = split_intervals(df.select(id_col, start, end, amount), start, end)
    integral = is_integral(df, amount)
    rate = prorate_expr(F.col(amount), month_count(F.col("ms"), F.col("me")), integral)
    dtype = "bigint" if integral else "double"
    ev = F.array(
        F.struct(F.col("ms").alias("m"), rate.cast(dtype).alias("d"), F.lit(1).alias("c")),
        F.struct(F.add_months(F.col("me"), 1).alias("m"), (-rate).cast(dtype).alias("d"), F.lit(-1).alias("c")),
    )
    deltas = (
        valid.where(F.col(id_col).isNotNull())
        .select(id_col, F.explode(ev).alias("e"))
        .groupBy(id_col, F.col("e.m").alias("m"))
        .agg(F.sum("e.d").alias("d"), F.sum("e.c").alias("c"))
    )
    w = Window.partitionBy(id_col).orderBy("m")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = deltas.select(
        id_col,
        "m",
        F.sum("d").over(run).alias("v"),
        F.sum("c").over(run).alias("n"),
        F.lead("m").over(w).alias("next_m"),
    ).where((F.col("n") > 0) & F.col("next_m").isNotNull())
    months = F.sequence(F.col("m"), F.add_months(F.col("next_m"), -1), F.expr("INTERVAL 1 MONTH"))
    cols = [F.col(id_col), F.explode(months).alias("month"), F.col("v").alias(out)]
    if count_out:
        cols.append(F.col("n").cast("bigint").alias(count_out))
    return seg.select(*cols)
