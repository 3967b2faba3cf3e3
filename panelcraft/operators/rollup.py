"""Group aggregates, first row per key, fixed-size row buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.functions.aggregates import int_div
from panelcraft.functions.scalar import is_integral


def sum_by(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """A1: total per key (NULL keys are dropped first: pandas drops NaN groups)."""
    return _drop_null_keys(df, keys).groupBy(*keys).agg(F.sum(value).alias(out))


def _drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def multi_agg(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """A2 / A3: ``{out: (kind, col)}`` with kind in mean/sum/max/min/count/mode.

    ``mean`` of a fixed-point column is ``sum div count``; ``mode`` picks the
    most frequent value and, on a tie, the smallest (``mode(col, true)``).
    Every kind has a bounded partial-aggregation buffer (``mode`` keeps one
    counter per distinct value), so skewed keys are combined map-side.
    """
    exprs, post = [], {}
    for out, (kind, col) in aggs.items():
        c = F.col(col)
        if kind == "mean":
            if is_integral(df, col):
                exprs += [F.sum(c).alias(f"__{out}_s"), F.count(c).alias(f"__{out}_n")]
                post[out] = F.when(F.col(f"__{out}_n") > 0, int_div(F.col(f"__{out}_s"), F.col(f"__{out}_n")))
            else:
                exprs.append(F.avg(c).alias(out))
        elif kind == "sum":
            exprs.append(F.sum(c).alias(out))
        elif kind == "max":
            exprs.append(F.max(c).alias(out))
        elif kind == "min":
            exprs.append(F.min(c).alias(out))
        elif kind == "count":
            exprs.append(F.count(c).alias(out))
        elif kind == "mode":
            exprs.append(F.mode(c, True).alias(out))
        else:
            raise ValueError(f"unknown aggregate {kind}")
    g = _drop_null_keys(df, keys).groupBy(*keys).agg(*exprs)
    if post:
        g = g.withColumns(post).drop(*[c for c in g.columns if c.startswith("__")])
    return g.select(*keys, *aggs.keys())


def rollup_period(
    df: DataFrame,
    keys: list[str],
    sum_cols: list[str],
    mode_cols: list[str] = (),
    keep: dict[str, str] | None = None,
) -> DataFrame:
    """A4: sum every listed column per period key; an all-NULL group sums to 0.

    ``mode_cols`` are code columns rolled up by their most frequent value
    (ties: smallest); summing codes is the reference's behaviour and is
    obtained by listing them in ``sum_cols`` instead. ``keep`` adds
    ``{out: column}`` attributes constant per group (taken with ``max``).
    """
    exprs = [F.coalesce(F.sum(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in sum_cols]
    exprs += [F.mode(c, True).alias(c) for c in mode_cols]
    exprs += [F.max(src).alias(out) for out, src in (keep or {}).items()]
    return df.groupBy(*keys).agg(*exprs)


def first_row(df: DataFrame, key: list[str], order_by: list[str]) -> DataFrame:
    """A5: the first row per key under an explicit total order.

    ``min(struct(order..., rest...))`` is an ordinary aggregate with partial
    aggregation, so a key holding a third of all rows is reduced map-side
    instead of being sorted in one task. Rows must be totally ordered by
    ``order_by`` for the result to be deterministic.
    """
    if not order_by:
        raise ValueError("first_row needs explicit order columns")
    rest = [c for c in df.columns if c not in key and c not in order_by]
    packed = F.struct(*[F.col(c) for c in order_by + rest])
    g = _drop_null_keys(df, key).groupBy(*key).agg(F.min(packed).alias("__r"))
    return g.select(*key, *[F.col(f"__r.{c}").alias(c) for c in order_by + rest]).select(*df.columns)


def row_bucket_sum(df: DataFrame, key: str, order: str, n: int, sum_cols: list[str], div_cols: list[str] = ()) -> DataFrame:
    """Per key, sum each run of ``n`` consecutive rows in ``order``.

    ``div_cols`` are summed and divided back by ``n`` (the reference's year
    and quarter columns). The window holds one key's rows; on the monthly
    panel that is bounded by the spine length.
    """
    w = Window.partitionBy(key).orderBy(order)
    b = df.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / F.lit(n)).cast("int"))
    exprs = [F.sum(c).alias(c) for c in sum_cols]
    exprs += [(F.sum(c) / F.lit(n)).alias(c) for c in div_cols]
    return b.groupBy(key, "bucket").agg(*exprs)
