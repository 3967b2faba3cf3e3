"""The monthly panel: J1-J5 and A1/A2 fused into two shuffles.

Result: one row per (id, month) for every id of the interval facts and every
month of [lo, hi]; ``value`` is the prorated interval amount of the month
(NULL when no interval covers it) and each point aggregate is attached as a
left join would (NULL when the id has no point fact that month).

Plan, instead of exploding every interval into all its months (on average
~28 rows per fact) and joining a spine:

1. Each interval fact emits at most three small rows: an id-presence marker,
   ``+rate`` at its first in-range month and ``-rate`` at the month after
   its last in-range month (a difference array). Point facts emit one row.
2. One ``groupBy(id, month)`` folds these with map-side partial aggregation,
   so a hot id shrinks to one row per month per map task before the shuffle.
3. The presence marker of an id generates the id's spine months (a Generate,
   no join), and one window per id takes the running sums along the months;
   a month is covered when the running interval count is positive.

So the facts cross the network once, pre-aggregated, and the second
exchange moves at most (months + distinct fact months) rows per id. The
output is hash-partitioned by id, which every later per-id window and
roll-up reuses without a further exchange. With fixed-point BIGINT amounts
the running sums are exact and equal the explode-and-sum result bit for bit.
"""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import field

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcraft.functions.aggregates import int_div
from panelcraft.functions.scalar import is_integral
from panelcraft.functions.scalar import month_floor
from panelcraft.operators.interval import month_count
from panelcraft.operators.interval import prorate_expr
from panelcraft.operators.interval import quarantine_reason
from panelcraft.operators.spine import month_range

AGGS = ("mean", "sum", "max", "min", "count", "mode")


@dataclass
class PointFacts:
    """Dated facts aggregated per (id, month) and attached to the panel (A2/A3 + J5)."""

    df: DataFrame
    id_col: str
    date_col: str
    # output name -> (aggregate, source column); aggregate in AGGS
    aggs: dict[str, tuple[str, str]] = field(default_factory=dict)
    # every id of this source gets a spine (as the interval facts' ids do)
    defines_ids: bool = False


def _point_agg(kind: str, name: str, integral: bool):
    c = F.col(name)
    if kind == "sum":
        return [F.sum(c)]
    if kind == "max":
        return [F.max(c)]
    if kind == "min":
        return [F.min(c)]
    if kind == "count":
        return [F.count(c)]
    if kind == "mode":
        return [F.mode(c, True)]
    if kind == "mean":
        return [F.sum(c), F.count(c)] if integral else [F.avg(c)]
    raise ValueError(f"unknown aggregate {kind}")


def _interval_rows(intervals, id_col, start, end, amount, lo_d, hi_d) -> DataFrame:
    """Presence marker, +rate at the first in-range month, -rate after the last."""
    integral = is_integral(intervals, amount)
    f = intervals.select(
        F.col(id_col).alias("_id"),
        month_floor(start).alias("_ms"),
        month_floor(end).alias("_me"),
        F.col(amount).alias("_amt"),
    ).where(F.col("_id").isNotNull())
    ok = quarantine_reason(F.col("_ms"), F.col("_me")).isNull()
    rate = prorate_expr(F.col("_amt"), month_count(F.col("_ms"), F.col("_me")), integral)
    first = F.greatest(F.col("_ms"), lo_d)
    last = F.least(F.col("_me"), hi_d)
    hit = ok & (first <= last)
    dtype = "bigint" if integral else "double"

    def ev(month, d, c):
        return F.struct(month.alias("month"), d.cast(dtype).alias("d"), c.cast("int").alias("c"))

    events = F.array(
        ev(F.lit(None).cast("date"), F.lit(None), F.lit(None)),  # id presence
        F.when(hit, ev(first, rate, F.lit(1))),
        F.when(hit & (last < hi_d), ev(F.add_months(last, 1), -rate, F.lit(-1))),
    )
    # explode then drop the NULL slots: plain Generate + Filter stay in generated code
    # (a higher-order filter(array, lambda) would be interpreted per row)
    rows = f.select(F.col("_id"), F.explode(events).alias("_e")).where(F.col("_e").isNotNull())
    return rows.select("_id", F.col("_e.month").alias("_m"), F.col("_e.d").alias("_d"), F.col("_e.c").alias("_c"))


def monthly_panel(
    intervals: DataFrame | None,
    *,
    id_col: str = "id",
    start: str = "start",
    end: str = "end",
    amount: str = "amount",
    lo: str,
    hi: str,
    value: str = "value",
    points: list[PointFacts] | None = None,
    id_out: str = "id",
    month_out: str = "month",
) -> DataFrame:
    """Spine of every id x every month of [lo, hi] with the prorated interval value and point aggregates.

    ``intervals`` (id_col, start, end, amount) may be None when a point source
    has ``defines_ids``; ``value`` is NULL for months no valid interval covers
    (inverted or incomplete intervals only register their id, see the
    quarantine of ``operators.interval``). Output is hash-partitioned by id.
    """
    points = points or []
    lo_d, hi_d = F.to_date(F.lit(lo)), F.to_date(F.lit(hi))
    parts = [] if intervals is None else [_interval_rows(intervals, id_col, start, end, amount, lo_d, hi_d)]
    agg_exprs = [F.sum("_d").alias("_d"), F.sum("_c").alias("_c")]
    if intervals is None:
        agg_exprs = [F.lit(None).cast("bigint").alias("_d"), F.lit(None).cast("int").alias("_c")]

    # point facts: one row each, restricted to the spine range before the shuffle
    out_cols: list[tuple[str, str, bool, str]] = []  # (output, column, integral mean, presence column)
    for i, p in enumerate(points):
        m = month_floor(p.date_col)
        present = f"_p{i}_rows"
        fields = [F.col("_m0").alias("_m"), F.lit(1).alias(present)]
        agg_exprs.append(F.sum(present).alias(present))
        for j, (out, (kind, src)) in enumerate(p.aggs.items()):
            col_name = f"_p{i}_{j}"
            fields.append(F.col(src).alias(col_name))
            integ = is_integral(p.df, src)
            exprs = _point_agg(kind, col_name, integ)
            if len(exprs) == 2:
                agg_exprs += [exprs[0].alias(col_name + "_s"), exprs[1].alias(col_name + "_n")]
            else:
                agg_exprs.append(exprs[0].alias(col_name))
            out_cols.append((out, col_name, kind == "mean" and integ, present))
        src_df = p.df.select(F.col(p.id_col).alias("_id"), m.alias("_m0"), *[F.col(c) for c in dict.fromkeys(c for _, c in p.aggs.values())])
        in_range = F.col("_m0").isNotNull() & (F.col("_m0") >= lo_d) & (F.col("_m0") <= hi_d)
        shaped = src_df.where(F.col("_id").isNotNull()).select("_id", in_range.alias("_in"), *fields)
        if p.defines_ids:
            names = shaped.columns[2:]
            marker = F.struct(*[F.lit(None).cast(shaped.schema[n].dataType).alias(n) for n in names])
            row = F.struct(*[F.col(n) for n in names])
            both = F.array(marker, F.when(F.col("_in"), row))
            pdf = shaped.select("_id", F.explode(both).alias("_e")).where(F.col("_e").isNotNull()).select("_id", "_e.*")
        else:
            pdf = shaped.where(F.col("_in")).drop("_in")
        parts.append(pdf)
    if not parts:
        raise ValueError("monthly_panel needs interval facts or a point source with defines_ids")
    unioned = parts[0]
    for pdf in parts[1:]:
        unioned = unioned.unionByName(pdf, allowMissingColumns=True)

    agg = unioned.groupBy("_id", "_m").agg(*agg_exprs)

    # value columns of a point aggregate after the group-by
    point_vals = []
    for out, col_name, split_mean, present in out_cols:
        if split_mean:
            v = F.when(F.col(col_name + "_n") > 0, int_div(F.col(col_name + "_s"), F.col(col_name + "_n")))
        else:
            v = F.col(col_name)
        # NULL (as a left join gives) when the id has no fact of this source that month
        point_vals.append((out, F.when(F.col(present).isNotNull(), v)))

    # the presence row of an id expands to its spine months (k = 1); a fact row stays itself (k = 0)
    months = F.when(F.col("_m").isNull(), month_range(lo, hi)).otherwise(F.array(F.col("_m")))
    gen = agg.select(
        "_id",
        "_d",
        "_c",
        *[v.alias(o) for o, v in point_vals],
        F.when(F.col("_m").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("_k"),
        F.explode(months).alias("_month"),
    )

    w = Window.partitionBy("_id").orderBy("_month", "_k")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_month = (F.lag("_month").over(w) == F.col("_month")) & (F.lag("_k").over(w) == 0)
    out = gen.select(
        "_id",
        "_month",
        "_k",
        F.sum("_d").over(running).alias("_rd"),
        F.sum("_c").over(running).alias("_rc"),
        *[F.when(same_month, F.lag(o).over(w)).alias(o) for o, _ in point_vals],
    ).where(F.col("_k") == 1)
    return out.select(
        F.col("_id").alias(id_out),
        F.col("_month").alias(month_out),
        F.when(F.col("_rc") > 0, F.col("_rd")).alias(value),
        *[o for o, _ in point_vals],
    )
