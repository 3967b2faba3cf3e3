"""Quantile binning fitted on train and reused, WOE / information value.

Bin rule (the reference's library does not define it; this is ours): with
distinct sorted edges e_1 < ... < e_m, a value's bin is the number of edges
<= the value (MLlib ``Bucketizer`` on splits [-inf, e_1, ..., e_m, +inf]).
Tied edges collapse, so heavily tied columns get fewer bins.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.functions.quantiles import lower_rank_quantiles


def fit_exact_bins(df: DataFrame, cols: list[str], n_bins: int, skip_static: bool = True) -> dict[str, list[float]]:
    """Exact edges: values at ranks floor((n-1)*i/n_bins), i = 1..n_bins-1, deduplicated."""
    out = {}
    for c in cols:
        if skip_static:
            st = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
            if st["a"] is None or st["a"] == st["b"]:
                continue
        edges = sorted({float(v) for v in lower_rank_quantiles(df, c, n_bins)})
        out[c] = edges
    return out


def bucketizer(edges: dict[str, list[float]], suffix: str = "_bin") -> Bucketizer:
    cols = list(edges)
    splits = [[-math.inf, *edges[c], math.inf] for c in cols]
    return Bucketizer(
        splitsArray=splits, inputCols=cols, outputCols=[c + suffix for c in cols], handleInvalid="keep"
    )


def fit_approx_bins(df: DataFrame, cols: list[str], n_bins: int = 500, relative_error: float = 1e-3, suffix: str = "_bin"):
    """E8 approximate: Greenwald-Khanna sketch per column (bounded memory), then a Bucketizer."""
    qd = QuantileDiscretizer(
        numBuckets=n_bins,
        relativeError=relative_error,
        inputCols=cols,
        outputCols=[c + suffix for c in cols],
        handleInvalid="keep",
    )
    return qd.fit(df)


def quantile_bin(train: DataFrame, others: list[DataFrame], cols: list[str], n_bins: int, exact: bool = False, suffix: str = "_bin"):
    """Fit on train, apply the same edges to every frame (train first in the result)."""
    if exact:
        model = bucketizer(fit_exact_bins(train, cols, n_bins), suffix)
    else:
        model = fit_approx_bins(train, cols, n_bins, suffix=suffix)
    return [model.transform(x) for x in [train, *others]]


def woe_table(df: DataFrame, bin_col: str, label: str, adjustment: float = 0.5) -> DataFrame:
    """Per bin events/non-events, WOE and IV contribution; binary label 0/1.

    woe = ln(((e + a) / E) / ((ne + a) / NE)), iv_part = ((e + a)/E - (ne + a)/NE) * woe,
    with a = ``adjustment`` smoothing empty cells (our definition).
    """
    g = df.where(F.col(bin_col).isNotNull() & F.col(label).isNotNull()).groupBy(bin_col).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("events"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("non_events"),
    )
    tot = g.agg(F.sum("events").alias("E"), F.sum("non_events").alias("NE")).first()
    e_t, ne_t = float(tot["E"] or 0), float(tot["NE"] or 0)
    a = F.lit(adjustment)
    pe = (F.col("events") + a) / F.lit(e_t if e_t else 1.0)
    pn = (F.col("non_events") + a) / F.lit(ne_t if ne_t else 1.0)
    woe = F.log(pe / pn)
    return g.withColumns({"woe": woe, "iv_part": (pe - pn) * woe})


def information_value(df: DataFrame, bin_cols: list[str], label: str, adjustment: float = 0.5) -> DataFrame:
    """IV per binned feature (one row per feature)."""
    parts = [
        woe_table(df, c, label, adjustment).agg(F.sum("iv_part").alias("iv")).select(F.lit(c).alias("feature"), "iv")
        for c in bin_cols
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _iv_part(e: float, ne: float, e_t: float, ne_t: float, a: float) -> float:
    pe, pn = (e + a) / e_t, (ne + a) / ne_t
    return (pe - pn) * math.log(pe / pn)


def fit_iv_merge(df: DataFrame, bin_col: str, label: str, target_bins: int, adjustment: float = 0.5) -> dict[int, int]:
    """E9 merge step: adjacent initial bins merged greedily, each step the merge losing the least IV.

    The fit aggregates event / non-event counts per initial bin (one row per
    bin, bounded by the initial bin count), merges on the driver, and returns
    ``{initial bin: merged bin}`` (merged bins numbered from 0 in order).
    """
    rows = sorted(
        (r[0], r[1], r[2])
        for r in woe_table(df, bin_col, label, adjustment).select(bin_col, "events", "non_events").collect()
    )  # one row per initial bin: bounded by the initial bin count
    e_t = float(sum(r[1] for r in rows)) or 1.0
    ne_t = float(sum(r[2] for r in rows)) or 1.0
    groups = [[b] for b, _, _ in rows]
    ev = [float(e) for _, e, _ in rows]
    nev = [float(n) for _, _, n in rows]
    while len(groups) > max(1, target_bins):
        best, best_loss = 0, None
        for i in range(len(groups) - 1):
            before = _iv_part(ev[i], nev[i], e_t, ne_t, adjustment) + _iv_part(ev[i + 1], nev[i + 1], e_t, ne_t, adjustment)
            after = _iv_part(ev[i] + ev[i + 1], nev[i] + nev[i + 1], e_t, ne_t, adjustment)
            loss = before - after
            if best_loss is None or loss < best_loss:
                best, best_loss = i, loss
        groups[best : best + 2] = [groups[best] + groups[best + 1]]
        ev[best : best + 2] = [ev[best] + ev[best + 1]]
        nev[best : best + 2] = [nev[best] + nev[best + 1]]
    return {b: k for k, g in enumerate(groups) for b in g}


def apply_bin_merge(df: DataFrame, bin_col: str, mapping: dict[int, int], out: str | None = None) -> DataFrame:
    """Map initial bins to merged bins (a literal map: the mapping is bounded by the initial bin count)."""
    pairs = [x for b, k in mapping.items() for x in (F.lit(float(b)), F.lit(k))]
    return df.withColumn(out or bin_col, F.try_element_at(F.create_map(*pairs), F.col(bin_col).cast("double")))


def quantile_sketches(df: DataFrame, cols: list[str], by: list[str], k: int = 4096) -> DataFrame:
    """E8 approximate, mergeable: one KLL sketch per column and group (a day, a load), as a table to store.

    ``column, <by>, sketch``; a new day's rows add sketches, old rows are not read again.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols))
    melted = df.select(*by, F.inline(cells)).where("x is not null and not isnan(x)")
    return melted.groupBy("column", *by).agg(F.kll_sketch_agg_double("x", k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, n_bins: int) -> dict[str, list[float]]:
    """The quantiles ``i / n_bins`` from stored sketches, merged; ``n_bins`` numbers a column reach the driver.

    Their distinct values are bin edges.
    """
    merged = sketches.groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    ranks = F.array(*(F.lit(i / n_bins) for i in range(1, n_bins)))
    found = merged.select("column", F.kll_sketch_get_quantile_double("sketch", ranks).alias("q")).collect()
    return {r.column: [float(v) for v in r.q] for r in found}


def rank_errors(df: DataFrame, quantiles: dict[str, list[float]]) -> DataFrame:
    """``column, n, worst``: how far the wanted ranks ``i / n_bins`` lie from their quantiles' ranks at most.

    A value covers the ranks from the share of rows below it to the share of rows at or below it.
    """
    parts = []
    for c, q in quantiles.items():
        e = sorted(set(q))
        x = df.select(F.col(c).cast("double").alias("x")).where("x is not null and not isnan(x)")
        binned = bucketizer({"x": e}).transform(x).select(F.col("x_bin").cast("int").alias("b"), "x")
        listed = F.array(*(F.lit(v) for v in e))
        counted = binned.groupBy("b", F.when(F.col("b") > 0, F.get(listed, F.col("b") - 1) == F.col("x")).alias("at")).agg(
            F.count(F.lit(1)).alias("n")
        )
        rows = counted.collect()  # two rows a bin
        total, below = sum(r.n for r in rows), 0
        size = {}
        for r in rows:
            here = size.setdefault(r.b, [0, 0])
            here[0] += r.n
            here[1] += r.n if r["at"] else 0
        spans = {}
        for j in range(len(e) + 1):
            n, at = size.get(j, (0, 0))
            if j:
                spans[e[j - 1]] = (below / total, (below + at) / total)
            below += n
        gap = lambda v, rank: max(spans[v][0] - rank, rank - spans[v][1], 0.0)
        parts.append((c, total, max(gap(v, (i + 1) / (len(q) + 1)) for i, v in enumerate(q))))
    return df.sparkSession.createDataFrame(parts, "column string, n long, worst double")


def contingency(df: DataFrame, bin_cols: list[str], label: str) -> DataFrame:
    """``feature, bin, events, non_events`` of all binned columns, melted into one aggregation."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("int").alias("bin")) for c in bin_cols))
    melted = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.inline(cells)).where("bin is not null")
    events = F.count(F.when(F.col("label") == 1, 1))
    return melted.groupBy("feature", "bin").agg(events.alias("events"), (F.count(F.lit(1)) - events).alias("non_events"))


def optimal_merge(
    counts: list[tuple[int, int, int]], max_bins: int, adjustment: float = 0.5
) -> list[tuple[int, int, int, int, float, float]]:
    """The partition of adjacent bins into ``max_bins`` groups at most with the largest information value
    among those whose WOE only rises or only falls.

    ``counts``: ``(bin, events, non_events)``. Gives ``(first bin, last bin, events, non_events, woe, iv)`` by group.
    Dynamic programme over (groups, last group's bins): its work grows with the cube of
    the bins, so fit it on some dozens of initial bins. Ties go to fewer groups.
    """
    rows = sorted(counts)
    e_t, ne_t = float(sum(r[1] for r in rows)) or 1.0, float(sum(r[2] for r in rows)) or 1.0
    n = len(rows)
    group: dict[tuple[int, int], tuple[int, int, float, float]] = {}
    for a in range(n):
        e = ne = 0
        for b in range(a, n):
            e, ne = e + rows[b][1], ne + rows[b][2]
            pe, pn = (e + adjustment) / e_t, (ne + adjustment) / ne_t
            woe = math.log(pe / pn)
            group[a, b] = (e, ne, woe, (pe - pn) * woe)
    best: tuple[float, list[tuple[int, int]]] = (-math.inf, [])
    for sign in (1.0, -1.0):
        # (first, last bin of the last group) -> (iv so far, groups), for one more group in each round
        reached = {(0, b): (group[0, b][3], [(0, b)]) for b in range(n)}
        for _ in range(max_bins):
            for (_, b), (iv, cut) in reached.items():
                if b == n - 1 and iv > best[0]:
                    best = (iv, cut)
            further: dict[tuple[int, int], tuple[float, list[tuple[int, int]]]] = {}
            for (a, b), (iv, cut) in reached.items():
                for c in range(b + 1, n):
                    if sign * (group[b + 1, c][2] - group[a, b][2]) > 0:
                        total = iv + group[b + 1, c][3]
                        if total > further.get((b + 1, c), (-math.inf,))[0]:
                            further[b + 1, c] = (total, [*cut, (b + 1, c)])
            reached = further
    return [(rows[a][0], rows[b][0], *group[a, b]) for a, b in best[1]]


def optimal_bins(df: DataFrame, bin_cols: list[str], label: str, max_bins: int, adjustment: float = 0.5) -> DataFrame:
    """:func:`optimal_merge` of every binned column: ``feature, grp, first_bin, last_bin, events, non_events, woe, iv``."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for r in contingency(df, bin_cols, label).collect():  # a row for each feature and bin
        found.setdefault(r.feature, []).append((r.bin, r.events, r.non_events))
    rows = [(f, k, *g) for f in sorted(found) for k, g in enumerate(optimal_merge(found[f], max_bins, adjustment))]
    kinds = "feature string, grp int, first_bin int, last_bin int, events long, non_events long, woe double, iv double"
    return df.sparkSession.createDataFrame(rows, kinds)
