"""Exact order statistics and moments without funnelling a column through one task.

``percentile`` (exact) keeps every distinct value of a group in one
aggregation buffer, and a global sort + ``row_number`` window runs in one
partition. :func:`order_statistics` instead selects by radix: values become
64-bit integers in the same order, and each pass counts the rows by ``BITS``
more leading bits, only among the prefixes that hold a wanted rank. A pass
is one aggregation for all ranks and brings at most ``2^BITS`` counts per
rank to the driver; no values are collected. The number of passes depends on
the width of the value range alone (eight for any 64-bit range).

Moments: for integral (fixed-point) columns, power sums are accumulated
exactly in DECIMAL(38,0) and every statistic is a single rounding of an
exact integer expression, so results do not depend on summation order.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from panelcraft.session import materialise

#: bits looked at in a pass
BITS = 8
#: bits of the first pass over several columns
FIRST_BITS = 16
#: so few rows are counted value by value in one last pass
LAST_ROWS = 1 << 18
_SIGN = (1 << 63) - 1


def _code(df: DataFrame, col: str) -> Column:
    """A value as an integer of the same order (doubles: by their bits); null for NULL and NaN."""
    x = F.col(f"`{col}`")
    if isinstance(df.schema[col].dataType, IntegralType):
        return x.cast("long")
    value = x.cast("double") + F.lit(0.0)
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value).cast("long")
    code = F.when(bits < 0, bits.bitwiseXOR(F.lit(_SIGN))).otherwise(bits)
    return F.when(value.isNotNull() & ~F.isnan(value), code)


def _codes(df: DataFrame, col: str) -> DataFrame:
    """Codes ``x`` of the non-NULL, non-NaN values."""
    return df.select(_code(df, col).alias("x")).where("x is not null")


def coded(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` and columns ``c0, c1, ...`` of the codes of ``cols``, as :func:`_code` has them; doubles batch by batch."""
    whole = [isinstance(df.schema[c].dataType, IntegralType) for c in cols]
    typed = df.select(*keep, *(F.col(f"`{c}`").cast("long" if w else "double").alias(f"c{i}") for i, (c, w) in enumerate(zip(cols, whole))))
    if all(whole):
        return typed
    sign, first = _SIGN, len(keep)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.columns[:first]
            for c, w in zip(batch.columns[first:], whole):
                if not w:
                    x = c.fill_null(math.nan).to_numpy(zero_copy_only=False) + 0.0
                    bits = x.view(np.int64)
                    c = pa.array(np.where(bits < 0, bits ^ sign, bits), mask=np.isnan(x))
                out.append(c)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in typed.schema][:first]
    return typed.mapInArrow(code, ", ".join([*kept, *(f"c{i} long" for i in range(len(cols)))]))


def double_of(code: int) -> float:
    """The double of a code."""
    return struct.unpack("<d", struct.pack("<q", code ^ _SIGN if code < 0 else code))[0]


def _value(df: DataFrame, col: str, code: int):
    """The value of a code."""
    if isinstance(df.schema[col].dataType, IntegralType):
        return code
    return double_of(code)


def _bounds(codes: DataFrame) -> tuple[int, int | None, int | None]:
    return tuple(codes.agg(F.count("x"), F.min("x"), F.max("x")).first())


def order_statistics(df: DataFrame, col: str, ranks: list[int], bounds: tuple | None = None, bits: int = BITS) -> dict[int, object]:
    """Value at each 0-based ``rank`` of the ascending non-NULL values of ``col``.

    A pass looks at ``bits`` bits; more of them save passes where few ranks are wanted.
    """
    codes = _codes(df, col)
    n, lo, hi = bounds or _bounds(codes)
    wanted = sorted({int(r) for r in ranks})
    if n == 0:
        return {r: None for r in wanted}
    for r in wanted:
        if r < 0 or r >= n:
            raise ValueError(f"rank {r} outside [0, {n})")
    shift = 0
    while (hi >> shift) - (lo >> shift) >= 1 << bits:
        shift += bits
    rows, held = codes, {None: [(r, r) for r in wanted]}  # prefix -> (rank, rank among the rows of the prefix)
    while wanted:
        prefix = F.shiftright("x", shift)
        counts: dict[int | None, list[tuple[int, int]]] = {}
        table = rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("c")).toArrow()
        for p, c in zip(*(x.to_pylist() for x in table.columns)):
            counts.setdefault(None if None in held else p >> bits, []).append((p, c))
        inside: dict[int | None, list[tuple[int, int]]] = {}
        for parent, of in held.items():
            for rank, among in of:
                for p, c in sorted(counts[parent]):
                    if among < c:
                        inside.setdefault(p, []).append((rank, among))
                        break
                    among -= c
        held = inside
        if shift == 0:
            break
        rows = codes.where(prefix.isin(list(held)))
        shift -= bits
    return {rank: _value(df, col, p) for p, of in held.items() for rank, _ in of}


def interpolated_quantiles(df: DataFrame, col: str, probs: list[float]) -> dict[float, float | None]:
    """Linear-interpolated quantiles (the pandas / numpy default), exact."""
    bounds = _bounds(_codes(df, col))
    if bounds[0] == 0:
        return {p: None for p in probs}
    pos = {p: (bounds[0] - 1) * p for p in probs}
    ranks = {r for v in pos.values() for r in (math.floor(v), math.ceil(v))}
    vals = order_statistics(df, col, sorted(ranks), bounds)
    out = {}
    for p, v in pos.items():
        a, b = vals[math.floor(v)], vals[math.ceil(v)]
        d = v - math.floor(v)
        out[p] = float(a) + (float(b) - float(a)) * d if a != b else float(a)
    return out


def lower_rank_quantiles(df: DataFrame, col: str, k: int) -> list:
    """Discrete quantile edges: the value at rank ``floor((n-1)*i/k)`` for i = 1..k-1."""
    bounds = _bounds(_codes(df, col))
    if bounds[0] == 0:
        return []
    ranks = [((bounds[0] - 1) * i) // k for i in range(1, k)]
    vals = order_statistics(df, col, ranks, bounds)
    return [vals[r] for r in ranks]


def _long(value: int) -> str:
    """SQL of a whole number of 64 bits."""
    return f"{value}L" if value > -(1 << 63) else f"({value + 1}L - 1L)"


def _melted(wide: DataFrame, columns: dict[int, str]) -> DataFrame:
    """The non-null values ``x`` of each expression, and its number ``f``."""
    cells = ", ".join(f"struct({f} AS f, {x} AS x)" for f, x in columns.items())
    return wide.selectExpr(f"inline(array({cells}))").where("x is not null")


def lower_rank_edges(df: DataFrame, cols: list[str], k: int) -> dict[str, list]:
    """The distinct lower-rank quantiles of several columns, ascending; a column without values has none.

    As :func:`lower_rank_quantiles`, but the codes are written once, see :func:`code_edges`.
    """
    found = code_edges(materialise(coded(df, cols), "codes"), len(cols), k)
    return {c: [_value(df, c, x) for x in of] for c, of in zip(cols, found)}


def code_edges(wide: DataFrame, n_cols: int, k: int) -> list[list[int]]:
    """The distinct lower-rank quantiles of the written codes ``c0, c1, ...``, ascending; a column without values has none.

    Every pass counts all columns, melted into (column, prefix), in one aggregation. A prefix
    of one value is settled at once; when few rows are left in the others, one last pass
    counts their whole values.
    """
    melted = _melted(wide, {i: f"c{i}" for i in range(n_cols)})
    bounds = {r.f: (r.n, r.lo, r.hi) for r in melted.groupBy("f").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    held = {(f, None): sorted({(b[0] - 1) * i // k for i in range(1, k)}) for f, b in bounds.items()}
    held = {at: [(r, r) for r in ranks] for at, ranks in held.items()}
    shift = 0
    while any((hi >> shift) - (lo >> shift) >= 1 << FIRST_BITS for _, lo, hi in bounds.values()):
        shift += BITS
    rows, step = melted, 0
    found: dict[int, set[int]] = {f: set() for f in range(n_cols)}
    while held:
        counts: dict[tuple, list[tuple]] = {}
        first = next(iter(held))[1] is None
        table = rows.groupBy("f", F.shiftright("x", shift).alias("p")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).toArrow()
        for f, p, *of in zip(*(x.to_pylist() for x in table.columns)):
            counts.setdefault((f, None if first else p >> step), []).append((p, *of))
        inside: dict[tuple, list[tuple[int, int]]] = {}
        left = {}
        for at, wanted in held.items():
            places, done = iter(sorted(counts[at])), 0
            p, c, lo, hi = next(places)
            for rank, among in wanted:  # ascending
                while among >= done + c:
                    done += c
                    p, c, lo, hi = next(places)
                if lo == hi:  # one value: found
                    found[at[0]].add(lo)
                else:
                    inside.setdefault((at[0], p), []).append((rank, among - done))
                    left[at[0], p] = c
        held = inside
        step = shift if sum(left.values()) <= LAST_ROWS else BITS
        # as many prefixes as wanted ranks at most, tested before the columns are melted
        wanted = {f: [p for g, p in held if g == f] for f, _ in held}
        if held:
            rows = _melted(wide, {f: f"CASE WHEN shiftright(c{f}, {shift}) IN ({', '.join(map(_long, p))}) THEN c{f} END" for f, p in wanted.items()})
        shift -= step
    return [sorted(found[f]) for f in range(n_cols)]


# ------------------------------------------------------------------ moments
def power_sums(df: DataFrame, col: str, upto: int = 2, prefix: str = "") -> list[Column]:
    """Aggregates n, s1..s_upto; exact DECIMAL(38,0) sums for integral columns."""
    c = F.col(col)
    integral = isinstance(df.schema[col].dataType, IntegralType)
    base = c.cast("decimal(38,0)") if integral else c.cast("double")
    out = [F.count(c).alias(f"{prefix}n")]
    term = base
    for k in range(1, upto + 1):
        out.append(F.sum(term).alias(f"{prefix}s{k}"))
        term = term * base
    return out


def exact_mean(n: Column, s1: Column) -> Column:
    return F.when(n > 0, s1.cast("double") / n.cast("double"))


def centred_sums(n: Column, s1: Column, s2: Column, s3: Column | None = None) -> tuple[Column, ...]:
    """Sums of the second (and third) powers about the mean, as doubles.

    Power sums are shifted exactly by the whole part ``m`` of the mean, so no
    product grows beyond ``n * m^2`` (``n * m^3``) and nothing cancels in floating
    point; what is left of the mean, below 1, is taken off in double precision.
    Exact while the sum of squares (cubes) fits DECIMAL(38,0).
    """
    m = F.call_function("div", s1, n).cast("decimal(20,0)")
    nd = n.cast("decimal(20,0)")
    rest = (s1 - nd * m).cast("double")
    count = n.cast("double")
    c2 = (s2 - F.lit(2) * (m * s1) + nd * (m * m)).cast("double")
    about = c2 - rest * rest / count
    if s3 is None:
        return (about,)
    c3 = (s3 - F.lit(3) * (m * s2) + F.lit(3) * (m * m * s1) - nd * (m * m * m)).cast("double")
    off = rest / count
    return about, c3 - F.lit(3.0) * off * c2 + F.lit(2.0) * off * off * rest


def exact_var(n: Column, s1: Column, s2: Column, ddof: int) -> Column:
    """Variance from exact power sums about the mean."""
    return F.when(n > ddof, centred_sums(n, s1, s2)[0] / (n - F.lit(ddof)).cast("double"))


def exact_std(n: Column, s1: Column, s2: Column, ddof: int) -> Column:
    return F.sqrt(exact_var(n, s1, s2, ddof))
