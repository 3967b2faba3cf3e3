"""O1-O4 and a global row index without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one
task. :func:`global_row_index` instead range-sorts the frame (a distributed
sort), tags rows with ``monotonically_increasing_id`` (partition index in
the high bits, position in the low bits), pins that result as a table in the
shared checkpoint folder, and adds each partition's offset from a per-partition count
(one small row per partition, broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.session import materialise

_LOW_BITS = 33


def global_row_index(df: DataFrame, order_by: list[Column | str], out: str = "row_index") -> DataFrame:
    """0-based contiguous index of every row in ``order_by`` order (ties broken arbitrarily)."""
    tagged = df.orderBy(*order_by).withColumn("__mid", F.monotonically_increasing_id())
    tagged = materialise(tagged, "row-index")  # pins the ids: counts and offsets see the same rows
    pid = F.shiftright(F.col("__mid"), _LOW_BITS)
    counts = tagged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    rows = sorted((r["__pid"], r["__n"]) for r in counts.collect())  # one row per partition
    offsets, acc = [], 0
    for p, n in rows:
        offsets.append((p, acc))
        acc += n
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "__pid long, __off long")
    low = F.col("__mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    joined = tagged.withColumn("__pid", pid).join(F.broadcast(off), "__pid")
    return joined.withColumn(out, F.col("__off") + low).drop("__mid", "__pid", "__off")


def sort_by(df: DataFrame, cols: list[str], descending: bool = False) -> DataFrame:
    """O1 / O2: sort, only where order is part of the result (sinks, reports)."""
    return df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in cols])


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """O3: the first ``n`` rows in ``order`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def slice_rows(df: DataFrame, order: list[Column], start: int, stop: int) -> DataFrame:
    """Positional slice ``[start:stop)`` in a total order (``offset`` + ``limit``)."""
    return df.orderBy(*order).offset(start).limit(stop - start)
