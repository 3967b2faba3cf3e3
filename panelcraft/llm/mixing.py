"""Sources interleaved to target weights by Pfair scheduling.

Weights are whole numbers that add up to the period ``Q``; one block is
scheduled per slot. Block ``i`` (from 1) of a source with weight ``w`` is released
at ``floor((i - 1) * Q / w)`` and due by ``ceil(i * Q / w)``; of the released blocks
the one due first gets the slot. At every slot each source then has been given
its share to within less than one block. The schedule repeats after ``Q`` slots,
so one period is worked out and every row finds its slot from its rank.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcraft.llm.sharding import HASH_BITS, id_hash

#: rows of a rank cell on average, and rows from which a cell is split by input partition
CELL_ROWS = 512
LARGE_CELL = 64 * CELL_ROWS


def period(weights: dict[str | None, int]) -> list[str | None]:
    """The source of each slot of one period."""
    q = sum(weights.values())
    order = sorted(weights, key=lambda s: (s is None, s or ""))
    waiting = [(0, k, 1) for k, s in enumerate(order) if weights[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * q // weights[order[k]]), k, i))
        _, k, i = heapq.heappop(ready)
        slots.append(order[k])
        heapq.heappush(waiting, (i * q // weights[order[k]], k, i + 1))
    return slots


def temperature_weights(docs: DataFrame, total: int, source_col: str = "source") -> dict[str | None, int]:
    """Weights in proportion to the square root of each source's rows: at least 1 each, adding up to ``total``.

    With more than ``total`` sources they add up to the least multiple of it with two slots a
    source. Sources are collected: a mixture's plan has a row for each slot.
    """
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).count().collect()
    if len(rows) > total:
        total *= -(-2 * len(rows) // total)
    root = {r.s: math.floor(math.sqrt(r["count"]) * 1000) for r in rows}
    spare, whole = total - len(root), sum(root.values())
    weights = {s: 1 + r * spare // whole for s, r in root.items()}
    by_rest = sorted(root, key=lambda s: (-(root[s] * spare % whole), s is None, s or ""))
    for s in by_rest[: total - sum(weights.values())] if weights else ():
        weights[s] += 1
    return weights


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of parameters."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def mix(docs: DataFrame, weights: dict[str | None, int], block_rows: int, id_col: str = "doc_id", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, source, ``rank`` in its source, ``block``, ``slot``, ``position``, ``in_ratio``.

    Rows sorted by ``position`` are the mixture. A source's rows are ranked by the
    hash of their id, ties by id, and cut into blocks of ``block_rows``. Nothing
    is dropped: when a source runs out its later slots stay empty, and
    ``in_ratio`` tells the rows of slots before the first empty one, for which
    the weights hold. Sources without a weight come after all others, by
    source and rank (slot, block and position null, ``in_ratio`` false). A null
    source is a source. Repeated rows get ranks of their own; where one id fills
    a whole cell of ranks its rows are numbered by input partition. Other
    columns are not read, but a ``row_col`` is returned too and breaks ties of id.
    """
    spark = docs.sparkSession
    own = [row_col] if row_col else []
    rows = docs.select(
        *own,
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        id_hash(F.col(id_col)).alias("h"),
        F.spark_partition_id().alias("part"),
    )
    # ranks from two levels of hash cells, so that no window holds a whole source
    bits = max(0, math.ceil(math.log2(max(1.0, rows.count() / CELL_ROWS))))
    high, low = bits // 2, bits
    rows = rows.withColumn("hi", F.shiftright("h", HASH_BITS - high)).withColumn("lo", F.shiftright("h", HASH_BITS - low))
    key = ["source", "hi", "lo"]
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    outer = cells.groupBy("source", "hi").agg(F.sum("n").alias("n"))
    outer = outer.select("source", "hi", before(Window.partitionBy("source").orderBy("hi")).alias("above"))
    inner = cells.select(*key, F.col("n").alias("in_cell"), before(Window.partitionBy("source", "hi").orderBy("lo")).alias("within"))
    starts = inner.join(outer.withColumnsRenamed({"source": "s", "hi": "t"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("hi") == F.col("t")))
    starts = starts.select(F.col("source").alias("s"), F.col("lo").alias("l"), "in_cell", (F.col("above") + F.col("within")).alias("start"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("lo") == F.col("l"))).drop("s", "l")
    rows = rows.withColumn("salt", F.when(F.col("in_cell") > LARGE_CELL, F.col("part")).otherwise(-1))
    parts = rows.where("salt >= 0").groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(
        F.col("source").alias("s"), F.col("lo").alias("l"), F.col("salt").alias("p"), before(Window.partitionBy(*key).orderBy("salt")).alias("skip")
    )
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("lo") == F.col("l")) & (F.col("salt") == F.col("p")), "left").drop("s")
    nth = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("h", "id", *own))
    rows = rows.withColumn("rank", (F.col("start") + F.coalesce("skip", F.lit(0)) + nth - 1).cast("long"))

    slots = period(weights)
    given: Counter = Counter()
    plan = []
    for at, s in enumerate(slots):
        plan.append({"s": s, "nth": given[s], "at": at})
        given[s] += 1
    plan = _table(spark, plan, "s string, nth long, at long")
    share = _table(spark, [{"v": s, "weight": w} for s, w in weights.items() if w > 0], "v string, weight long")
    q = len(slots)
    rows = rows.join(F.broadcast(share), F.col("source").eqNullSafe(F.col("v")), "left")
    rows = rows.withColumn("block", F.when(F.col("weight").isNotNull(), F.expr(f"rank div {block_rows}")))
    rows = rows.join(
        F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")) & (F.expr("block % weight") == F.col("nth")), "left"
    ).withColumn("slot", F.expr(f"(block div weight) * {q}L + at"))

    # the first slot that stays empty: the one of the first block a source doesn't have
    sizes = cells.groupBy("source").agg(F.sum("n").alias("n"))
    next_block = share.join(sizes, F.col("source").eqNullSafe(F.col("v")), "left").select(
        "v", "weight", F.expr(f"coalesce(n, 0L) div {block_rows}").alias("block")
    )
    first_empty = (
        next_block.join(F.broadcast(plan), F.col("v").eqNullSafe(F.col("s")) & (F.expr("block % weight") == F.col("nth")))
        .agg(F.min(F.expr(f"(block div weight) * {q}L + at")))
        .first()[0]
    )
    return rows.select(
        *own,
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "rank",
        "block",
        "slot",
        F.expr(f"slot * {block_rows}L + rank % {block_rows}").alias("position"),
        F.coalesce(F.col("slot") < F.lit(first_empty), F.lit(False)).alias("in_ratio"),
    )
