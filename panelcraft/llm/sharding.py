"""Shards of bounded size by extendible hashing.

A shard is a prefix of the id's hash. The directory starts with the empty
prefix, and only a shard over its byte limit is split on one more bit. Because
sizes only shrink with depth, all splits of a path are decided at once: bytes
are summed per cell of a fine grid of prefixes, the cells are rolled up to every
depth, and a cell belongs to the shortest prefix that fits. Cells that are
still too large are looked at again, alone, with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: bits of the hash; more bits looked at when a cell of the grid is still too large
HASH_BITS = 60
FINER = 8


def id_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text (of the empty string for a null id)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits) -> Column:
    """The hash's first ``bits`` bits as a number."""
    return F.expr(f"shiftright(h, {HASH_BITS} - cast({bits} as int))")


def _leaves(rows: DataFrame, above: int, bits: int, max_bytes: int) -> DataFrame:
    """For every cell of ``bits`` bits: the depth of its shard; null if even the cell doesn't fit.

    A shard fits within the limit, or when all its rows have one hash, which no bit can split.
    """
    cells = rows.groupBy(_prefix(bits).alias("cell")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    grid = cells.withColumn("depth", F.explode(F.sequence(F.lit(above), F.lit(bits)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {bits} - depth)")
    )
    sizes = grid.groupBy("depth", "prefix").agg(
        F.sum("n_bytes").alias("n_bytes"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    fits = sizes.where((F.col("n_bytes") <= max_bytes) | (F.col("low") == F.col("high")))
    found = grid.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"])
    depth = found.groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(depth, "cell", "left")


def shards(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8, 0 for null), ``depth``, ``shard`` ("depth/prefix"), ``page``.

    Every (shard, page) holds ``max_bytes`` at most, or is a single larger row.
    ``page`` is 0 but where rows repeat one id beyond the limit: such rows
    share all hash bits, so they are dealt out over overflow pages, numbered
    within each input partition. Null ids count as one id, the empty string.
    An empty table gives no rows. Other columns are not read, but a
    ``row_col`` is returned too.
    """
    carried = [row_col] if row_col else []
    rows = docs.select(
        *carried,
        F.col(id_col).alias("id"),
        id_hash(F.col(id_col)).alias("h"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("part"),
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    above, bits = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, total / max_bytes)))) + 4)
    placed, rest = [], rows
    while True:
        leaves = _leaves(rest, above, bits, max_bytes)
        dealt = rest.withColumn("cell", _prefix(bits)).join(leaves, "cell").drop("cell")
        placed.append(dealt.where("depth is not null"))
        if bits == HASH_BITS or leaves.where("depth is null").limit(1).count() == 0:
            break
        rest = dealt.where("depth is null").drop("depth")
        above, bits = bits + 1, min(HASH_BITS, bits + FINER)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)

    # rows of one id beyond the limit: pages of small rows filled by halves of the limit, larger rows alone
    half = max(1, max_bytes // 2)
    heavy = rows.groupBy("h").agg(F.sum("n_bytes").alias("all"), F.count(F.lit(1)).alias("rows"))
    heavy = heavy.where((F.col("all") > max_bytes) & (F.col("rows") > 1)).select("h", F.lit(True).alias("heavy"))
    small = F.col("n_bytes") <= half
    own = Window.partitionBy("h", "part", small)
    filled = F.sum("n_bytes").over(own.orderBy("n_bytes", "id").rowsBetween(Window.unboundedPreceding, 0))
    number = F.when(small, F.expr(f"(filled - 1) div {half}")).otherwise(-F.col("nth"))
    paged = (
        out.join(heavy, "h")
        .withColumn("filled", F.greatest(filled, F.lit(1)))
        .withColumn("nth", F.row_number().over(own.orderBy("n_bytes", "id")))
        .withColumn("page", F.concat_ws(":", F.col("part") + 1, number))
        .select(*carried, "id", "n_bytes", "depth", "h", "page")
    )
    single = out.join(heavy, "h", "left_anti").withColumn("page", F.lit("0"))
    return single.select(*carried, "id", "n_bytes", "depth", "h", "page").unionByName(paged).select(
        *carried,
        F.col("id").alias(id_col),
        "n_bytes",
        "depth",
        F.concat_ws("/", "depth", _prefix("depth")).alias("shard"),
        "page",
    )
