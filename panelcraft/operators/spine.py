"""Entity sets, calendar spines and keyed joins."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelcraft.session import materialise


def month_range(lo: str, hi: str) -> Column:
    """ARRAY<DATE> of month starts from ``lo`` to ``hi`` inclusive ('YYYY-MM-DD')."""
    return F.sequence(F.to_date(F.lit(lo)), F.to_date(F.lit(hi)), F.expr("INTERVAL 1 MONTH"))


def distinct_ids(df: DataFrame, id_col: str) -> DataFrame:
    """The ids present in a fact table (order is irrelevant)."""
    return df.select(id_col).where(F.col(id_col).isNotNull()).distinct()


def calendar_spine(ids: DataFrame, id_col: str, lo: str, hi: str, month: str = "month") -> DataFrame:
    """Ids x every month in [lo, hi] via a generator (no join, no shuffle)."""
    return ids.select(id_col, F.explode(month_range(lo, hi)).alias(month))


def attach(spine: DataFrame, facts: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Keyed join of facts (already one row per key) onto a spine.

    The planner chooses the strategy; adaptive execution turns it into a
    broadcast join when the runtime size of ``facts`` is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise keeps a
    sort-merge join with skew splitting.
    """
    return spine.join(facts, on=on, how=how)


def assert_unique_keys(df: DataFrame, keys: list[str], label: str = "frame") -> None:
    """Fail when a key occurs more than once (one distributed aggregate, bounded output)."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{label}: key {keys} is not unique, e.g. {dup[0].asDict()}")


def key_intersection(left: DataFrame, right: DataFrame, key: str | list[str], check_unique: bool = False) -> DataFrame:
    """Rows whose key exists on both sides, features of both in one row.

    Joining panels on their component keys (id, year, quarter) rather than
    the derived string key lets both sides keep the id partitioning they
    already have (no re-shuffle when co-partitioning on a key prefix is
    allowed, see ``session.DEFAULT_CONF``).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if check_unique:
        assert_unique_keys(left, keys, "left")
        assert_unique_keys(right, keys, "right")
    return left.join(right, on=keys, how="inner")


def blinded_key(c: str | Column, salt: str) -> Column:
    """Salted SHA-256 digest of a key (pseudonymisation, not a PSI protocol)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sha2(F.concat(F.lit(salt), col.cast("string")), 256)


def blinded_intersection(left: DataFrame, right: DataFrame, key: str, salt: str, out: str = "bkey") -> DataFrame:
    """Intersect two keyed frames on the salted digest; raw keys are dropped."""
    lb = left.withColumn(out, blinded_key(key, salt)).drop(key)
    rb = right.withColumn(out, blinded_key(key, salt)).drop(key)
    return lb.join(rb, on=out, how="inner")


#: where the key of the blinded join is read from
BLINDING_KEY = "spark.panelcraft.blinding.key"
#: bits of a filter for each key, and the words of 64 bits that a filter has at most (8 MB)
FILTER_BITS_A_KEY, MAX_FILTER_WORDS = 16, 1 << 20


def blinding_key(spark: SparkSession) -> bytes:
    """The key from the session's configuration; without one a new random key, which only this call's caller has."""
    text = spark.conf.get(BLINDING_KEY, None)
    return text.encode() if text else secrets.token_bytes(32)


def keyed_digest(c: str | Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a key column, as binary. The padded key is part of the plan, so keep plans of it private."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    col = (F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, col), 256))), 256))


def _filter_place(digest: Column, words: int) -> tuple[Column, Column]:
    """The word of a Bloom filter that a digest belongs to, and its four bits there."""
    bits = F.xxhash64(digest)
    mask = F.lit(0).cast("long")
    for k in range(4):
        at = F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return F.pmod(F.shiftright(bits, 24), F.lit(words).cast("long")), mask


def prune_by_filter(df: DataFrame, digest: str, other: DataFrame, other_digest: str) -> DataFrame:
    """The rows of ``df`` whose digest may be among the other side's: all that are, and a few more.

    The other side sends only a Bloom filter: a table of 64-bit words, broadcast, of
    ``MAX_FILTER_WORDS`` at most; with more keys it lets more rows through.
    """
    n = other.count()
    words = max(1, min(MAX_FILTER_WORDS, n * FILTER_BITS_A_KEY // 64))
    word, mask = _filter_place(F.col(other_digest), words)
    held = other.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    word, mask = _filter_place(F.col(digest), words)
    probed = df.withColumns({"__word": word, "__mask": mask}).join(F.broadcast(held), "__word")
    return probed.where(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*df.columns)


def keyed_intersection(left: DataFrame, right: DataFrame, key: str, secret: bytes, out: str = "bkey") -> DataFrame:
    """Intersect two keyed frames on a keyed digest; raw keys are dropped.

    The left side is first pruned by a filter of the right side's digests, so that
    rows without a partner are not shuffled. Null keys have no partner. Both sides' digests
    are written once: in one plan with the filter each use of a digest would compute it again.
    """
    blinded = lambda df: df.where(F.col(key).isNotNull()).withColumn(out, keyed_digest(key, secret)).drop(key)
    lb, rb = materialise(blinded(left), "blinded"), materialise(blinded(right), "blinded")
    return prune_by_filter(lb, out, rb, out).join(rb, on=out, how="inner")
