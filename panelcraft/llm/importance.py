"""Importance resampling towards a target distribution of hashed n-grams.

The n-grams of the raw documents and of the target texts are counted by the
CRC-32 of their bytes modulo a fixed number of buckets. A bucket's gain is the
smoothed log ratio of the two distributions; a document weighs the sum of its
n-grams' gains. Adding Gumbel noise to the weights and taking the highest
scores draws documents without replacement with odds given by the weights.

Every text is normalised to words joined by one space and scanned once; the
scan keeps the CRC register after each byte. The CRC of any n-gram then comes
from two of these registers (``_crc``), however long the n-grams are.

Words: A-Z lower-cased; runs of 0-9, a-z and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcraft.llm._crc import running, substring_crcs
from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import ALNUM_WORDS, slices
from panelcraft.operators.ordering import global_row_index
from panelcraft.session import materialise


def normalised(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a string array joined by one space, and where each word starts and ends there.

    Returns ``(bytes, starts, ends, firsts)``: text ``i`` has the words ``firsts[i]`` to ``firsts[i + 1]``.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    none = np.zeros(0, np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64)
    data = table[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    letter = data != 0x20
    opens = np.concatenate([[True], ~letter[:-1]])
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(letter)
    opens = opens[at]
    place = np.arange(len(at)) + np.cumsum(opens) - 1
    starts = place[opens]
    out = np.full(int(place[-1]) + 1 if len(at) else 0, 0x20, np.uint8)
    out[place] = data[at]
    ends = np.concatenate([starts[1:] - 1, [len(out)]])[: len(starts)]
    return out, starts, ends, np.searchsorted(at[opens], offsets)


def ngram_buckets(texts: pa.Array, min_n: int, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, text)`` of every n-gram of a string array, and the words of each text."""
    data, starts, ends, firsts = normalised(texts, ALNUM_WORDS)
    counts = np.diff(firsts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    owner = np.repeat(np.arange(len(counts)), counts)
    registers = running(data)
    found, owners = [], []
    for n in range(min_n, max_n + 1):
        at = np.arange(len(starts) - n + 1) if n <= len(starts) else np.zeros(0, np.int64)
        at = at[owner[at] == owner[at + n - 1]]
        found.append(substring_crcs(registers, starts[at], ends[at + n - 1]).astype(np.int64) % buckets)
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners), counts


def bucket_counts(texts: DataFrame, text_col: str, min_n: int, max_n: int, buckets: int) -> DataFrame:
    """``bucket, n``: n-grams of all texts by bucket; a task hands on one row a bucket at most."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            total += np.bincount(ngram_buckets(batch.column(0), min_n, max_n, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> pd.DataFrame:
    """``bucket, gain`` of every bucket from the counts of both sides: 1000 times the natural log ratio, rounded down.

    ``buckets`` bounds the rows, the joins and what reaches the driver.
    """
    both = (
        raw.sparkSession.range(buckets)
        .select(F.col("id").alias("bucket"))
        .join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .fillna(0, ["s", "t"])
        .toPandas()
        .sort_values("bucket", ignore_index=True)
    )
    s, t = both["s"].to_numpy(np.float64), both["t"].to_numpy(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return pd.DataFrame({"bucket": both["bucket"], "gain": np.floor(1000 * np.log(ratio)).astype(np.int64)})


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate given by the seed and the id, rounded down; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int,
    min_n: int = 1,
    max_n: int = 1,
    buckets: int = 10_000,
    min_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (all long).

    Features are the runs of ``min_n`` to ``max_n`` words, repeats counted. Of
    the N rows with at least ``min_words`` words, the ``percent * N / 100`` (rounded
    down) highest scores are drawn and numbered from 1, ties to the smaller id,
    a null id last, then to fewer features; other rows have a null rank. Null and
    empty texts have no features and weigh 0; repeated rows count and are drawn
    each; other columns are not read. No documents or no target texts are no
    error: that side's counts are 0.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    table = gains(
        bucket_counts(docs, text_col, min_n, max_n, buckets), bucket_counts(target, target_text, min_n, max_n, buckets), buckets
    )
    gain = docs.sparkSession.sparkContext.broadcast(table["gain"].to_numpy())  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bucket, owner, words = ngram_buckets(batch.column(1), min_n, max_n, buckets)
            order = np.argsort(owner, kind="stable") if max_n > min_n else slice(None)
            ends = np.cumsum(np.bincount(owner, minlength=len(words)))
            sums = np.concatenate([[0], np.cumsum(gain.value[bucket[order]])])
            features = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(features), pa.array(sums[ends] - sums[ends - features])],
                names=["id", "n_words", "n_features", "weight"],
            )

    weighed = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, n_words long, n_features long, weight long"
    )
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    n = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    # the row's number spreads equal rows over the partitions of the sort
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "row"]
    ranked = global_row_index(scored.where(F.col("n_words") >= min_words), order, "place")
    ranked = ranked.withColumn("rank", F.when(F.col("place") < n, F.col("place") + 1)).drop("place")
    others = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.unionByName(others)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
