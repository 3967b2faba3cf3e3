"""Spelling variants: words one edit apart, found by generated edits and Bloom filters.

The vocabulary is cut by word length, and each length has a blocked Bloom filter
(a word sets four bits of one 64-bit block). Every task gets the filters, whose
size has a fixed limit, generates the edits of its words and probes them. Only
positives are shuffled, as pairs of 64-bit hashes, to the join with the
vocabulary; comparing the two words then removes what merely collided.

Words with one inserted character are not generated: the longer word of such a
pair finds the shorter one by a deletion. Of two words that differ in one
character, that with the smaller character finds the other one.

A word's hash is a sum over its characters and their positions, so that the
hashes of all its edits come from two running sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm._crc import ONES, moved, text_crcs
from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import MASK, letters, mix64, slices, split_words
from panelcraft.session import materialise

#: bits of a filter for each word, and the bytes that all filters have at most; a larger
#: vocabulary gets fewer bits a word, so more positives, and the same result
BITS_A_WORD, FILTER_BYTES = 16, 64 << 20
#: words of this length and more share a filter
LONG = 48
#: blocks of a filter that travel together
SEGMENT = 1 << 17
#: edits worked on at a time
EDITS = 1 << 20

PLACE, LENGTH = 0x632BE59BD9B4E019, 0x9E3779B97F4A7C15


def _part(character: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """What a character adds to its word's sum at a place."""
    return mix64(character.astype(np.uint64) + (np.asarray(place).astype(np.uint64) + np.uint64(1)) * np.uint64(PLACE))


def _hash(sums: np.ndarray, length: int) -> np.ndarray:
    return mix64(sums + np.uint64(length * LENGTH & MASK))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(indices, code points)`` of the words of each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        joined = "".join(words[k] for k in at.tolist()).encode("utf-32-le")
        yield at, np.frombuffer(joined, np.uint32).reshape(len(at), length)


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, characters in _by_length(words):
        length = characters.shape[1]
        out[at] = _hash(_part(characters, np.arange(length)).sum(axis=1, dtype=np.uint64), length)
    return out


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes & np.uint64(blocks - 1)).astype(np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Four bits of a block."""
    out = np.zeros(hashes.shape, np.uint64)
    for k in range(4):
        out |= np.uint64(1) << ((hashes >> np.uint64(40 + 6 * k)) & np.uint64(63))
    return out


def shard(length: int) -> int:
    return min(length, LONG)


def _positives(hashes: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
    if blocks is None:
        return np.zeros(hashes.shape, bool)
    bits = _bits(hashes)
    return blocks[_block(hashes, len(blocks))] & bits == bits


def probe(characters: np.ndarray, alphabet: np.ndarray, filters: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, hash)`` of the edits of words of one length that pass the filters: deletions, and
    replacements by a larger character of the alphabet."""
    n, length = characters.shape
    if not n or not length:
        return
    places = np.arange(length)
    own = _part(characters, places)
    before = np.cumsum(own, axis=1, dtype=np.uint64) - own
    total = (before[:, -1] + own[:, -1])[:, None]
    shifted = _part(characters[:, 1:], places[:-1])
    after = np.zeros_like(own)  # what the characters beyond a deleted one add, one place earlier
    after[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    deleted = _hash(before + after, length - 1)
    row, at = np.nonzero(_positives(deleted, filters.get(shard(length - 1))))
    yield row, deleted[row, at]
    blocks = filters.get(shard(length))
    if blocks is None:
        return
    step = max(1, EDITS // max(1, n * len(alphabet)))
    for a in range(0, length, step):
        b = min(length, a + step)
        larger = alphabet[None, None, :] > characters[:, a:b, None]
        row, at, new = np.nonzero(larger)
        put = _part(alphabet[None, :], places[a:b, None])
        hashes = _hash((total - own)[row, a + at] + put[at, new], length)
        hit = _positives(hashes, blocks)
        yield row[hit], hashes[hit]


def damaged_counts(docs: DataFrame, min_length: int, damage_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: occurrences of the letter runs of whole texts with at least ``min_length`` characters.

    Runs of the letters A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased. With
    ``damage_every``, misspellings are planted: the CRC-32 of ``<id>:<run>``,
    where that number divides it, deletes the character at the CRC modulo the run's
    length. A null id counts as an empty one.
    """
    ship_package(docs.sparkSession)

    def damaged(word: str, crc: int) -> str:
        at = crc % len(word)
        return word[:at] + word[at + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = split_words(batch.column(1), letters)
            if not len(words.codes):
                continue
            long = pc.greater_equal(pc.utf8_length(words.vocabulary), min_length).to_numpy(zero_copy_only=False)
            counted = long[words.codes]
            size = len(words.vocabulary)
            pairs, n = np.unique(words.owners()[counted] * size + words.codes[counted], return_counts=True)
            owner, code = pairs // size, pairs % size
            changed = np.zeros(len(pairs), bool)
            if damage_every:
                names = pc.fill_null(batch.column(0), "").to_pylist()
                left = np.array([zlib.crc32(f"{name}:".encode()) for name in names], np.uint32) ^ ONES
                raw = words.vocabulary.cast(pa.large_binary())
                crcs = moved(left[owner], pc.binary_length(raw).to_numpy()[code]) ^ text_crcs(raw.to_pylist())[code] ^ ONES
                changed = crcs % np.uint32(damage_every) == 0
            total = np.bincount(code[~changed], n[~changed], minlength=size).astype(np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([words.vocabulary.take(pa.array(used)).cast(pa.string()), pa.array(total[used])], names=["word", "n"])
            if changed.any():
                runs = words.vocabulary.take(pa.array(code[changed])).to_pylist()
                made = [damaged(w, c) for w, c in zip(runs, crcs[changed].tolist())]
                kept = [k for k, w in enumerate(made) if len(w) >= min_length]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made[k] for k in kept], pa.string()), pa.array(n[changed][kept])], names=["word", "n"]
                )

    found = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _hashed(vocabulary: DataFrame) -> DataFrame:
    """``word, n, hash, length``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(word_hashes(words).view(np.int64)), pc.utf8_length(batch.column(0)).cast(pa.int32())],
                names=["word", "n", "hash", "length"],
            )

    return materialise(vocabulary.select("word", "n").mapInArrow(run, "word string, n long, hash long, length int"), "vocabulary")


def filters(hashed: DataFrame) -> dict[int, np.ndarray]:
    """A filter for each length, as 64-bit blocks; ``FILTER_BYTES`` in all at most."""
    by_shard = hashed.groupBy(F.least("length", F.lit(LONG)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    words = {r.shard: r.n for r in by_shard.collect()}  # a row for each length up to LONG
    if not words:
        return {}
    wanted = sum(words.values()) * BITS_A_WORD // 8
    scale = min(1.0, FILTER_BYTES / wanted)
    # a power of two, rounded down where the limit binds
    blocks = {s: 1 << max(0, int(np.floor(np.log2(max(1.0, n * BITS_A_WORD / 64 * scale)) + (scale == 1.0)))) for s, n in words.items()}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, shards = batch.column(0).to_numpy().view(np.uint64), np.minimum(batch.column(1).to_numpy(), LONG)
            count = np.array([blocks.get(s, 1) for s in range(LONG + 1)], np.uint64)[shards]
            block = (hashes & (count - np.uint64(1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), pa.array(block), pa.array(_bits(hashes).view(np.int64))], names=["shard", "block", "bits"]
            )

    def pack(segment: pd.DataFrame) -> pd.DataFrame:
        s, first = int(segment["shard"].iloc[0]), int(segment["segment"].iloc[0]) * SEGMENT
        out = np.zeros(min(SEGMENT, blocks[s] - first), np.int64)
        out[segment["block"].to_numpy() - first] = segment["bits"].to_numpy()
        return pd.DataFrame({"shard": [s], "first": [first], "blocks": [out.tobytes()]})

    marked = hashed.select("hash", "length").mapInArrow(mark, "shard int, block long, bits long")
    merged = marked.groupBy("shard", "block").agg(F.bit_or("bits").alias("bits"))
    merged = merged.withColumn("segment", F.floor(F.col("block") / SEGMENT).cast("long"))
    packed = merged.groupBy("shard", "segment").applyInPandas(pack, "shard int, first long, blocks binary")
    found = {s: np.zeros(n, np.uint64) for s, n in blocks.items()}
    for r in packed.collect():  # FILTER_BYTES at most
        part = np.frombuffer(r["blocks"], np.uint64)
        found[r["shard"]][r["first"] : r["first"] + len(part)] = part
    return found


def near_pairs(hashed: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words that differ by one inserted, deleted or replaced character, once."""
    spark = hashed.sparkSession
    ship_package(spark)
    used = hashed.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    # the characters that words are made of: Unicode bounds them
    alphabet = np.array(sorted(ord(r.c) for r in used.collect()), np.uint32)
    sent = spark.sparkContext.broadcast(filters(hashed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(1).to_numpy()
            for at, characters in _by_length(batch.column(0).to_pylist()):
                step = max(1, EDITS // max(1, characters.shape[1] * len(alphabet)))
                for a in range(0, len(at), step):
                    for row, found in probe(characters[a : a + step], alphabet, sent.value):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found.view(np.int64)), pa.array(source[at[a + row]])], names=["edit", "source"]
                        )

    positives = hashed.select("word", "hash").mapInArrow(run, "edit long, source long").distinct()
    side = lambda x, key: hashed.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}"), F.col("hash").alias(key))
    met = positives.join(side("b", "edit"), "edit").join(side("a", "source"), "source")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: each round doubles the steps taken; a form is more frequent than its word, so paths end."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialise(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if not links.where("went").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n`` (distinct words, none null).

    Two words are near if they differ by exactly one inserted, deleted or
    replaced character. A word's ``form`` is its near word of largest ``n``, ties to
    the smallest in code-point order, if that is at least ``ratio`` (2 or more) times
    its own; ``root`` follows forms to the last and is the word itself without
    one. ``n_near`` counts near words. No words give no rows; words of any length
    are compared whole; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    ship_package(vocabulary.sparkSession)
    hashed = _hashed(vocabulary)
    pairs = materialise(near_pairs(hashed), "near")
    near = pairs.select(F.col("a").alias("word"), "n_b", "b").unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_a").alias("n_b"), F.col("a").alias("b"))
    )
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best"))
    own = hashed.select("word", "n").join(best, "word", "left")
    formed = -F.col("best.m") >= ratio * F.col("n")
    out = own.select(
        "word",
        "n",
        F.when(formed, F.col("best.b")).alias("form"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.m")).alias("form_n"),
    )
    out = materialise(out, "forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(
    docs: DataFrame,
    min_length: int = 7,
    min_count: int = 2,
    ratio: int = 10,
    damage_every: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """:func:`variants` of the words of whole texts that have ``min_length`` characters and occur ``min_count`` times.

    Null and empty texts have no words; repeated rows count each; a null id is an
    empty one (ids matter only with ``damage_every``); other columns are not read.
    """
    words = damaged_counts(docs, min_length, damage_every, id_col, text_col).where(F.col("n") >= min_count)
    return variants(words, ratio)
