"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the training texts as postings in the shared folder. The
index is partitioned by document: a block holds a few thousand texts, numbered
one after the other with a gap between texts, and one posting row for each
block and term: the term's positions in the block, ascending. ``search`` reads
only the rows of terms that occur in the test items and works block by block:
for every test window the offset-adjusted position lists are intersected
starting from the block's rarest term, so most windows end with the first
list. What survives all terms is an exact phrase; ``slack`` > 0 asks for
proximity matches instead (all terms within the window length plus slack).

Words: A-Z lower-cased; runs of 0-9, a-z and non-ASCII characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import ALNUM_WORDS, Words, slices, split_words
from panelcraft.session import materialise

#: bytes of a block's texts (about; at least one text), and the unused positions after each text
BLOCK_BYTES = 8 << 20
GAP = 1 << 10
#: the row of a block that lists its texts has no term
TEXTS = 0


def _terms(words: Words) -> np.ndarray:
    """Signed 64-bit term hashes of the batch's vocabulary; never TEXTS."""
    terms = words.hashes().view(np.int64)
    return np.where(terms == TEXTS, 1, terms)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of whole texts, written once: ``block, term, positions, ids, starts``.

    ``positions``: ascending 64-bit positions of the term. The row with term 0
    has the block's ids (null ids kept) and where each text starts, with one
    start more for the end. Null and empty texts have no words.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, BLOCK_BYTES):
            words = split_words(part.column(2), ALNUM_WORDS)
            # a block is named after its first row, which no other block has
            name = part.column(0)[0].as_py()
            starts = words.starts + GAP * np.arange(len(words) + 1)
            n = len(words.vocabulary)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(words.codes, minlength=n))])
            # a word's position is its place and the gaps before its text; 32 bits, as they are stored
            order = np.argsort(words.codes, kind="stable").astype(np.int32)
            positions = np.searchsorted(words.starts, order, side="right").astype(np.int32)
            positions -= 1
            positions *= GAP
            positions += order
            packed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(positions, pa.int32()))
            none = pa.nulls(n, pa.list_(part.schema.field(1).type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, name)), pa.array(_terms(words)), packed, none, pa.nulls(n, pa.list_(pa.int32()))],
                names=["block", "term", "positions", "ids", "starts"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([TEXTS]),
                    pa.nulls(1, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1)),
                    pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
                ],
                names=["block", "term", "positions", "ids", "starts"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    index = rows.mapInArrow(
        run, f"block long, term long, positions array<int>, ids array<{id_type}>, starts array<int>"
    )
    return materialise(index, "postings")


class Windows:
    """The test windows of a bounded set of items, as offsets into distinct terms."""

    def __init__(self, items: list[str], texts: list[str | None], n: int):
        words = split_words(pa.array(texts, pa.string()), ALNUM_WORDS)
        self.terms = _terms(words)
        self.items = items
        found = []
        for i, (a, b) in enumerate(zip(words.starts, words.starts[1:])):
            codes = words.codes[a:b]
            found += [(i, codes[k : k + n]) for k in range(max(len(codes) - n + 1, min(len(codes), 1)))]
        self.owner = [i for i, _ in found]
        self.codes = [c for _, c in found]


def _covers(codes: list[int], lists: dict[int, np.ndarray], rarest: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """``(first, last)`` of every shortest stretch of ``reach + 1`` words at most that has all terms, each as often as in ``codes``.

    Only positions within reach of the rarest term are looked at; one pass over them in order.
    """
    needed = Counter(codes)
    near = []
    for c in needed:
        at = lists[c]
        i = np.searchsorted(rarest, at)
        gap = np.minimum(np.abs(rarest[np.minimum(i, len(rarest) - 1)] - at), np.abs(at - rarest[np.maximum(i - 1, 0)]))
        near += [(p, c) for p in at[gap <= reach].tolist()]
    near.sort()
    held: Counter = Counter()
    missing, left, found = len(codes), 0, []
    for position, c in near:
        missing -= held[c] < needed[c]
        held[c] += 1
        while held[near[left][1]] > needed[near[left][1]]:  # its first word is there once more
            held[near[left][1]] -= 1
            left += 1
        first = near[left][0]
        if not missing and position - first <= reach and (not found or found[-1][0] < first):
            found.append((first, position))
    return found


def intersect(windows: Windows, lists: dict[int, np.ndarray], slack: int = 0) -> list[tuple[int, int, int]]:
    """``(item, first position, last position)`` of every window that occurs.

    ``lists``: ascending positions by term code. The rarest term comes first;
    each further list is shifted by its offset and intersected. With slack, the
    terms may stand in any order within the window length plus slack.
    """
    found = []
    for item, codes in zip(windows.owner, windows.codes):
        if not all(c in lists for c in codes.tolist()):
            continue
        by_size = sorted(range(len(codes)), key=lambda k: len(lists[codes[k]]))
        if slack:
            found += [(item, a, b) for a, b in _covers(codes.tolist(), lists, lists[codes[by_size[0]]], len(codes) - 1 + slack)]
            continue
        start = lists[codes[by_size[0]]] - by_size[0]
        for k in by_size[1:]:
            at = lists[codes[k]] - k
            if len(start) * 20 < len(at):
                i = np.searchsorted(at, start)
                start = start[at[np.minimum(i, len(at) - 1)] == start]
            else:
                start = start[np.isin(start, at, assume_unique=True)]
            if not len(start):
                break
        found += [(item, int(a), int(a) + len(codes) - 1) for a in start]
    return found


def _spans(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping or touching matches of one item as one span."""
    spans: list[list[int]] = []
    for item, a, b in sorted(found):
        if spans and spans[-1][0] == item and a <= spans[-1][2] + 1:
            spans[-1][2] = max(spans[-1][2], b)
        else:
            spans.append([item, a, b])
    return [tuple(s) for s in spans]


def search(index: DataFrame, windows: Windows, slack: int = 0) -> DataFrame:
    """Every text of the index: ``block, number, id, n_words`` and, a row for each matched span,
    ``item, first, last`` (words from 0 within the text); one row with nulls if nothing matched."""
    ship_package(index.sparkSession)
    spark = index.sparkSession
    code = {int(t): k for k, t in enumerate(windows.terms.tolist())}
    # as many terms as the set of items has words: bounded by its bytes
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [*code, TEXTS]], "term long"))
    id_type = index.schema["ids"].dataType.elementType

    def run(block: pd.DataFrame) -> pd.DataFrame:
        texts = block[block.term == TEXTS].iloc[0]
        starts = np.asarray(texts.starts, np.int64)
        lists = {code[t]: np.asarray(p, np.int64) for t, p in zip(block.term, block.positions) if t != TEXTS}
        spans = _spans(intersect(windows, lists, slack))
        number = np.searchsorted(starts, [a for _, a, _ in spans], side="right") - 1
        out = [(int(k), windows.items[i], int(a - starts[k]), int(b - starts[k])) for k, (i, a, b) in zip(number, spans)]
        matched = {r[0] for r in out}
        out += [(k, None, None, None) for k in range(len(starts) - 1) if k not in matched]
        rows = pd.DataFrame(out, columns=["number", "item", "first", "last"]).astype({"first": "Int64", "last": "Int64"})
        rows["block"] = texts.block
        rows["id"] = pd.Series([texts.ids[k] for k in rows.number], dtype=object)
        rows["n_words"] = [int(starts[k + 1] - starts[k] - GAP) for k in rows.number]
        return rows[["block", "number", "id", "n_words", "item", "first", "last"]]

    read = index.join(wanted, "term", "left_semi")
    return read.groupBy("block").applyInPandas(
        run, f"block long, number int, id {id_type.simpleString()}, n_words long, item string, first long, last long"
    )


def item_blocks(items: DataFrame, item_id: str, item_text: str, max_bytes: int) -> Iterator[tuple[list, list]]:
    """The test items in sets whose texts have ``max_bytes`` bytes in all, or are a single item."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text"))
    ids, texts, size = [], [], 0
    for row in rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).toLocalIterator():
        if ids and size + len(row.text) * 4 > max_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text) * 4
    yield ids, texts


def contamination(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    slack: int = 0,
    max_query_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit``, ``items``, ``spans``.

    A window is ``n`` consecutive words of an item; an item of fewer words, but
    not none, is one window. ``n_hit`` counts the words inside any occurrence
    of a window, ``items`` are the sorted distinct ids (as strings) of items
    with occurring windows, ``spans`` the matches (item, first and last word).
    Null and empty texts have no words and no hits; items with a null id or
    text match nothing; repeated rows are reported each; other columns are not
    read. The items are searched for in sets of ``max_query_bytes`` at most,
    against the same index, so their number has no limit.
    """
    if slack + n >= GAP:
        raise ValueError(f"slack must be below {GAP - n}")
    index = build_index(docs, id_col, text_col)
    parts = [search(index, Windows(ids, texts, n), slack) for ids, texts in item_blocks(items, item_id, item_text, max_query_bytes)]
    found = reduce(DataFrame.unionByName, parts)
    span = F.when(F.col("item").isNotNull(), F.struct("first", "last", "item"))
    per_text = found.groupBy("block", "number").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    # words covered: spans come by first word, each adds what lies beyond all before it
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["last"] - F.greatest(s["first"] - 1, acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["last"]).alias("end"),
        ),
    )
    return per_text.select(
        F.col("id").alias(id_col), "n_words", covered["n"].alias("n_hit"), "items", "spans"
    )
