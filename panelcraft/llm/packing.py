"""Packing token sequences: large items matched in pairs, small ones best-fit into the gaps.

Lengths are whole numbers up to the capacity, so the packing is worked out on
the histogram of lengths, which has as many entries as the capacity however
many documents there are:

1. Pieces above a third of the capacity share a sequence at most two by two.
   From the longest down, each is matched with the longest that still fits.
2. Shorter pieces, longest first, go to the sequence with the smallest gap that
   holds them; a new sequence is opened only where no gap does.

Sequences that come out alike are one row of the plan. Placing a length touches
whole rows of the plan and splits one at most, so the plan stays about as long as
the capacity. Every piece then finds its sequence and offset from its length and
its number among the pieces of that length alone.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import slices
from panelcraft.llm.token_counts import _byte_letters, load
from panelcraft.session import materialise

#: distinct strings whose ids a worker remembers between slices, and the bytes of the longest of them
REMEMBERED, LONGEST = 400_000, 64
#: kinds of bytes: the last of an unknown character, white space, signs, letters, digits
OTHER, BLANK, SIGN, LETTER, DIGIT = range(5)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[[0x20, *range(0x09, 0x0E)]] = BLANK
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[0x30:0x3A] = DIGIT
#: CUTS[5 * before + after]: no token spans the two
CUTS = np.isin(np.arange(25), [5 * SIGN + BLANK, *(5 * x + y for x in (LETTER, DIGIT) for y in (BLANK, SIGN, LETTER, DIGIT) if x != y)])
#: strings that are one pre-token: letters, digits or signs alone, after a space at most
ONE_PRE_TOKEN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: more pieces of one length than there will ever be
RANKS = 1 << 44


def _merger(path: str) -> Callable[[bytes], list[int]]:
    """Ids of one pre-token by the tokenizer's merges, which must be numbered in their order."""
    model, letters = json.loads(Path(path).read_text())["model"], _byte_letters()
    ranks = {bytes(map(letters.__getitem__, token)): k for token, k in model["vocab"].items() if set(token) <= letters.keys()}
    ids = [model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in model["merges"]]
    if ids != sorted(ids) or len(ids) + 256 != len(ranks):
        raise ValueError(f"{path}: the ids aren't in the order of the merges")
    return tiktoken.Encoding(path, pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Ids of texts by a byte-level tokenizer, each distinct string between cuts encoded once.

    Such a tokenizer never joins a visible character with white space after it, a
    letter with a following character that is none, or a digit with one that is
    none, so a text may be cut there. Cuts are made only after ASCII or Latin-1
    characters and before ASCII ones, and not inside an added token; other scripts
    stay in one string.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.merge = _merger(path)
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.known: dict[bytes, bytes] = {}

    def _encoded(self, strings: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each string: single pre-tokens need only their merges, the tokenizer does the rest."""
        plain, merge = ONE_PRE_TOKEN.fullmatch, self.merge
        out = {s: array("I", merge(s)).tobytes() for s in strings if len(s) <= LONGEST and plain(s)}
        rest = [s for s in strings if s not in out]
        found = self.tokenizer.encode_batch_fast([s.decode() for s in rest], add_special_tokens=False)
        return out | {s: array("I", e.ids).tobytes() for s, e in zip(rest, found)}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = KINDS[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[latin] = np.where((data[latin] == 0x97) | (data[latin] == 0xB7), SIGN, LETTER)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = CUTS[kind[:-1] * np.uint8(5) + KINDS[data[1:]]]
        for match in self.added.finditer(data):
            cut[match.start() + 1 : match.end()] = False
        cut[offsets] = True
        at = np.flatnonzero(cut)
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = strings.dictionary_encode()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        raw = coded.dictionary.buffers()[2].to_pybytes()
        distinct = [raw[a:b] for a, b in zip(ends, ends[1:])]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self._encoded([s for s in distinct if s not in self.known])
        per = [self.known[s] if s in self.known else new[s] for s in distinct]
        self.known.update((s, ids) for s, ids in new.items() if len(s) <= LONGEST)
        flat = np.frombuffer(b"".join(per), np.uint32)
        size = np.fromiter(map(len, per), np.int64, len(per)) // flat.itemsize
        codes = coded.indices.to_numpy()
        n = size[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - ends + n, n) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(at, offsets)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """``id, piece, start, length, ids_crc32, task, nth`` (and ``ids``), written once.

    A document's ids are its text's and ``end_id``; more than ``capacity`` are cut
    into full pieces, the first one taking what is left over. ``nth`` numbers
    the pieces of a length that one task wrote.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, 1):
            found, starts = encode(batch.column(1))
            texts = np.arange(batch.num_rows)
            ids = np.full(len(found) + batch.num_rows, end_id, np.uint32)
            ids[np.arange(len(found)) + np.repeat(texts, np.diff(starts))] = found
            size = np.diff(starts) + 1
            n = -(-size // capacity)
            owner = np.repeat(texts, n)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            first = (size - 1) % capacity + 1
            length = np.where(piece == 0, first[owner], capacity)
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            begin = (starts[:-1] + texts)[owner] + start
            raw = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            firsts = np.searchsorted(length[order], length[order])
            nth = np.empty(len(owner), np.int64)
            nth[order] = seen[length[order]] + np.arange(len(owner)) - firsts
            seen += np.bincount(length, minlength=capacity + 1)
            out = {
                "id": batch.column(0).take(pa.array(owner)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "nth": pa.array(nth),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([begin, [len(ids)]]), pa.int32()), pa.array(ids.astype(np.int32))
                )
            yield pa.RecordBatch.from_pydict(out)

    kinds = f"id {id_type}, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids
    cut = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, kinds)
    return materialise(cut.withColumn("task", F.spark_partition_id()), "pieces")


def plan(histogram: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences for ``histogram[length]`` pieces: ``(how many alike, [(length, how many of it)])``."""
    capacity, left = len(histogram) - 1, histogram.copy()
    small = capacity // 3
    rows: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by gap
    gaps: list[int] = []  # ascending

    def put(n: int, content: list[tuple[int, int]], gap: int) -> None:
        if n and gap not in rows:
            bisect.insort(gaps, gap)
        if n:
            rows.setdefault(gap, []).append((n, content))

    def take(least: int) -> tuple[int, list[tuple[int, int]], int]:
        """Sequences with the smallest gap that holds a piece; empty ones where there is none."""
        k = bisect.bisect_left(gaps, least)
        if k == len(gaps):
            return 0, [], capacity
        gap = gaps[k]
        n, content = rows[gap].pop()
        if not rows[gap]:
            del rows[gap], gaps[k]
        return n, content, gap

    for x in range(capacity, small, -1):
        while left[x]:
            others = left[: min(x, capacity - x) + 1].copy()
            if x < len(others):
                others[x] -= 1  # a piece is no match for itself
            fits = np.flatnonzero(others[small + 1 :])
            if not len(fits):
                put(int(left[x]), [(x, 1)], capacity - x)
                left[x] = 0
                continue
            y = int(fits[-1]) + small + 1
            n = int(left[x] // 2 if x == y else min(left[x], left[y]))
            put(n, [(x, 2)] if x == y else [(x, 1), (y, 1)], capacity - x - y)
            left[x] -= n
            left[y] -= n

    for x in range(small, 0, -1):
        rest = int(left[x])
        while rest:
            n, content, gap = take(x)
            each = gap // x
            full = min(n, rest // each) if n else rest // each
            put(full, [*content, (x, each)], gap - each * x)
            rest -= full * each
            opened = n == 0
            n -= full
            if rest and (opened or n):  # fewer than one sequence holds
                put(1, [*content, (x, rest)], gap - rest * x)
                n, rest = n - 1, 0
            if not opened:
                put(n, content, gap)
    return [row for gap in gaps for row in rows[gap]]


def _places(rows: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """One line for each plan row and length, by its first piece: that piece's key, pieces a sequence, first sequence, offset, length."""
    used: dict[int, int] = {}
    sequence, lines = 0, []
    for n, content in rows:
        offset = 0
        for length, each in content:
            lines.append((length * RANKS + used.get(length, 0), each, sequence, offset, length))
            used[length] = used.get(length, 0) + n * each
            offset += each * length
        sequence += n
    return np.array(sorted(lines), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    Each row of ``docs`` is a document of its own, also with a null or repeated id.
    A null text counts as empty: its only id is ``end_id``. Documents are whole
    where they fit; longer ones are cut. Other columns are not read; no rows
    give no rows. ``ids_crc32`` is over the ids as unsigned little-endian 32-bit
    numbers. Sequences are numbered from 0.
    """
    cut = pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids)
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counted = by_task.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # a row for each length
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counted["length"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    places = cut.sparkSession.sparkContext.broadcast(_places(plan(histogram)))  # bounded by the capacity
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, each, sequence, offset, size = places.value.T
        for batch in batches:
            rank = batch.column(0).to_numpy()
            line = np.searchsorted(at, rank, side="right") - 1
            nth = rank - at[line]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sequence[line] + nth // each[line]), pa.array(offset[line] + nth % each[line] * size[line])],
                names=[*batch.schema.names[1:], "sequence_id", "offset"],
            )

    key = (F.col("length") * RANKS + F.col("before") + F.col("nth")).alias("key")
    numbered = cut.join(first, ["length", "task"]).select(key, *(c for c in cut.columns if c not in ("nth", "task")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema[1:])
    return numbered.mapInArrow(run, f"{kinds}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: ``sequence_id``, ``ids``, and ``spans``
    (offset, length, id, piece, start) in their order. A sequence has at most ``capacity`` pieces."""
    span = F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "start", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    plain = F.transform("spans", lambda s: s.dropFields("ids"))
    return rows.select("sequence_id", F.flatten(F.col("spans.ids")).alias("ids"), plain.alias("spans"))
