"""Best-fit packing: ids against the library, and the packing against exact cover and small optima."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcraft.llm import packing
from panelcraft.llm.token_counts import load

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the ", "don't", "'LL", "Straße", "ﬁ", "é", "é", "漢字", "½", "3½4", "²3", "\x85", "\xa0 ", "\n", "\x1c", "  ", "!!", "x42y", "<|endoftext|>", "<|", "×a÷", "　b", "zqxj"]


def library(text):
    return load(VOCABULARY).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=5)), max_size=8).map("".join)), max_size=10))
def test_ids_equal_the_library(texts):
    ids, starts = packing.encoder(VOCABULARY)(pa.array(["dropped", *texts], pa.string())[1:])
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [library(t) for t in texts]


def test_merges_equal_the_library_on_random_words():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("etaoinshrdluéüßñEB", k=rnd.randint(1, 24))) for _ in range(20_000)]
    ids, starts = packing.encoder(VOCABULARY)(pa.array([" " + w for w in words]))
    found = load(VOCABULARY).encode_batch_fast([" " + w for w in words], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in found]


def best(sizes, capacity):
    """Fewest bins, by trying all."""

    @lru_cache(maxsize=None)
    def left(items, gaps):
        if not items:
            return len(gaps)
        x, rest = items[0], items[1:]
        options = {g for g in gaps if g >= x}
        found = [left(rest, tuple(sorted([*gaps[: gaps.index(g)], *gaps[gaps.index(g) + 1 :], g - x]))) for g in options]
        return min([*found, left(rest, tuple(sorted([*gaps, capacity - x])))])

    return left(tuple(sorted(sizes, reverse=True)), ())


@settings(max_examples=80, deadline=None)
@given(st.integers(3, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_plan_holds_every_piece_once(case):
    capacity, sizes = case
    rows = packing.plan(np.bincount(sizes, minlength=capacity + 1).astype(np.int64))
    used = np.zeros(capacity + 1, np.int64)
    for n, content in rows:
        assert n > 0 and sum(length * each for length, each in content) <= capacity
        for length, each in content:
            used[length] += n * each
    assert used.tolist() == np.bincount(sizes, minlength=capacity + 1).tolist()
    n, fewest = sum(n for n, _ in rows), best(sizes, capacity)
    assert n == fewest if all(3 * s > capacity for s in sizes) else n <= fewest + 1


def test_plan_does_not_grow_with_the_documents():
    rng = np.random.default_rng(4)
    few = np.bincount(rng.integers(1, 2049, 5000), minlength=2049)
    rows = [packing.plan(few * n) for n in (1, 1000, 10**9)]
    assert max(map(len, rows)) < 3 * 2048
    least = int((few * np.arange(2049)).sum()) * 10**9 / 2048
    assert sum(n for n, _ in rows[2]) < 1.01 * least


def test_pack_is_an_exact_cover(spark, edge_docs):
    capacity = 40
    docs = edge_docs.repartition(3).unionByName(spark.createDataFrame([(50 + k, "word " * k) for k in range(90)], "doc_id long, text string"), allowMissingColumns=True)
    packed = packing.pack(docs, VOCABULARY, capacity, end_id=0, with_ids=True)
    rows = packed.collect()
    expected = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = [*library(r.text), 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids))] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == expected
    for at in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(at))]).tolist()
        assert [a for a, _ in sorted(at)] == ends[:-1] and ends[-1] <= capacity
    tokens = sum(r.length for r in rows)
    assert len(places) <= -(-tokens // capacity) + 2 and sorted(places) == list(range(len(places)))

    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(whole) == len(places)
    for r in rows:
        assert whole[r.sequence_id]["ids"][r.offset : r.offset + r.length] == r.ids
        assert (r.offset, r.length, r.doc_id, r.piece, r.start) in {tuple(s) for s in whole[r.sequence_id].spans}


def test_pack_of_no_documents(no_docs):
    packed = packing.pack(no_docs, VOCABULARY)
    assert packed.count() == 0 and packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
