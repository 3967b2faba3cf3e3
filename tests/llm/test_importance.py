"""Importance resampling: CRCs of substrings and the draw, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcraft.llm import importance
from panelcraft.llm._crc import moved, running, substring_crcs, text_crcs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, min_n, max_n):
    w = WORD.findall(lower(text))
    return [" ".join(w[k : k + n]) for n in range(min_n, max_n + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, percent, min_n, max_n, buckets, min_words, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(place, features(text, min_n, max_n)))
    for text in target:
        t.update(map(place, features(text, min_n, max_n)))
    n_s, n_t = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets))))
    rows = []
    for doc_id, text in docs:
        found = features(text, min_n, max_n)
        weight = sum(gain(place(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(WORD.findall(lower(text))), len(found), weight, score, None])
    eligible = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(eligible[: len(eligible) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.randoms(use_true_random=False))
def test_substring_crcs_equal_zlib(data, rnd):
    bounds = [sorted((rnd.randint(0, len(data)), rnd.randint(0, len(data)))) for _ in range(20)]
    start, end = np.array(bounds, np.int64).T
    got = substring_crcs(running(np.frombuffer(data, np.uint8)), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in bounds]


def test_registers_add_up_over_parts():
    parts = [b"", b"a", b"hello world", b"\x00\xff" * 700]
    left = text_crcs([b"7:"])
    for part, own in zip(parts, text_crcs(parts)):
        joined = moved(left, len(part)) ^ own
        assert joined.tolist() == text_crcs([b"7:" + part]).tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB1 é漢.\n", max_size=30)), max_size=8), st.integers(1, 3), st.integers(0, 3))
def test_buckets_equal_plain_python(texts, min_n, more):
    bucket, owner, words = importance.ngram_buckets(pa.array(["dropped", *texts], pa.string())[1:], min_n, min_n + more, 97)
    assert words.tolist() == [len(WORD.findall(lower(t))) for t in texts]
    expected = [(i, zlib.crc32(f.encode()) % 97) for i, t in enumerate(texts) for f in features(t, min_n, min_n + more)]
    assert sorted(zip(owner.tolist(), bucket.tolist())) == sorted(expected)


@pytest.mark.parametrize("min_n, max_n", [(1, 1), (1, 2), (3, 3)])
def test_resample_equals_brute_force(spark, edge_docs, min_n, max_n):
    rnd = random.Random(5)
    more = [(100 + k % 25, " ".join(rnd.choices(["Alpha", "beta", "gamma9", "δ", "end."], k=rnd.randint(0, 9)))) for k in range(60)]
    docs = edge_docs.select("text", "n", "row", "doc_id", "score").unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True
    )
    target = spark.createDataFrame([("gamma9 gamma9 δ δ",), (None,), ("the lazy dog",)], "text string")
    how = dict(percent=40, min_n=min_n, max_n=max_n, buckets=50, min_words=2, seed=7)
    got = importance.resample(docs, target, **how).collect()
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == brute(plain, [r.text for r in target.collect()], **how)


def test_resample_of_empty_tables(spark, edge_docs, no_docs):
    assert importance.resample(no_docs, edge_docs, percent=10).count() == 0
    drawn = importance.resample(edge_docs, no_docs, percent=50, min_words=1).where("rank is not null").collect()
    assert sorted(r["rank"] for r in drawn) == [1, 2, 3, 4]
