"""Operators on whole corpora: decontamination, n-gram join, top-k, components, id filter."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcraft.llm import decontaminate, ngram_join, vector_topk
from panelcraft.llm._components import components
from panelcraft.llm._id_filter import without_ids


def words_of(text, pattern):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


def random_docs(seed, n, vocabulary=400):
    """Texts of random words with copies, small edits, shared passages and a large group of near copies."""
    rnd = random.Random(seed)
    line = lambda k: [f"w{rnd.randrange(vocabulary)}" for _ in range(k)]
    passage, base = line(40), line(60)
    texts = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.2 and texts:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 3)):
                if words:
                    words[rnd.randrange(len(words))] = f"w{rnd.randrange(vocabulary)}"
        elif kind < 0.5:
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(vocabulary)}"
        elif kind < 0.7:
            words = line(rnd.randint(0, 60)) + passage + line(rnd.randint(0, 20))
        else:
            words = line(rnd.randint(0, 120))
        texts.append(" ".join(words))
    return texts


def brute_groups(rows, n, percent):
    sets = []
    for _, text in rows:
        w = words_of(text, r"[^\x20\x09-\x0D]+")
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(rows[i][0], len(s), least.get(find(i))) for i, s in enumerate(sets)]


KEY = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("n,percent,frequent", [(4, 85, 500_000), (5, 80, 0)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, n, percent, frequent):
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", frequent)
    rows = list(enumerate(random_docs(n, 260)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = ngram_join.similar_groups(docs, n=n, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows, n, percent))


def test_ngram_join_edge_cases(spark, edge_docs, no_docs):
    got = ngram_join.similar_groups(edge_docs, n=5, percent=80).select("doc_id", "n_shingles", "component_id").collect()
    expected = brute_groups([tuple(r) for r in edge_docs.select("doc_id", "text").collect()], 5, 80)
    assert sorted(map(tuple, got), key=KEY) == sorted(expected, key=KEY)
    assert ngram_join.similar_groups(no_docs).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_ids(spark, edge_docs):
    ids = spark.createDataFrame([(5,), (5,), (8,), (None,), (99,)], "doc_id long")
    got = without_ids(edge_docs, ids)
    assert got.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9]
    assert without_ids(edge_docs, ids.limit(0)).count() == edge_docs.count()


def brute_hits(text, items, n):
    w = words_of(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hit, found = set(), set()
    for item, item_text in items:
        q = words_of(item_text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for k in range(max(len(q) - n + 1, min(len(q), 1))):
            window = q[k : k + n]
            for at in range(len(w) - len(window) + 1):
                if item is not None and w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [32 << 20, 200])
def test_contamination_equals_brute_force(spark, most):
    texts = random_docs(9, 150, vocabulary=40)
    items = [(10 + i, " ".join(t.split()[3:30])) for i, t in enumerate(texts[:12])] + [(1, "w1 w2"), (2, "w3"), (3, ""), (4, None), (None, "w5")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, n=10, max_query_bytes=most).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == {
        i: brute_hits(t, items, 10) for i, t in enumerate(texts)
    }


def test_contamination_edge_cases(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "QUICK brown-fox"), (1, "quick brown fox"), (2, "one"), (3, "word1 long1 word2 long2")], "item_id long, text string")
    got = decontaminate.contamination(edge_docs, bench, n=10).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    items = [tuple(r) for r in bench.collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=lambda r: KEY(r[:3])) == sorted(
        ((r.doc_id, *brute_hits(r.text, items, 10)) for r in rows), key=lambda r: KEY(r[:3])
    )
    assert {r.n_hit for r in decontaminate.contamination(edge_docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(no_docs, bench).count() == 0


def test_proximity_matches_allow_words_between(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a x x x b c"), (4, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([("t", "a b c")], "item_id string, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, bench, n=3, slack=2).collect()}
    assert got == {1: 5, 2: 3, 3: 0, 4: 0}


def brute_top(rows, divisor, k):
    ok = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % divisor == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok) if b != a and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.normal(size=24) * 0.3).tolist()) for i in range(260)]
    rows += [(300 + i, rows[7][1]) for i in range(9)]  # ties
    rows += [(7, rows[7][1]), (20, rows[3][1])]  # repeated ids
    rows += [(400, None), (410, [None] * 24), (420, [float("nan")] * 24), (430, [float("inf")] * 24), (None, rows[1][1])]
    rows += [(440, []), (450, []), (460, [1.0, 2.0]), (470, [-3.0, 0.5]), (480, [0.1])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, q int").repartition(3)
    got = vector_topk.top_k(vectors, lambda c: c % 10 == 0, k=5, step=5, block_rows=40, block_queries=8)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)
    assert vector_topk.top_k(vectors.limit(0), lambda c: c % 10 == 0).count() == 0


def test_top_k_with_components_beyond_doubles(spark):
    rows = [(i, [5e5 * (i + 1), 3.0 - i, 0.25]) for i in range(12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vector_topk.top_k(vectors, lambda c: c % 4 == 0, k=3).collect()))
    assert got == brute_top(rows, 4, 3)
    huge = spark.createDataFrame([(0, [1e300]), (1, [2e300]), (2, [-1.0])], "vec_id long, embedding array<double>")
    found = vector_topk.top_k(huge, lambda c: c == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_hash_filter_has_no_misses(spark):
    ids = spark.range(5000).select((F.col("id") * 3).alias("doc_id"))
    rows = spark.range(15000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert without_ids(rows, ids).count() == 10000


def covering(words, terms, reach):
    """Shortest stretches that have all terms, each as often, by trying all."""
    need = Counter(terms)
    has = [(a, b) for a in range(len(words)) for b in range(a, min(len(words), a + reach + 1)) if not need - Counter(words[a : b + 1])]
    return [(a, b) for a, b in has if not any((c, d) != (a, b) and a <= c and d <= b for c, d in has)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcx"), max_size=30), st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(1, 4))
def test_proximity_equals_brute_force(words, terms, slack):
    windows = decontaminate.Windows(["i"], [" ".join(terms)], n=len(terms))
    at = {t: np.flatnonzero(np.array(words) == t) for t in set(words)}
    code = dict(zip([int(t) for t in decontaminate._terms(decontaminate.split_words(pa.array(["a b c x"]), decontaminate.ALNUM_WORDS))], "abcx"))
    lists = {k: at[code[int(t)]] for k, t in enumerate(windows.terms) if code[int(t)] in at}
    got = [(a, b) for _, a, b in decontaminate.intersect(windows, lists, slack)]
    assert got == covering(words, terms, len(terms) - 1 + slack)


def test_proximity_looks_beyond_the_nearest_position(spark):
    docs = spark.createDataFrame([(1, "b x x a x x c b"), (2, "a b c"), (3, "a x x x b c")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "a b c")], "item_id string, text string")
    got = {r.doc_id: [(s["first"], s["last"]) for s in r.spans] for r in decontaminate.contamination(docs, items, n=3, slack=2).collect()}
    assert got == {1: [(3, 7)], 2: [(0, 2)], 3: []}
