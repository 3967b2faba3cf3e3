"""Operators on single texts: token counts, toxicity, licences, perplexity."""

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcraft.llm import licenses, perplexity, token_counts, toxicity
from panelcraft.llm._words import ALNUM_WORDS, SPACE_WORDS, split_words, window_hashes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["the ", "don't", "'LL", "Straße", "ﬁ", "İ", "Σς", "é", "é", "漢字", "½", "\x85", "\xa0", "\n", "\x1c", " ", "!!", "42", "<|endoftext|>", "zqxj"]


def texts_of(words, i):
    return words.vocabulary.take(pa.array(words.codes[words.starts[i] : words.starts[i + 1]])).to_pylist()


def test_split_words_matches_plain_python():
    texts = ["A b\tC\x0bd  É ", None, "", "x" * 5, " \n", "a-b_c1É,2"]
    words = split_words(pa.array(texts)[0:], SPACE_WORDS)
    assert texts_of(words, 0) == ["a", "b", "c", "d", "É"]
    assert texts_of(words, 1) == texts_of(words, 2) == texts_of(words, 4) == []
    assert texts_of(split_words(pa.array(texts)[5:], ALNUM_WORDS), 0) == ["a", "b", "c1É", "2"]


def test_window_hashes_are_equal_only_for_equal_windows():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices("abc", k=rnd.randint(0, 9))) for _ in range(200)]
    hashes, cuts = window_hashes(split_words(pa.array(texts), SPACE_WORDS), 4)
    by_window = {}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 4]) for k in range(max(len(w) - 3, min(len(w), 1)))]
        assert cuts[i + 1] - cuts[i] == len(windows)
        for window, h in zip(windows, hashes[cuts[i] : cuts[i + 1]].tolist()):
            assert by_window.setdefault(window, h) == h
    assert len(set(by_window.values())) == len(by_window)


@pytest.mark.parametrize("texts", [["a"], ["a b", None], ["", "c"], []])
def test_window_hashes_of_fewer_words_than_a_window(texts):
    hashes, cuts = window_hashes(split_words(pa.array(texts, pa.string()), SPACE_WORDS), 5)
    assert np.diff(cuts).tolist() == [int(bool(t)) for t in texts] and len(hashes) == cuts[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=8).map("".join), max_size=20))
def test_token_counts_equal_the_library(texts):
    expected = [len(e.ids) for e in token_counts.load(VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(pa.array(texts, pa.string()), VOCABULARY).tolist() == expected


def test_token_counts_edge_cases(spark, edge_docs, no_docs):
    got = token_counts.token_counts(edge_docs, VOCABULARY, limit=10).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    library = token_counts.load(VOCABULARY)
    expected = []
    for r in rows:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected.append((r.doc_id, len(text.encode()), n, n > 10))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert token_counts.token_counts(no_docs, VOCABULARY, limit=10).count() == 0


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best segment, then both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    a = -best[2]
    b = a - best[1]
    left = brute_segments(scores[:a])
    right = [(x + b, y + b) for x, y in brute_segments(scores[b:])]
    return left + [(a, b - 1)] + right


def test_maximal_segments_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        scores = [rnd.choice([-1.0, -1.0, -1.0, 2.5, 1.25]) for _ in range(rnd.randint(0, 14))]
        at = np.array([i for i, s in enumerate(scores) if s > 0], int)
        got = toxicity.maximal_segments(at, np.array([scores[i] for i in at]), 1.0)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)
        assert all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in got)


def test_toxicity_on_held_out_texts(spark):
    rnd = random.Random(3)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rnd.choices(plain, k=rnd.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["slur", "insult", "curse"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), usable=lambda c: c % 4 != 2)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.harmless(docs, model)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert kept.columns == docs.columns


@pytest.mark.parametrize("share", [0.05, 0.12, 0.25, 0.4, 0.5])
def test_toxicity_at_any_share_of_toxic_texts(spark, share):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(2000):
        words = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < share
        if toxic or rnd.random() < 0.002:
            words[rnd.randrange(len(words))] = rnd.choice(["slur", "insult", "curse"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), usable=lambda c: c % 4 != 2)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).where("doc_id % 4 = 2").collect()}
    toxic = [i for i in got if labels[i][1]]
    assert sum(got[i] for i in toxic) >= 0.95 * len(toxic)
    assert sum(got.values()) - sum(got[i] for i in toxic) <= 0.02 * len(got)


def test_toxicity_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, labels)
    got = toxicity.score(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert toxicity.harmless(edge_docs, model).count() == sum(r.predicted == 0 for r in got)
    empty = toxicity.fit(no_docs, labels.limit(0))
    assert empty.words == {} and toxicity.score(no_docs, empty).count() == 0
    assert {r.predicted for r in toxicity.score(edge_docs, empty).collect()} == {0}


def brute_licenses(text):
    import re

    units = [] if text is None else text.split("\n")
    units += [text] if len(units) > 1 else []
    names, best, n = set(), 0, 0
    for unit in units:
        words = re.sub("[^a-z0-9]+", " ", unit.lower()).split()
        grams = set(zip(words, words[1:]))
        scored = []
        for name, template in licenses.TEMPLATES.items():
            own = {tuple(g.split()) for g in licenses.template_bigrams(template)}
            if grams:
                scored.append((2 * len(grams & own) / (len(grams) + len(own)), name))
        if scored and max(scored)[0] >= 0.8:
            dice, name = max(scored)
            n, best = n + 1, max(best, math.floor(dice * 1000))
            names.add(name)
    return len(units), n, ",".join(sorted(names)), best


def test_licenses_equal_brute_force(spark, edge_docs, no_docs):
    texts = [t for pair in licenses.TEMPLATES.values() for t in (pair, f"Intro words here\n{pair.upper()}\nmore", pair.replace("the", "a"))]
    texts += ["Licensed under CC BY 4.0.", "MIT License. " * 40, *(r.text for r in edge_docs.collect())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    assert got == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert licenses.scan(edge_docs).count() == edge_docs.count()
    assert licenses.scan(no_docs).count() == 0


def brute_kneser_ney(texts, n):
    """Log-probability of a byte after its context by the textbook formula."""
    grams = {n: {}}
    for t in texts:
        data = bytes(n - 1) + t.encode()
        for i in range(len(t.encode())):
            g = data[i : i + n]
            grams[n][g] = grams[n].get(g, 0) + 1
    for k in range(n - 1, 0, -1):
        grams[k] = {}
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    cuts = {}
    for k, table in grams.items():
        seen = [max(1, sum(c == x for c in table.values())) for x in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        cuts[k] = [min(max(x - (x + 1) * y * seen[x] / seen[x - 1], 0.01), x - 0.01) for x in (1, 2, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        follow = {x: c for x, c in grams[k].items() if x[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        total = sum(follow.values())
        cut = lambda c: cuts[k][min(c, 3) - 1]
        c = follow.get(g, 0)
        return (max(c - cut(c), 0) / total if c else 0) + sum(map(cut, follow.values())) / total * p(g[1:])

    return p


def test_perplexity_equals_the_textbook_formula(spark, monkeypatch):
    trusted = ["abracadabra abra", "banana band", "cabana", "a", "éa é"]
    texts = trusted + ["abba", "zzz", "", None, "banana banana", "x" * 50]
    docs = spark.createDataFrame(
        [(i, t, i, "en") for i, t in enumerate(texts)], "id long, text string, row long, lang string"
    )
    ids = spark.createDataFrame([(i,) for i in range(len(trusted))], "id long")
    rows = perplexity.model_rows(perplexity.count_grams(docs, ids, 3), 3).cache()
    p = brute_kneser_ney(trusted, 3)
    expected = []
    for t in texts:
        data = bytes(2) + (t or "").encode()
        expected.append(-sum(math.log(p(data[i : i + 3])) for i in range(len(data) - 2)))
    monkeypatch.setattr(perplexity, "CHUNK", 7)
    for size in (perplexity.SHARD_ROWS, 5):  # one shard, or many
        monkeypatch.setattr(perplexity, "SHARD_ROWS", size)
        got = {r["row"]: r["nats"] for r in perplexity.score(docs, rows, 3).collect()}
        assert np.allclose([got[i] for i in range(len(texts))], expected)


def test_perplexity_scores_without_gathering_the_model(spark, monkeypatch):
    trusted = ["the cat and the dog ", "of all the words ", "a b c d e f"]
    texts = trusted + ["the end", "", None, "zq" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2).cache()
    ids = spark.createDataFrame([(i,) for i in range(3)], "id long")
    rows = perplexity.model_rows(perplexity.count_grams(docs.withColumnRenamed("row", "id"), ids, 3), 3).cache()

    def refuse(*_):
        raise AssertionError("gathered in the driver")

    whole = {r["row"]: r["nats"] for r in perplexity.score(docs, rows, 3).collect()}
    with monkeypatch.context() as m:
        m.setattr(type(rows), "toPandas", refuse)
        m.setattr(type(spark.sparkContext), "broadcast", refuse)
        m.setattr(perplexity, "BLOCK", 12)
        split = perplexity.score(docs, rows, 3)
    got = {r["row"]: r["nats"] for r in split.collect()}
    assert sorted(got) == list(range(len(texts)))
    assert np.allclose([got[i] for i in got], [whole[i] for i in got])


def test_perplexity_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, 1) for i in (4, 5, 5, 6, 9, 77)] + [(None, 1), (7, 0), (8, None)], "doc_id long, quality int")
    got = perplexity.quality(edge_docs, labels, n=3).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        assert (r.perplexity is None) == (r.n_bytes == 0)
        assert r.keep is not None and not (r.keep and r.n_bytes == 0)
    nothing = perplexity.quality(edge_docs, labels.limit(0), n=3).collect()
    assert all(r.keep == (r.n_bytes > 0) for r in nothing)
    assert perplexity.quality(no_docs, labels, n=3).count() == 0
