"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcraft.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, ratio):
    form, rows = {}, {}
    for w, n in words.items():
        around = sorted((-m, x) for x, m in words.items() if near(w, x))
        best = around[0] if around and -around[0][0] >= ratio * n else None
        form[w] = best and best[1]
        rows[w] = (n, len(around), best and -best[0])
    out = []
    for w, (n, n_near, form_n) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near, form_n))
    return sorted(out)


def counted(docs, min_length, damage_every):
    total = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage_every and h % damage_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                total[run] += 1
    return dict(total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abéÀ", min_size=1, max_size=6), min_size=1, max_size=30, unique=True))
def test_probe_finds_every_near_word(words):
    hashes = dict(zip(words, spelling.word_hashes(words).tolist()))
    full = {k: np.array([~np.uint64(0)]) for k in range(spelling.LONG + 1)}  # passes all
    found = set()
    for at, characters in spelling._by_length(words):
        for row, edits in spelling.probe(characters, np.array(sorted(map(ord, "abéÀ")), np.uint32), full):
            found |= {(words[at[r]], e) for r, e in zip(row.tolist(), edits.tolist())}
    for a in words:
        for b in words:
            if near(a, b):
                assert (a, hashes[b]) in found or (b, hashes[a]) in found


@pytest.mark.parametrize("bits", [16, 1])
def test_variants_equal_brute_force(spark, monkeypatch, bits):
    """Also with filters so small that nearly every edit passes: results stay the same."""
    monkeypatch.setattr(spelling, "BITS_A_WORD", bits)
    rnd = random.Random(bits)
    words = {}
    for length in (1, 2, 3, 7, 7, 9, 9, 60):
        for _ in range(12):
            w = "".join(rnd.choices("abñ", k=length))
            words[w] = rnd.choice([2, 3, 20, 30, 200, 300, 3000])
            k = rnd.randrange(length)
            words.setdefault(w[:k] + rnd.choice("abc") + w[k + 1 :], rnd.choice([2, 25, 2000]))
            words.setdefault(w[:k] + "a" + w[k:], 2)
    table = spark.createDataFrame([(n, w, 5) for w, n in words.items()], "n long, word string, hash int")
    got = spelling.variants(table, ratio=10).collect()
    assert sorted(tuple(r) for r in got) == brute(words, 10)


@pytest.mark.parametrize("damage_every", [None, 3])
def test_groups_equal_brute_force(spark, edge_docs, damage_every):
    rnd = random.Random(8)
    stems = ["Beispiel", "example", "exÆmple×÷", "garçons", "Überzeugung", "x" * 70]
    more = []
    for k in range(200):
        chosen = [w if rnd.random() < 0.8 else w[:3] + rnd.choice("aeÉ") + w[4:] for w in rnd.choices(stems, k=6)]
        more.append((20 + k % 150, "; ".join(chosen) + "Ń×"))
    docs = edge_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    plain = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = {w: n for w, n in counted(plain, 4, damage_every).items() if n >= 2}
    got = spelling.spelling_groups(docs, min_length=4, min_count=2, ratio=3, damage_every=damage_every).collect()
    assert sorted(tuple(r) for r in got) == brute(words, 3)


def test_long_paths_end_at_their_root(spark):
    """aaaa <- aaab <- aabb ..., each ten times as frequent as the one before."""
    path = ["a" * (9 - k) + "b" * k for k in range(10)]
    table = spark.createDataFrame([(w, 10 ** (k + 1)) for k, w in enumerate(path)], "word string, n long")
    got = {r.word: r.root for r in spelling.variants(table).collect()}
    assert got == dict.fromkeys(path, path[-1])


def test_no_words(spark, no_docs):
    found = spelling.spelling_groups(no_docs)
    assert found.count() == 0 and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_filters_keep_their_limit(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BYTES", 1 << 12)
    words = spark.range(20_000).selectExpr("concat('w', id) as word", "2L as n")
    made = spelling.filters(spelling._hashed(words))
    assert sum(b.nbytes for b in made.values()) <= 1 << 12 and all(b.any() for b in made.values())
