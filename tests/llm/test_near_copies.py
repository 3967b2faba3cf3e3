"""Groups of near copies in the similarity join."""

import itertools
import random

from panelcraft.llm import ngram_join
from panelcraft.session import materialise


def test_a_group_of_near_copies_grows_together_before_its_pairs_are_listed(spark, monkeypatch):
    """Texts that seldom reach the similarity with each other or a common one, but hang together."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    places = range(4, 116, 5)

    def changed(edits):
        words = list(base)
        for at in rng.sample(places, edits):
            words[at] = f"x{rng.randrange(4)}"
        return " ".join(words)

    # the first hang together by a common text, the others only by those that share a change with them
    texts = [" ".join(base), *(changed(1) for _ in range(300)), *(changed(3) for _ in range(300))]
    sizes = {}

    def count(df, name="stage", **options):
        out = materialise(df, name, **options)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", count)
    monkeypatch.setattr(ngram_join, "FEW", 0, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, n=4, percent=87).collect()}

    sets = [frozenset(tuple(t.split()[i : i + 4]) for i in range(117)) for t in texts]
    component = list(range(len(sets)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 87 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            component[b] = a
    assert found == {i: root(i) for i in range(len(sets))}
    assert sum(sizes["pairs"] + sizes.get("drawn", [])) < 2500


def test_short_sets_are_compared_whole_and_long_ones_in_fragments(spark, monkeypatch):
    """Near copies around the size from which sets are cut: the two sides of a pair must be cut alike."""
    rng = random.Random(3)
    size, percent = 200, 85
    monkeypatch.setattr(ngram_join, "WHOLE", size, raising=False)
    texts = []
    for group, n in enumerate((30, size - 20, size - 1, size, size + 25, size * 2)):
        base = [f"g{group}w{i}" for i in range(n)]
        texts += [" ".join(base[: n - cut]) for cut in range(0, n // 5, max(1, n // 40))]
        texts += [" ".join(w if i != at else "x" for i, w in enumerate(base)) for at in rng.sample(range(n), 3)]
    rows = {}

    def count(df, name="stage", **options):
        out = materialise(df, name, **options)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", count)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.similar_groups(docs, n=1, percent=percent).collect()}

    sets = [frozenset(t.split()) for t in texts]
    component = list(range(len(sets)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            component[b] = a
    assert found == {i: root(i) for i in range(len(sets))}
    cut = sum(len(s) >= size for s in sets)
    assert rows["segments"] <= len(sets) + ngram_join.FRAGMENTS * cut
