"""Sharding, mixing and URL filters."""

import datetime as dt
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelcraft.llm import mixing, sharding, url_filter


def hash_of(doc_id):
    return int(hashlib.md5(str("" if doc_id is None else doc_id).encode()).hexdigest()[:15], 16)


def brute_shard(rows, limit):
    """Each row's (depth, prefix): split from the root while a prefix is too large and can be split."""
    out = {}

    def split(members, depth):
        hashes = {hash_of(i) for i, _ in members}
        if sum(size for _, size in members) <= limit or len(hashes) == 1:
            for i, _ in members:
                out[i] = (depth, hash_of(i) >> (60 - depth))
            return
        halves = defaultdict(list)
        for m in members:
            halves[hash_of(m[0]) >> (59 - depth)].append(m)
        for half in halves.values():
            split(half, depth + 1)

    if rows:
        split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [40, 300, 10**6])
def test_shards_equal_step_by_step_splitting(spark, limit):
    rnd = random.Random(limit)
    rows = [(i, "x" * (rnd.randint(0, 20) if i % 50 else 500)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.depth, int(r.shard.split("/")[1])) for r in sharding.shards(docs, limit).collect()}
    assert got == brute_shard([(i, len(t)) for i, t in rows], limit)


def test_shards_with_cells_too_large_for_the_first_grid(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINER", 2)
    monkeypatch.setattr(sharding.math, "ceil", lambda x: -4 if x > 0 else 0)  # a grid of one cell
    rows = [(i, "x" * 10) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.depth, int(r.shard.split("/")[1])) for r in sharding.shards(docs, 50).collect()}
    assert got == brute_shard([(i, 10) for i, _ in rows], 50)


def test_repeated_ids_go_to_overflow_pages(spark, edge_docs, no_docs):
    rows = [(1, "x" * 30)] * 20 + [(1, "y" * 90)] * 3 + [(None, "z" * 60)] * 4 + [(k, "w" * 10) for k in range(2, 30)]
    docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, h int, page string").repartition(3)
    got = sharding.shards(docs, 100).collect()
    assert len(got) == len(rows)
    filled = defaultdict(list)
    for r in got:
        filled[r.shard, r.page].append(r.n_bytes)
    assert all(sum(sizes) <= 100 for sizes in filled.values())
    assert len(sharding.shards(edge_docs, 100).collect()) == edge_docs.count()
    assert sharding.shards(no_docs, 100).count() == 0


def test_period_stays_within_one_block_of_the_weights():
    rnd = random.Random(8)
    for _ in range(60):
        weights = {f"s{k}": rnd.randint(1, 40) for k in range(rnd.randint(1, 9))}
        q, given = sum(weights.values()), Counter()
        slots = mixing.period(weights)
        for t, s in enumerate(slots, 1):
            given[s] += 1
            assert all(abs(given[x] * q - w * t) < q for x, w in weights.items())
        assert given == weights
    assert mixing.period({}) == []
    assert set(mixing.period({"a": 3, "b": 0, None: 1})) == {"a", None}


def test_mixture_of_a_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(1000 + i, "unweighted") for i in range(5)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, rank int").repartition(4)
    weights = {"hot": 5, "s0": 2, "s3": 2, "s6": 1, "s1": 1, "s2": 1, "s4": 1, "s5": 1, "absent": 1}
    got = mixing.mix(docs, weights, block_rows=4).collect()
    assert len(got) == len(rows)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    for own in by_source.values():
        assert sorted(r["rank"] for r in own) == list(range(len(own)))
        assert [r.doc_id for r in sorted(own, key=lambda r: r["rank"])] == sorted((r.doc_id for r in own), key=lambda i: (hash_of(i), i))
    slots = mixing.period(weights)
    starts = {}
    for t, s in enumerate(slots):
        starts.setdefault(s, []).append(t)
    for r in got:
        if r.source == "unweighted":
            assert r.slot is None and not r.in_ratio
        else:
            w = weights[r.source]
            assert r.slot == (r.block // w) * len(slots) + starts[r.source][r.block % w]
            assert r.position == r.slot * 4 + r["rank"] % 4
    first_empty = starts["absent"][0]
    assert all(r.in_ratio == (r.slot is not None and r.slot < first_empty) for r in got)


def test_mixing_edge_cases(spark, monkeypatch, edge_docs, no_docs):
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    monkeypatch.setattr(mixing, "LARGE_CELL", 3)  # repeated ids are numbered by input partition
    repeated = edge_docs.unionByName(edge_docs.where("doc_id = 5")).unionByName(edge_docs.where("doc_id = 5")).repartition(3)
    weights = mixing.temperature_weights(repeated, 20)
    assert sum(weights.values()) == 20 and None in weights
    got = mixing.mix(repeated, weights, block_rows=2).collect()
    ranks = defaultdict(list)
    for r in got:
        ranks[r.source].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    assert len({r.position for r in got}) == len(got) == repeated.count()
    assert mixing.temperature_weights(no_docs, 20) == {}
    assert mixing.mix(no_docs, {"a": 2}, block_rows=2).count() == 0
    assert mixing.mix(edge_docs, {}, block_rows=2).where("slot is not null").count() == 0
    more = mixing.temperature_weights(edge_docs, 2)  # more sources than slots: the period grows
    assert sum(more.values()) == 8 and len(more) == 4 and min(more.values()) >= 1


def test_mixing_of_a_thousand_and_one_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 1001) AS source")
    weights = mixing.temperature_weights(docs, 1000)
    assert len(weights) == 1001 and sum(weights.values()) == 3000
    got = mixing.mix(docs, weights, block_rows=1).collect()
    assert len(got) == 3000 and len({r.position for r in got}) == 3000
    slots = mixing.period(weights)
    for r in got[:50]:
        assert slots[r.slot % 3000] == r.source


def brute_verdict(url, day, entries):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    if not m or day is None:
        return None, "keep"
    host = re.sub(r"\.$", "", m[1].lower())
    path = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", url)
    parts = [p for p in (path[1] if path else "").split("/") if p]
    labels = host.split(".")
    patterns = {"/".join([".".join(labels[i:]), *parts[:n]]) for i in range(len(labels)) for n in range(len(parts) + 1)}
    strength = ["remove", "allow", "block"]
    best = None
    for p in patterns:
        held = [(d, strength.index(a.lower())) for q, d, a in entries if q and d and a and q.lower() == p and d <= day and a.lower() in strength]
        if held and max(held)[1] > 0:
            best = max(best or (0,), (len(p), p, strength[max(held)[1]]))
    return (best[1], "block" if best[2] == "block" else "keep") if best else (None, "keep")


def test_url_filters_equal_brute_force(spark):
    rnd = random.Random(6)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(40))
    hosts = ["a.example.com", "B.Example.com", "example.com", "user@x.org:80", "x.org.", "deep.a.b.x.org"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/1', '/en//2?q=/x', '/de#/en', '/en/sub/3'])}" for _ in range(150)]
    urls += [None, "", "not a url", "http://", "/relative/en"]
    captures = [(i if i % 9 else None, u, day() if i % 11 else None) for i, u in enumerate(urls)] * 2
    patterns = ["example.com", "a.example.com", "Example.com/en", "x.org", "x.org/en", "x.org/en/sub", "x.org/en/sub/3", "a.b.x.org", "org"]
    entries = [(rnd.choice(patterns), day(), rnd.choice(["block", "Block", "allow", "remove", "other"])) for _ in range(60)]
    entries += [(None, day(), "block"), ("x.org", None, "block"), ("x.org", day(), None)] + entries[:5]
    got = url_filter.evaluate(
        spark.createDataFrame([(*c, "k") for c in captures], "page_id long, url string, fetched date, pattern string"),
        spark.createDataFrame(entries, "pattern string, day date, action string"),
    )
    key = lambda r: tuple(str(x) for x in r)
    expected = [(i, d, *brute_verdict(u, d, entries)) for i, u, d in captures]
    assert sorted((tuple(r) for r in got.select("page_id", "day", "pattern", "verdict").collect()), key=key) == sorted(expected, key=key)


def test_url_filters_on_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.com/", dt.date(2024, 1, 1))], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("a.com", dt.date(2024, 1, 1), "block")], "pattern string, day date, action string")
    assert [r.verdict for r in url_filter.evaluate(captures, entries).collect()] == ["block"]
    assert [r.verdict for r in url_filter.evaluate(captures, entries.limit(0)).collect()] == ["keep"]
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0
    assert url_filter.intervals(entries).where(F.col("until").isNull()).count() == 1


def test_url_filters_match_paths_of_any_depth(spark):
    urls = ["https://a.com/x/y/z", "https://www.a.com/x/y/z/w?q", "https://a.com/x/y", "https://a.com/x/y/zz", "https://b.com/x/y/z"]
    urls += ["https://a.com/" + "/".join("p" * k for k in range(1, 12)), "https://c.com/" + "d/" * 2000]
    pages = spark.createDataFrame([(k, u, "2024-02-01") for k, u in enumerate(urls)], "page_id int, url string, fetched string")
    listed = [("a.com/x/y/z", "2024-01-01", "block"), ("a.com/p/pp/ppp/pppp/ppppp/pppppp", "2024-01-01", "block"), ("c.com", "2024-01-01", "block")]
    got = {r.page_id: r.verdict for r in url_filter.evaluate(pages, spark.createDataFrame(listed, "pattern string, day string, action string")).collect()}
    assert got == {0: "block", 1: "block", 2: "keep", 3: "keep", 4: "keep", 5: "block", 6: "block"}
    none = url_filter.evaluate(pages, spark.createDataFrame([], "pattern string, day string, action string"))
    assert {r.verdict for r in none.collect()} == {"keep"}
