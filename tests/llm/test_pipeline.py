"""The pipeline against a brute-force version on a small fixture, and the registered queries."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from panelcraft.llm import mixing, queries
from tests.llm.test_corpus import brute_groups, brute_hits, random_docs
from tests.llm.test_native import brute_shard


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "SHARD_BYTES", 4000)
    texts = random_docs(21, 240)
    rows = []
    for i, t in enumerate(texts):
        toxic = i % 6 == 0
        rows.append((i, t + " vileword awfulword" * (2 * toxic), "en", f"s{i % 3}", len(t)))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(200)]
    items = [(k, " ".join(texts[k * 7 + 1].split()[:30])) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [r for r in rows if "vileword" not in r[1]]
    groups = brute_groups([r[:2] for r in kept], 5, 80)
    kept = [r for r, g in zip(kept, groups) if g[2] == r[0]]
    kept = [r for r in kept if brute_hits(r[1], items, 10)[1] == 0]
    assert 20 < len(kept) < 150
    shard = brute_shard([(r[0], len(r[1].encode())) for r in kept], 4000)
    by_source = {}
    for r in sorted(kept, key=lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r[0])):
        by_source.setdefault(r[3], []).append(r[0])
    roots = {s: int(len(x) ** 0.5 * 1000) for s, x in by_source.items()}
    spare = queries.MIX_PERIOD - len(roots)
    weights = {s: 1 + x * spare // sum(roots.values()) for s, x in roots.items()}
    for s in sorted(roots, key=lambda s: (-(roots[s] * spare % sum(roots.values())), s))[: queries.MIX_PERIOD - sum(weights.values())]:
        weights[s] += 1
    starts = {}
    for t, s in enumerate(mixing.period(weights)):
        starts.setdefault(s, []).append(t)
    position = {}
    for s, ids in by_source.items():
        for rank, i in enumerate(ids):
            block, w = rank // queries.MIX_BLOCK, weights[s]
            slot = block // w * queries.MIX_PERIOD + starts[s][block % w]
            position[i] = slot * queries.MIX_BLOCK + rank % queries.MIX_BLOCK
    expected = {i: (f"{d}/{p}", position[i]) for i, (d, p) in shard.items()}
    got = {r.doc_id: (r.shard, r.position) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected


def test_stages_keep_the_columns_and_survive_edge_cases(spark, tmp_path, edge_docs):
    spark.createDataFrame([(5, 1, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 5


def test_stages_decide_for_each_row(spark, tmp_path):
    text = lambda name: " ".join(f"{name}{k}" for k in range(30))
    leak = text("bench")
    rows = [
        (1, text("a")), (1, text("a")), (None, text("a")),  # copies: one of id 1 stays
        (2, text("b")), (2, leak + " tail"), (None, "head " + leak + " x y z u v w"),  # contaminated rows go, the clean one stays
        (4, text("c")), (3, text("d")), (4, text("d")),  # of the copies of d, id 3 stays; id 4 keeps its own text
        (None, text("e")), (None, text("e")), (None, text("f")), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = [(1, text("a")), (2, text("b")), (4, text("c")), (3, text("d")), (None, text("e")), (None, text("f")), (None, None)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=key) == sorted(expected, key=key)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert all(r.slot == r.position // queries.MIX_BLOCK for r in placed)
    assert {r.in_ratio for r in placed} == {False}  # 7 rows of one source don't fill slot 0
    assert len({r.position for r in placed}) == len(placed) == len(expected)
    assert sorted((str(r.doc_id), r.n_bytes) for r in placed) == sorted((str(i), len(t or "")) for i, t in expected)


def test_columns_with_the_stages_own_names(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, 10, 20, 30), (2, text + " x", 11, 21, 31), (3, "other", None, 22, 32), (None, None, 13, 23, 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, __position long, row_number long").withColumn("source", F.lit("s"))
    spark.createDataFrame([(9, "nothing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, str(tmp_path))
    kept = sorted((str(r.doc_id), str(r["__row"]), r["__position"], r.row_number) for r in docs.collect())
    assert kept == [("1", "10", 20, 30), ("3", "None", 22, 32), ("None", "13", 23, 33)]
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert {r.doc_id: r.text_hash for r in placed.collect()} == hashes


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
