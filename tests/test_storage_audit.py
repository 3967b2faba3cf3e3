"""Replaced tables, quarantined lines, keyed blinding, conservation and wide one-hot columns."""

import hashlib
import hmac
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.types import LongType
from pyspark.sql.types import StructField
from pyspark.sql.types import StructType

from panelcraft.operators.audit import Audit
from panelcraft.operators.audit import NotConserved
from panelcraft.operators.encode import one_hot_positions
from panelcraft.operators.encode import one_hot_sparse
from panelcraft.operators.encode import sparse_vectors
from panelcraft.operators.spine import BLINDING_KEY
from panelcraft.operators.spine import blinding_key
from panelcraft.operators.spine import keyed_digest
from panelcraft.operators.spine import keyed_intersection
from panelcraft.operators.spine import prune_by_filter
from panelcraft.plans import q_storage
from panelcraft.session import materialised
from panelcraft.sources.io import drop_versions
from panelcraft.sources.io import read_with_quarantine
from panelcraft.sources.io import replace_table


def test_replaced_table_is_whole_for_every_reader(spark, tmp_path):
    how = dict(bucket_by=["id"], buckets=4)
    first = spark.range(1000).select("id", F.lit(1).alias("v"))
    full = replace_table(first, "t", "swap_db", str(tmp_path / "db"), **how)
    early = spark.table(full)  # a reader that has begun
    replace_table(spark.range(300).select("id", F.lit(2).alias("v")), "t", "swap_db", str(tmp_path / "db"), **how)
    assert {tuple(r) for r in early.groupBy("v").count().collect()} == {(1, 1000)}
    assert {tuple(r) for r in spark.table(full).groupBy("v").count().collect()} == {(2, 300)}
    with pytest.raises(ValueError):
        replace_table(first.withColumn("w", F.lit(1)), "t", "swap_db", str(tmp_path / "db"), **how)
    with pytest.raises(ValueError):
        replace_table(first, "t", "swap_db", str(tmp_path / "db"), bucket_by=["id"], buckets=8)
    assert drop_versions(spark, "t", "swap_db") == 1
    assert spark.table(full).count() == 300


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    for name in ("a", "b"):
        rows = spark.range(2000).select("id", (F.col("id") % 4).alias("quarter"), F.lit(name).alias(name))
        replace_table(rows, name, "bucket_db", str(tmp_path / "db"), bucket_by=["id"], sort_by=["id", "quarter"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = spark.table("bucket_db.a").join(spark.table("bucket_db.b"), ["id", "quarter"])
        assert both.count() == 2000
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_panels_are_computed_once_and_buckets_grow_with_rows(spark, tmp_path, monkeypatch):
    orders = [(k, k % 3 or None, date(1996, 1 + k % 12, 3), 10.0) for k in range(20)]
    lines = [(k, n, date(1996, 1 + (k + n) % 12, 9), 5.0 * n, float(n), 0.05, "A") for k in range(20) for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    columns = "l_orderkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert q_storage.panel_buckets(0) == q_storage.panel_buckets(8_000_000) == 8 and q_storage.panel_buckets(8_000_001) == 9
    monkeypatch.setattr(q_storage, "ROWS_A_BUCKET", 5)
    before = set(materialised())
    both = q_storage.q_bucketed_intersection(spark, str(tmp_path))
    assert sum("/host-panel-" in p for p in materialised() if p not in before) == 1
    host = spark.read.parquet(next(p for p in materialised() if p not in before))
    files = [f.rsplit("_", 1)[1].split(".")[0] for f in both.inputFiles()]
    assert max(map(int, files)) >= 8  # numbered from 0
    assert both.count() == host.count() == 2 * 28
    assert both.agg(F.sum("qty")).first()[0] == host.agg(F.sum("qty")).first()[0]


def test_intersection_leaves_no_former_version(spark, tmp_path, monkeypatch):
    orders = [(k, k % 3, date(1996, 1 + k % 12, 3), 10.0) for k in range(9)]
    lines = [(k, 1, date(1996, 1 + k % 12, 9), 5.0, 1.0, 0.05, "A") for k in range(9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    columns = "l_orderkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    bases, fresh = [], q_storage.scratch_table_dir
    monkeypatch.setattr(q_storage, "scratch_table_dir", lambda *a: bases.append(fresh(*a)) or bases[-1])
    both = q_storage.q_bucketed_intersection(spark, str(tmp_path))
    base = Path(bases[0].removeprefix("file:"))
    assert {t: len(list((base / t).iterdir())) for t in ("host", "guest")} == {"host": 1, "guest": 1}
    assert both.count() == 3 * 28


def test_every_line_is_typed_or_quarantined(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n1,2.5\n2,abc\n3\n4,5.0,6\n5,\nnope,1\n")
    schema = StructType([StructField("id", LongType()), StructField("v", DoubleType())])
    good, bad = read_with_quarantine(spark, str(tmp_path / "x.csv"), schema)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5), (5, None)]
    assert {(r.line, r.reason) for r in bad.collect()} == {
        ("2,abc", "unreadable value"), ("3", "too few fields"), ("4,5.0,6", "too many fields"), ("nope,1", "unreadable value")
    }
    assert all(r.file.endswith("x.csv") for r in bad.collect())


@pytest.mark.parametrize("key", [b"k", b"\x00\xff" * 16, b"long" * 40])
def test_digest_is_hmac_sha256(spark, key):
    got = spark.createDataFrame([("120011",), ("é",), (None,)], "sid string").select("sid", keyed_digest("sid", key).alias("d")).collect()
    for r in got:
        assert r.d is None if r.sid is None else bytes(r.d) == hmac.new(key, r.sid.encode(), hashlib.sha256).digest()


def test_keyed_intersection_prunes_before_the_join(spark):
    left = spark.range(20_000).select(F.col("id").cast("string").alias("sid"), (F.col("id") * 2).alias("y"))
    right = spark.range(0, 20_000, 100).select(F.col("id").cast("string").alias("sid"), F.col("id").alias("p"))
    got = keyed_intersection(left.unionByName(left.limit(1).withColumn("sid", F.lit(None).cast("string"))), right, "sid", b"secret")
    assert got.columns == ["bkey", "y", "p"]
    assert sorted((r.y, r.p) for r in got.collect()) == [(2 * k, k) for k in range(0, 20_000, 100)]
    digests = [f.select(keyed_digest("sid", b"secret").alias("d")) for f in (left, right)]
    assert 200 <= prune_by_filter(digests[0], "d", digests[1], "d").count() < 1000  # of 20,000
    assert keyed_intersection(left, right.limit(0), "sid", b"secret").count() == 0


def test_keyed_intersection_computes_each_digest_once(spark):
    sides = [spark.range(1000).select(F.col("id").cast("string").alias("sid"), F.col("id").alias(c)) for c in ("y", "p")]
    both = keyed_intersection(*sides, "sid", b"secret")
    assert "sha2" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.y, r.p) for r in both.collect()) == [(k, k) for k in range(1000)]


def test_blinding_key_comes_from_the_configuration(spark):
    assert blinding_key(spark) != blinding_key(spark)
    spark.conf.set(BLINDING_KEY, "from outside")
    try:
        assert blinding_key(spark) == b"from outside"
    finally:
        spark.conf.unset(BLINDING_KEY)


def test_audit_counts_in_passing_and_raises(spark):
    audit = Audit()
    rows = audit.watch(spark.range(100), "in", rows=F.count(F.lit(1)), total=F.sum("id"))
    kept = audit.watch(rows.where("id <> 7").groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id").alias("s")), "out", total=F.sum("s"))
    kept.collect()
    assert audit.values("in") == {"rows": 100, "total": 4950}
    with pytest.raises(NotConserved):
        audit.check("total", audit.values("in")["total"], audit.values("out")["total"])
    audit.check("total", 4950 - 7, audit.values("out")["total"])


def test_hundred_thousand_categories(spark):
    df = spark.range(120_000).select((F.col("id") % 100_000).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    positions = one_hot_positions(df, ["a", "b"])
    assert positions.agg(F.count("*"), F.max("position")).first()[:] == (100_001, 100_000)
    at = {r.value: r.position for r in positions.where("col = 'a'").collect()}
    assert at["0"] == 0 and at["1"] == 1 and at["10"] == 2  # in the order of the text
    new = spark.createDataFrame([(10, "x"), (10, "new"), (None, None), (10, "x")], "a long, b string")
    rows = one_hot_sparse(new, ["a", "b"], positions)
    assert sorted(tuple(r.indices) for r in rows.collect()) == [(), (2,), (2, 100_000), (2, 100_000)]
    v = sparse_vectors(rows.where("b = 'x'"), 100_001).first().features_onehot
    assert v.size == 100_001 and v.indices.tolist() == [2, 100_000] and v.values.tolist() == [1.0, 1.0]
