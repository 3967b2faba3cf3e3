import pytest
from pyspark.sql import functions as F

from panelcraft.functions.scalar import parse_amount
from panelcraft.functions.scalar import parse_compact_month
from panelcraft.functions.scalar import parse_row_key
from panelcraft.functions.scalar import row_key
from panelcraft.operators.encode import DictionaryEncoder
from panelcraft.operators.encode import _first_seen
from panelcraft.operators.encode import align_columns
from panelcraft.operators.encode import factorize
from panelcraft.operators.encode import fit_dictionaries
from panelcraft.operators.encode import fit_dictionary
from panelcraft.operators.encode import fit_one_hot
from panelcraft.operators.encode import one_hot
from panelcraft.operators.ordering import global_row_index
from panelcraft.operators.rollup import first_row
from panelcraft.operators.rollup import multi_agg
from panelcraft.operators.rollup import row_bucket_sum
from tests.conftest import rows


def test_mode_tie_smallest(spark):
    # codes 3,1,1,3,2 -> 1
    df = spark.createDataFrame([(1, c) for c in [3, 1, 1, 3, 2]], "k int, c int")
    assert multi_agg(df, ["k"], {"m": ("mode", "c")}).first()["m"] == 1


def test_factorize_first_appearance(spark):
    # 5, NULL, 5, 6 -> 0, 1, 0, 2
    df = spark.createDataFrame([(0, 5), (1, None), (2, 5), (3, 6)], "pos int, v int")
    out = factorize(df, ["v"], ["pos"], suffix="_code")
    assert [r.v_code for r in out.orderBy("pos").collect()] == [0, 1, 0, 2]


def test_dictionary_fit_transform(spark):
    # train a,b; test b,c -> b=1, c=-1; refit: b=0, c=1
    train = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, v string")
    test = spark.createDataFrame([(0, "b"), (1, "c")], "pos int, v string")
    enc = DictionaryEncoder(["v"], ["pos"]).fit(train)
    assert [r.v for r in enc.transform(test).orderBy("pos").collect()] == [1, -1]
    refit = DictionaryEncoder(["v"], ["pos"], refit=True)
    assert [r.v for r in refit.transform(test).orderBy("pos").collect()] == [0, 1]


def test_one_hot_alignment(spark):
    # train a,b; test b,c -> columns v_a, v_b; rows (0,1), (0,0)
    train = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, v string")
    test = spark.createDataFrame([(0, "b"), (1, "c")], "pos int, v string")
    fitted = fit_one_hot(train, ["v"])
    t = one_hot(test, fitted)
    assert t.columns == ["pos", "v_a", "v_b"]
    assert rows(t, "v_a", "v_b") == [(0, 0), (0, 1)]
    assert align_columns(t, ["pos", "v_b", "v_z"]).columns == ["pos", "v_b", "v_z"]
    with pytest.raises(ValueError):
        fit_one_hot(spark.range(30).withColumn("v", F.col("id").cast("string")), ["v"], max_categories=10)


def test_row_key_roundtrip(spark):
    # F12
    df = spark.createDataFrame([(1234567, 2021, 4), (42, 1999, 1)], "id long, year int, quarter int")
    k = df.select(row_key("id", "year", "quarter").alias("sid"))
    assert rows(k) == [("1234567202104",), ("42199901",)]
    back = k.select(*[v.alias(n) for n, v in parse_row_key("sid").items()])
    assert rows(back) == [(42, 1999, 1), (1234567, 2021, 4)]


def test_parse_amount(spark):
    # F13
    vals = ["100万", "100", "abc", "", None, "1.0d", "1_000"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    got = [r.x for r in df.select("i", parse_amount("t").alias("x")).orderBy("i").collect()]
    assert got == [100.0, 100.0, None, None, None, None, None]
    fixed = [r.x for r in df.select("i", parse_amount("t", scale=2).alias("x")).orderBy("i").collect()]
    assert fixed[:2] == [10000, 10000]


def test_compact_month(spark):
    df = spark.createDataFrame([("202103",), ("2021x3",)], "t string")
    got = [r.m for r in df.select(parse_compact_month("t").alias("m")).collect()]
    assert str(got[0]) == "2021-03-01" and got[1] is None


def test_first_row_total_order_and_invariance(spark):
    data = [(k, o, f"v{k}{o}") for k in range(20) for o in (3, 1, 2)]
    df = spark.createDataFrame(data, "k int, o int, v string")
    a = first_row(df, ["k"], ["o"])
    b = first_row(df.repartition(7), ["k"], ["o"])
    assert rows(a) == rows(b) == [(k, 1, f"v{k}1") for k in range(20)]


def test_row_bucket_sum(spark):
    # months 1..6 with values 1..6, n=3 -> 6, 15
    df = spark.createDataFrame([(1, m, float(m)) for m in range(1, 7)], "id int, month int, y double")
    assert rows(row_bucket_sum(df, "id", "month", 3, ["y"]), "y") == [(6.0,), (15.0,)]


def test_global_row_index_contiguous(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000).repartition(9)
    idx = global_row_index(df, ["k"], "i")
    got = sorted((r.k, r.i) for r in idx.collect())
    assert [i for _, i in got] == list(range(5000))


def test_factorize_codes_by_first_appearance(spark):
    data = [(i, None if i % 11 == 0 else f"v{(i * 7) % 13}", i % 5) for i in range(200)]
    df = spark.createDataFrame(data, "pos int, a string, b int").repartition(5)
    codes: tuple[dict, dict] = ({}, {})
    expected = [(i, codes[0].setdefault(a, len(codes[0])), codes[1].setdefault(b, len(codes[1]))) for i, a, b in data]
    assert rows(factorize(df, ["a", "b"], ["pos"], suffix="_c"), "pos", "a_c", "b_c") == expected


def test_dictionary_sorts_few_rows_of_repeated_values(spark):
    rows = [(i * 7919 % 5003 or None, (i * 31 % 7) or None, None if i % 11 == 0 else "äbZ"[i % 3], i % 5 == 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, a int, b string, c boolean")
    df = df.repartition(3, "id")
    assert _first_seen(df, ["a", "b", "c"], ["id", "a", "b", "c"]).count() < 500  # of 20,000
    rank = lambda v: (v is not None, 0 if v is None else v.encode() if isinstance(v, str) else v)
    ordered = sorted(rows, key=lambda r: tuple(map(rank, r)))
    want = {}
    for k, c in enumerate("abc", 1):
        for v in dict.fromkeys(r[k] for r in ordered):
            text = None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
            want[c, text] = sum(1 for of, _ in want if of == c)
    got = fit_dictionaries(df, ["a", "b", "c"], ["id", "a", "b", "c"])
    assert {(r.column, r.value): r.code for r in got.collect()} == want
    nan = spark.createDataFrame([(2, float("nan")), (1, -0.0), (3, 0.0), (4, None)], "id long, x double")
    assert {r.value: r.code for r in fit_dictionary(nan, "x", ["id"]).collect()} == {"-0.0": 0, "NaN": 1, "0.0": 2, None: 3}


def test_dictionary_of_100k_values(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("v"), (F.col("id") * 7919) % n).alias("a"))
    out = factorize(df, ["a"], ["pos"], suffix="_c")
    assert out.where(F.col("a_c") != F.col("pos")).count() == 0 and out.count() == n


def test_one_hot_of_2000_values_has_no_default_cap(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("v"))
    assert len(fit_one_hot(df, ["v"])["v"]) == 2000


def test_one_hot_numeric_and_string_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", 2.5), (3, "a", 4.0)], "k int, s string, x double")
    fitted = fit_one_hot(df, ["k", "s", "x"])
    assert fitted == {"k": [1, 2, 3], "s": ["a", "b"], "x": [2.5, 4.0]}
    out = one_hot(df, fitted).orderBy("k_1", "k_2").collect()
    assert sum(r.x_2_5 if hasattr(r, "x_2_5") else r["x_2.5"] for r in out) == 2
