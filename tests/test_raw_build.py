"""Raw-export builds on a hand-written micro fixture (FIXTURES.md section 1 layouts)."""

import csv
import os
import tempfile

from panelcraft.plans.raw_build import guest_from_raw
from panelcraft.plans.raw_build import host_from_raw
from panelcraft.sources.raw import RAW_TABLES
from panelcraft.sources.raw import read_raw


def _write(path, kind, rows, extra=("其他",)):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    headers = list(RAW_TABLES[kind]) + list(extra)  # raw files carry extra columns
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(headers)
        for r in rows:
            w.writerow(list(r) + ["x"] * len(extra))


def _fixture():
    base = tempfile.mkdtemp(prefix="pc-raw-")
    g = os.path.join(base, "test", "government_data")
    p = os.path.join(base, "test", "power_data")
    _write(f"{g}/zs_jks.csv", "payments", [(1, "2021-01-15", "2021-03-02", "300"), (1, "2021-03-10", "2021-03-31", "50"),
                                            (2, "2020-05-01", "2020-04-01", "10")])
    _write(f"{g}/sb_xssr.csv", "filings", [(1, "100", "1000", "11", "1", "2021-02-20"), (1, "300", "3000", "21", "5", "2021-02-25")])
    _write(f"{g}/sz_tmp_baseinfo_ent.csv", "register", [
        (1, "A", "B", "2010-06-01", "100万", "I", "1", "D"),
        (1, "Z", "Z", "2011-06-01", "999万", "Z", "2", "Z"),  # duplicate id: the first row wins
        (2, "A", "C", "2012-06-01", "abc", "J", "1", "D"),   # unparseable capital -> mean of parsed rows
    ])
    _write(f"{p}/dlsj_df.csv", "bills", [(1, "202103", "1", "10", "20", "20", "3"), (1, "202103", "1", "5", "10", "8", "3")])
    _write(f"{p}/dlsj_jcxx.csv", "accounts", [(1, "L", "100", "U", "10", "M", "S", "K", "90", "I")])
    return base


def test_guest_and_host_from_raw(spark):
    base = _fixture()
    g = guest_from_raw(spark, base, "test")
    rows = {r.sid: r for r in g.collect()}
    assert len(rows) == 2 * 20  # two payer ids x 20 quarters (2017-2021)
    assert abs(rows["1202101"].y - 350.0) < 1e-9  # F1 proration, Q1 2021
    assert rows["1202101"].capital == 100.0 and rows["2202101"].capital == (100.0 + 999.0) / 2
    # February mean 200; January and March filled with the id mean (200); the quarter sums them
    assert abs(rows["1202101"].month_amount - 600.0) < 1e-9
    assert rows["1202104"].split == "predict"
    h = host_from_raw(spark, base, "test")
    hrows = {r.sid: r for r in h.collect()}
    assert len(hrows) == 12  # one billed id x 12 quarters (2019-2021)
    # price gaps are filled with the id mean (30 a month), net gaps count as 0
    assert abs(hrows["1202101"].price - 90.0) < 1e-9 and abs(hrows["1202101"].net - 28.0) < 1e-9


def test_row_order_is_file_order(spark, tmp_path):
    """A small first file comes before a large second one, though Spark reads large files first."""
    _write(f"{tmp_path}/raw/part-0.csv", "payments", [(0, "2021-01-01", "2021-01-31", "1")])
    _write(f"{tmp_path}/raw/part-1.csv", "payments", [(k, "2021-01-01", "2021-01-31", "1") for k in range(1, 51)])
    got = read_raw(spark, f"{tmp_path}/raw", "payments").orderBy("_row_order").select("id").collect()
    assert [r.id for r in got] == list(range(51))


def test_whole_numbers_keep_all_digits(spark):
    from pyspark.sql import functions as F

    from panelcraft.sources.raw import typed

    texts = ["9007199254740993", " 11.0 ", "11.5", "x", "", None, "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(typed(F.col("t"), "bigint").alias("v")).collect()] == [9007199254740993, 11, 11, None, None, None, None]
