"""Plan-shape and skew tests: the properties the 100 TB design relies on."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from panelcraft.operators import interval as iv
from panelcraft.operators import spine as sp
from panelcraft.operators.monthly import monthly_panel
from panelcraft.operators.rollup import first_row
from tests.conftest import rows

SMOKE = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_shape(spark):
    plan = _plan(E.queries()["quarterly_panel"](spark, SMOKE))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # join inputs (by order key) + facts by (id, month) + aggregated rows by id; nothing after
    assert len(shuffles) == 4, shuffles
    assert sum("_id" in s and "_m" in s for s in shuffles) == 1
    assert sum("_id" in s and "_m" not in s for s in shuffles) == 1
    assert "SinglePartition" not in plan
    assert "partial_sum" in plan  # map-side combine before the (id, month) shuffle
    # scans read only the needed columns
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp" in plan


def test_no_broadcast_of_unbounded_fact_join(spark):
    plan = _plan(E.queries()["interval_monthly_sum"](spark, SMOKE))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_hot_id_monthly_panel(spark):
    """One id holds a third of all facts: the fused plan still equals the brute-force composition."""
    rnd = random.Random(11)
    data = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rnd.randint(1, 200)
        s = dt.date(2019 + rnd.randint(0, 2), rnd.randint(1, 12), rnd.randint(1, 28))
        e = dt.date(2019 + rnd.randint(0, 2), rnd.randint(1, 12), rnd.randint(1, 28))
        data.append((k, s, e, rnd.randint(1, 10**7)))
    facts = spark.createDataFrame(data, "id long, start date, end date, amount long").repartition(6)
    lo, hi = "2019-03-01", "2021-09-01"
    fused = monthly_panel(facts, lo=lo, hi=hi, value="y")
    valid, _ = iv.split_intervals(facts, "start", "end")
    e = iv.expand_months(iv.prorate(valid, "amount")).where(F.col("month").between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))
    m = e.groupBy("id", "month").agg(F.sum("rate").alias("y"))
    brute = sp.attach(sp.calendar_spine(sp.distinct_ids(facts, "id"), "id", lo, hi), m, ["id", "month"])
    assert rows(fused, "id", "month", "y") == rows(brute, "id", "month", "y")


def test_hot_key_first_row(spark):
    data = [(0 if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, o long").repartition(5)
    got = {r.k: r.o for r in first_row(df, ["k"], ["o"]).collect()}
    assert got[0] == 0 and len(got) == 2001


def test_release_materialised(spark):
    import os

    from panelcraft.session import materialise
    from panelcraft.session import release_materialised

    m = materialise(spark.range(100), "release-test")
    assert m.count() == 100
    path = m.inputFiles()[0].split("release-test")[0]
    assert release_materialised(spark) >= 1
    left = [d for d in os.listdir(path.replace("file:", "")) if d.startswith("release-test")]
    assert left == []
