import datetime as dt
import random

from pyspark.sql import functions as F

from panelcraft.operators import interval as iv
from panelcraft.operators.monthly import monthly_panel
from tests.conftest import rows

D = dt.date
SCHEMA = "id long, start date, end date, amount double"


def test_prorate_and_conservation(spark):
    # Jan 100, Feb 100, Mar 150; total preserved
    df = spark.createDataFrame([(1, D(2021, 1, 15), D(2021, 3, 2), 300.0), (1, D(2021, 3, 10), D(2021, 3, 31), 50.0)], SCHEMA)
    valid, bad = iv.split_intervals(df, "start", "end")
    assert bad.count() == 0
    e = iv.expand_months(iv.prorate(valid, "amount"))
    m = iv.monthly_sum(e, ["id", "month"], "rate", "amount")
    assert rows(m) == [(1, D(2021, 1, 1), 100.0), (1, D(2021, 2, 1), 100.0), (1, D(2021, 3, 1), 150.0)]
    t = iv.monthly_totals(df, id_col="id", start="start", end="end", amount="amount", count_out=None)
    assert rows(t) == rows(m)


def test_quarantine(spark):
    # F2 inverted, F3 NULL start
    df = spark.createDataFrame([(2, D(2021, 5, 1), D(2021, 4, 1), 10.0), (3, None, D(2021, 4, 1), 10.0)], SCHEMA)
    valid, bad = iv.split_intervals(df, "start", "end")
    assert valid.count() == 0
    assert rows(bad, "id", "reason") == [(2, "inverted"), (3, "null_start")]
    p = monthly_panel(df, lo="2021-01-01", hi="2021-06-01", value="y")
    # ids exist (spine) but no month is covered
    assert p.count() == 12 and p.where(F.col("y").isNotNull()).count() == 0


def test_delta_form_equals_explode(spark):
    rnd = random.Random(7)
    data = []
    for i in range(400):
        s = D(2018 + rnd.randint(0, 3), rnd.randint(1, 12), rnd.randint(1, 28))
        e = D(2018 + rnd.randint(0, 3), rnd.randint(1, 12), rnd.randint(1, 28))
        data.append((rnd.randint(0, 9), s, e, rnd.randint(1, 10**9)))
    df = spark.createDataFrame(data, "id long, start date, end date, amount long")
    valid, _ = iv.split_intervals(df, "start", "end")
    e = iv.expand_months(iv.prorate(valid, "amount"))
    brute = e.groupBy("id", "month").agg(F.sum("rate").alias("amount"), F.count(F.lit(1)).alias("n_intervals"))
    fast = iv.monthly_totals(df, id_col="id", start="start", end="end", amount="amount")
    assert rows(fast) == rows(brute)
