"""Ridge regression from sums against numpy on the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcraft.operators.linear import cross_validate_ridge
from panelcraft.operators.linear import fold_moments
from panelcraft.operators.linear import moments_table
from panelcraft.operators.linear import solve_ridge
from panelcraft.operators.linear import squared_error

COLS = ["a", "b", "c", "y"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-50, 50, 400), rng.integers(0, 10**12, 400)
    y = 30 * a + b // 10**9 + rng.integers(-20, 20, 400)
    rows = [(int(k % 3), int(p), int(q), 7, int(z)) for k, (p, q, z) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame([*rows, (0, None, 1, 7, 1), (1, 1, 1, 7, None)], "fold int, a long, b long, c long, y long")
    path = str(tmp_path_factory.mktemp("linear") / "t")
    df.write.parquet(path)
    return np.array(rows, float), spark.read.parquet(path)


def direct(rows, alpha):
    x, y = rows[:, 1:3], rows[:, 4]
    mean, sd, n = x.mean(0), x.std(0, ddof=1), len(x)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z / n + alpha * np.eye(2), z.T @ (y - y.mean()) / n)
    return lambda r: y.mean() + ((r[:, 1:3] - mean) / sd) @ w


def test_ridge_equals_numpy(spark, data):
    rows, df = data
    m = fold_moments(df, COLS)[None]
    assert m.n == 400  # rows with a null are left out
    model = solve_ridge(m, COLS[:3], 0.5)
    assert model.scale[2] == 0.0 and model.coefficients[2] == 0.0  # constant
    expected = direct(rows, 0.5)(rows)
    got = [r.p for r in df.where("a is not null and y is not null").select(model.prediction().alias("p")).collect()]
    assert np.allclose(sorted(got), sorted(expected), rtol=1e-9)
    assert math.isclose(squared_error(m, model), float(((rows[:, 4] - expected) ** 2).sum()), rel_tol=1e-9)


def test_folds_equal_refits(spark, data):
    rows, df = data
    got = cross_validate_ridge(fold_moments(df, COLS, by="fold"), COLS[:3], 0.01)
    for fold, n, rmse in got:
        own, rest = rows[rows[:, 0] == fold], rows[rows[:, 0] != fold]
        assert n == len(own)
        assert math.isclose(rmse, float(np.sqrt(((own[:, 4] - direct(rest, 0.01)(own)) ** 2).mean())), rel_tol=1e-9)


def test_all_folds_come_from_one_scan(spark, data):
    plan = moments_table(data[1], COLS, ["fold"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_no_rows(spark, data):
    empty = fold_moments(data[1].limit(0), COLS)
    model = solve_ridge(empty[None], COLS[:3])
    assert model.coefficients == [0.0] * 3 and model.intercept == 0.0
    assert fold_moments(data[1].limit(0), COLS, by="fold") == {}
    assert data[1].where(F.col("a").isNull()).select(model.prediction().alias("p")).first().p is None
