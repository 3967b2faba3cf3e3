"""M3, M6 with E6: ridge regression and its cross-validation from sufficient statistics.

Row count, sums and products of whole-number (fixed-point) columns are added up
exactly, per fold, in one scan with one small row per fold as its result. Every
model follows from them: a fold's model from the sums of all other folds,
its error on the fold from the fold's own sums. No row is read again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Rows, sums and products of columns, as exact integers; the label is the last column."""

    n: int
    s: np.ndarray
    q: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.q + other.q)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.s - other.s, self.q - other.q)

    def centred(self) -> np.ndarray:
        """``n`` times the sums of products about the means: exact until its one rounding to double."""
        return (self.n * self.q - np.outer(self.s, self.s)).astype(np.float64)


@dataclass
class Ridge:
    features: list[str]
    mean: list[float]
    scale: list[float]  # sample standard deviation; 0: a constant column, which is left out
    coefficients: list[float]  # of the scaled features
    intercept: float

    def weights(self) -> np.ndarray:
        """Of the unscaled features."""
        return np.array([c / s if s else 0.0 for c, s in zip(self.coefficients, self.scale)])

    def prediction(self) -> Column:
        """Null where a feature is null."""
        out = F.lit(self.intercept)
        for f, m, s, c in zip(self.features, self.mean, self.scale, self.coefficients):
            x = F.col(f"`{f}`").cast("double")
            out = out + ((x - F.lit(m)) / F.lit(s) * F.lit(c) if s else x * F.lit(0.0))
        return out


def moments_table(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """``n``, ``s0..`` and ``q0_0..`` (upper half) of the rows without a null, one row per group.

    The products are columns of the plan, half of the square of the columns' number: meant for some dozens.
    """
    x = [F.col(f"`{c}`").cast("decimal(19,0)") for c in columns]
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return whole.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(a).alias(f"s{i}") for i, a in enumerate(x)),
        *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(len(x)) for j in range(i, len(x))),
    )


def fold_moments(df: DataFrame, columns: list[str], by: str | None = None) -> dict[object, Moments]:
    """Moments by fold (key None without folds); ``columns`` end with the label."""
    k = len(columns)
    out = {}
    for r in moments_table(df, columns, [by] if by else []).collect():  # a row for each fold
        s = np.array([int(r[f"s{i}"] or 0) for i in range(k)], object)
        q = np.empty((k, k), object)
        for i in range(k):
            for j in range(i, k):
                q[i, j] = q[j, i] = int(r[f"q{i}_{j}"] or 0)
        out[r[by] if by else None] = Moments(r["n"], s, q)
    return out


def solve_ridge(m: Moments, features: list[str], alpha: float = 0.01) -> Ridge:
    """Minimum of ``sum((y - b - z w)^2) / 2n + alpha |w|^2 / 2`` over standard-scaled features ``z``.

    With fewer than two rows all coefficients are 0.
    """
    p = len(features)
    if m.n < 2:
        mean = [float(x) / m.n if m.n else 0.0 for x in m.s]
        return Ridge(features, mean[:p], [0.0] * p, [0.0] * p, mean[p])
    c = m.centred()
    root = np.sqrt(np.diag(c)[:p])
    used = np.flatnonzero(root > 0)
    scale = root / math.sqrt(float(m.n) * float(m.n - 1))
    a = c[np.ix_(used, used)] / (root[used, None] * root[None, used]) * (float(m.n - 1) / float(m.n)) + alpha * np.eye(len(used))
    b = c[used, p] / (float(m.n) * float(m.n)) / scale[used]
    coefficients = np.zeros(p)
    coefficients[used] = np.linalg.solve(a, b)
    return Ridge(features, [float(x) / m.n for x in m.s[:p]], scale.tolist(), coefficients.tolist(), float(m.s[p]) / m.n)


def squared_error(m: Moments, model: Ridge) -> float:
    """Sum of squared errors of a model over the rows that ``m`` was made of."""
    if not m.n:
        return 0.0
    w = np.append(-model.weights(), 1.0)  # error = y - w x + constant
    means = np.array([float(x) / m.n for x in m.s])
    bias = float(w @ means) - model.intercept + float(model.weights() @ np.array(model.mean))
    return float(w @ m.centred() @ w) / m.n + m.n * bias * bias


def cross_validate_ridge(folds: dict[object, Moments], features: list[str], alpha: float = 0.01) -> list[tuple[object, int, float]]:
    """``(fold, rows, rmse on the fold of the model of all other folds)``."""
    total = None
    for m in folds.values():
        total = m if total is None else total + m
    out = []
    for fold in sorted(folds):
        model = solve_ridge(total - folds[fold], features, alpha)
        out.append((fold, folds[fold].n, math.sqrt(squared_error(folds[fold], model) / folds[fold].n)))
    return out
