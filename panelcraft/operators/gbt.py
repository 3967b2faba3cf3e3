"""M5 as an estimator: MLlib's squared-loss boosted trees, grown over packed rows.

MLlib keeps every row as objects in memory, several times over; rows that don't fit are written and read again for
each level of each tree. Here the binned rows are written once, some thousands to a row of a table (see
``operators.boost``), and each level is one aggregation over them. The trees are MLlib's: the same candidate
thresholds, variance as impurity, the first tree on the label and the others on twice the error. Residuals are
added up as whole numbers of 2^-50 of their range, so a model doesn't depend on partitions or task order. The
result is an ordinary ``GBTRegressionModel``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.operators import boost
from panelcraft.session import release_tables
from panelcraft.session import written

#: bits of the largest residual as a whole number
RESIDUAL_BITS = 50


@dataclass
class _Tree:
    weight: float
    splits: dict[int, boost._Split]
    values: dict[int, float]  # of the leaves


class PackedGBTRegressor(GBTRegressor):
    """``GBTRegressor`` for ordered features, all rows and squared loss; other settings are left to MLlib."""

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        asked = {"lossType": "squared", "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}
        kinds = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        if (
            any(self.getOrDefault(k) != v for k, v in asked.items())
            or self.isSet("weightCol")
            or self.isSet("validationIndicatorCol")
            or set(kinds) - {"numeric"}
            or self.getMaxBins() > 1 << 14
        ):
            return super()._fit(dataset)
        rows = dataset.select(F.col(self.getLabelCol()).cast("double").alias("y"), vector_to_array(self.getFeaturesCol()).alias("x"))
        thresholds, n = candidate_thresholds(rows, self.getMaxBins(), self.getSeed())
        packed, folder = written(_pack(rows, thresholds), "gbt", **{"parquet.block.size": boost.PACKED_BYTES})
        try:
            trees, stats = _boosted(packed, n, thresholds, self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getMinInstancesPerNode())
        finally:
            release_tables(dataset.sparkSession, [folder])
        model = self._copyValues(self._create_model(_java_model(dataset.sparkSession, self.uid, trees, stats, thresholds)))
        model._transfer_params_to_java()
        return model


def _matrix() -> Callable:
    """A function for the labels and the values by feature of a batch; it raises where MLlib does."""

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y, x = batch.columns
        if y.null_count or np.isnan(y.to_numpy()).any():
            raise ValueError("Labels MUST NOT be Null or NaN")
        values = x.flatten().to_numpy(zero_copy_only=False)
        if x.null_count or not np.isfinite(values).all():
            raise ValueError("Vector values MUST NOT be NaN or Infinity")
        return y.to_numpy(), values.reshape(batch.num_rows, -1).T if batch.num_rows else values.reshape(0, 0)

    return matrix


def _value_counts(rows: DataFrame, most: int | None) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """``(feature -> (values, rows of each), rows)``; a feature with more than ``most`` distinct values has only some of them, more than ``most``."""
    matrix = _matrix()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n = 0
        for batch in batches:
            _, x = matrix(batch)
            n += batch.num_rows
            for f, values in enumerate(x):
                old = held.get(f, (np.empty(0), np.empty(0, np.int64)))
                if most is None or len(old[0]) <= most:
                    v, c = np.unique(values + 0.0, return_counts=True)
                    v, at = np.unique(np.r_[old[0], v], return_inverse=True)
                    held[f] = v, np.bincount(at, np.r_[old[1], c]).astype(np.int64)
        held[-1] = np.zeros(1), np.array([n])
        for f, (v, c) in held.items():
            of = slice(None if most is None else most + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v[of]), f, np.int32)), pa.array(v[of]), pa.array(c[of])], names=["f", "v", "c"])

    found = rows.mapInArrow(count, "f int, v double, c long").groupBy("f", "v").agg(F.sum("c").alias("c"))
    table = found.toArrow()
    f, v, c = (column.to_numpy() for column in table.columns)
    out = {}
    for k in np.unique(f).tolist():
        at = np.flatnonzero(f == k)
        at = at[np.argsort(v[at])]
        out[k] = v[at], c[at]
    _, (n,) = out.pop(-1, (None, [0]))
    return out, int(n)


def candidate_thresholds(rows: DataFrame, max_bins: int, seed: int) -> tuple[list[np.ndarray], int]:
    """``(thresholds of each feature, rows)`` as MLlib finds them.

    Features with no more than ``max_bins`` values have one between any two; others have them at even strides of
    the rows, of about ``max_bins``^2 drawn ones if there are more.
    """
    counts, n = _value_counts(rows, max_bins)
    splits, need = min(max_bins, n) - 1, max(max_bins * max_bins, 10_000)
    if any(len(v) > splits + 1 for v, _ in counts.values()):
        some = rows if n <= need else rows.sample(False, need / n, seed)
        more, drawn = _value_counts(some, None)
    out = []
    for f in range(len(counts)):
        v, c = counts[f]
        if len(v) > splits + 1:
            v, c = more[f]
        middle = v[:-1] + v[1:]
        middle = np.where(np.isfinite(middle), middle / 2.0, v[:-1] / 2.0 + v[1:] / 2.0)
        if len(middle) > splits:
            stride, kept = drawn / (splits + 1), []
            target, before = stride, np.cumsum(c).tolist()
            for i in range(1, len(v)):
                if abs(before[i - 1] - target) < abs(before[i] - target):
                    kept.append(middle[i - 1])
                    target += stride
            middle = np.array(kept)
        out.append(middle)
    return out, n


def _pack(rows: DataFrame, thresholds: list[np.ndarray]) -> DataFrame:
    """Packed rows ``n, y, bins``: a value's bin is the number of thresholds below it."""
    matrix, most = _matrix(), boost.PACKED_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                y, x = matrix(batch.slice(start, most))
                bins = np.stack([np.searchsorted(t, v) for t, v in zip(thresholds, x)]).astype(np.int16)
                cells = [pa.array([len(y)], pa.int32()), pa.array([y.tobytes()], pa.binary()), pa.array([bins.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["n", "y", "bins"])

    return rows.mapInArrow(pack, "n int, y binary, bins binary")


def _residuals(trees: list[_Tree], mean: float) -> Callable:
    """A function for the labels that the next tree is fitted to, less ``mean``, and the bins of packed rows."""
    walk = boost._walker()
    steps = [(boost._routes(t.splits), t.weight, t.values) for t in trees]
    steps = [(route, weight * boost._leaf_values(values, route[0], np.float64)) for route, weight, values in steps]

    def residuals(n: int, y: pa.Buffer, bins: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        y, table = np.frombuffer(y, np.float64), np.frombuffer(bins, np.int16).reshape(-1, n)
        p = np.zeros(n)
        for route, values in steps:
            p += values.take(walk(table, route))
        return (2.0 * (y - p) if steps else y - mean), table

    return residuals


def _whole(residuals: Callable, scale: float) -> Callable:
    """The residuals as whole numbers of ``1 / scale``."""

    def whole(n: int, y: pa.Buffer, bins: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
        r, table = residuals(n, y, bins)
        return np.rint(r * scale).astype(np.int64), table

    return whole


def _squares(rows: DataFrame, residuals: Callable, route: tuple | None) -> list[tuple[int, int, float, float, float, float]]:
    """``(node of the last level, rows, sum, sum of squares, least, largest)`` of the residuals."""
    walk, cells = boost._walker(), boost._cells()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for row in cells(batch):
                r, table = residuals(*row)
                node = walk(table, route) if route else np.ones(len(r), np.int64)
                n, s, q = np.bincount(node), np.bincount(node, r), np.bincount(node, r * r)
                for k in np.flatnonzero(n).tolist():
                    t = total.setdefault(k, [0, 0.0, 0.0, math.inf, -math.inf])
                    t[0], t[1], t[2] = t[0] + int(n[k]), t[1] + float(s[k]), t[2] + float(q[k])
                    if not route:
                        t[3], t[4] = min(t[3], float(r.min())), max(t[4], float(r.max()))
        if total:
            columns = [pa.array([k for k in total], pa.int32()), pa.array([t[0] for t in total.values()], pa.int64())]
            columns += [pa.array([t[i] for t in total.values()], pa.float64()) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "n", "s", "q", "lo", "hi"])

    found = rows.select("n", "y", "bins").mapInArrow(add_up, "k int, n long, s double, q double, lo double, hi double")
    added = found.groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("lo"), F.max("hi"))
    return [tuple(r) for r in added.collect()]  # the leaves of a tree at most


def _boosted(packed: DataFrame, n: int, thresholds: list[np.ndarray], n_trees: int, depth: int, step: float, min_rows: int):
    """The trees, and of each ``node -> (rows, sum, sum of squares)`` of what it was fitted to."""
    sizes = [len(t) + 1 for t in thresholds]
    if not n:
        raise ValueError("no training rows")
    _, _, total, _, lowest, highest = _squares(packed, _residuals([], 0.0), None)[0]
    trees: list[_Tree] = []
    stats: list[dict[int, tuple[int, float, float]]] = []
    mean = total / n
    least = most = 0.0  # bounds of the predictions
    for tree in range(n_trees):
        first = tree == 0
        size = max(highest - mean, mean - lowest) if first else 2.0 * max(highest - least, most - lowest)
        scale = 2.0 ** (RESIDUAL_BITS - math.frexp(size)[1]) if size > 0 else 1.0
        residuals = _residuals(trees, mean)
        splits, values, _ = boost._grow(packed, sizes, depth, 0.0, min_rows, 1.0, _whole(residuals, scale))
        off = mean if first else 0.0
        grown = _Tree(1.0 if first else step, splits, {k: off + v / scale for k, v in values.items()})
        route = boost._routes(splits)
        up = route[0] + 1
        of: dict[int, tuple[int, float, float]] = {}
        last = {k << (up - k.bit_length()): k for k in values}
        for k, c, s, q, *_ in _squares(packed, residuals, route):
            s, q = s + off * c, q + 2 * off * s + off * off * c  # of the label itself
            k = last[k]
            while k:
                a, b, d = of.get(k, (0, 0.0, 0.0))
                of[k] = a + c, b + s, d + q
                k >>= 1
        trees.append(grown)
        stats.append(of)
        least, most = least + grown.weight * min(grown.values.values()), most + grown.weight * max(grown.values.values())
    return trees, stats


def _java_model(spark, uid: str, trees: list[_Tree], stats: list[dict], thresholds: list[np.ndarray]):
    """The trees as MLlib's model."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    tree_classes, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression

    def array(kind, items: list):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    def node(t: _Tree, of: dict, k: int):
        """The node, its prediction and whether it is a leaf; two leaves of one prediction are one."""
        c, s, q = of.get(k, (0, 0.0, 0.0))
        impurity = max(0.0, q / c - (s / c) ** 2) if c else 0.0
        held = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(array(jvm.double, [float(c), s, q]), c)
        split = t.splits.get(k)
        if split is None:
            return tree_classes.LeafNode(t.values[k], impurity, held), t.values[k], True
        (left, a, ends), (right, b, also) = node(t, of, 2 * k), node(t, of, 2 * k + 1)
        if ends and also and a == b:
            return tree_classes.LeafNode(a, impurity, held), a, True
        parts = [of[2 * k], of[2 * k + 1]]
        gain = impurity - sum(p[0] / c * max(0.0, p[2] / p[0] - (p[1] / p[0]) ** 2) for p in parts)
        way = tree_classes.ContinuousSplit(split.feature, float(thresholds[split.feature][split.bin]))
        return tree_classes.InternalNode(s / c, impurity, gain, left, right, way, held), s / c, False

    n = len(thresholds)
    models = [regression.DecisionTreeRegressionModel(node(t, of, 1)[0], n) for t, of in zip(trees, stats)]
    weights = array(jvm.double, [t.weight for t in trees])
    return regression.GBTRegressionModel(uid, array(regression.DecisionTreeRegressionModel, models), weights, n)
