"""Dictionary codes and one-hot columns, fit on one frame and applied to another.

A fitted dictionary stays a DataFrame (``value``, ``code``) and is applied
with a null-safe equi-join; adaptive execution broadcasts it when its
runtime size is small and keeps a shuffle join otherwise. One-hot columns
need the value list at plan time, so their fit collects the distinct values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import Vectors
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.types import DateType
from pyspark.sql.types import FractionalType
from pyspark.sql.types import IntegralType
from pyspark.sql.types import StringType

from panelcraft.operators.ordering import global_row_index
from panelcraft.session import materialise


def _first_seen(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """``df`` without rows that can't be any value's first: those after another row of their batch, in
    ``order_by`` order, in every one of ``cols``. Floating and nested columns leave ``df`` as it is."""
    needed = list(dict.fromkeys([*cols, *order_by]))
    df = df.select(*needed)
    if not all(isinstance(f.dataType, (IntegralType, StringType, DateType, BooleanType)) for f in df.schema):
        return df
    n, order = len(cols), [(c, "ascending") for c in order_by]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pc.sort_indices(batch, sort_keys=order, null_placement="at_start")
                kept = np.zeros(batch.num_rows, bool)
                for c in batch.columns[:n]:
                    codes = c.take(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    kept[np.unique(codes, return_index=True)[1]] = True
                yield batch.take(at.filter(pa.array(kept)))

    return df.mapInArrow(first, df.schema)


def fit_dictionaries(df: DataFrame, cols: list[str], order_by: list[str]) -> DataFrame:
    """E1 fit for several columns in one pass: (column, value, code).

    code = rank of each value's first appearance in ``order_by`` order,
    counted per column. NULL is a value with its own code (as pandas
    ``unique`` treats NaN). Values are stacked as text and grouped once; the
    distinct values are ranked with one distributed global index, whatever
    their number. Tasks first drop rows whose values have all come before in
    their batch, so that only few are stacked and sorted.
    """
    cols = list(dict.fromkeys(cols))
    stacked = _first_seen(df, cols, order_by).select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        ).alias("__e"),
        F.struct(*order_by).alias("__o"),
    ).select("__e.*", "__o")
    first = stacked.groupBy("column", "value").agg(F.min("__o").alias("__first"))
    ranked = global_row_index(first, ["column", "__first"], "__idx")
    base = ranked.groupBy("column").agg(F.min("__idx").alias("__base"))  # one row per column
    coded = ranked.join(F.broadcast(base), "column").select(
        "column", "value", (F.col("__idx") - F.col("__base")).cast("int").alias("code")
    )
    return materialise(coded, "dictionary")  # its size is known when it is joined, once per column


def fit_dictionary(df: DataFrame, col: str, order_by: list[str]) -> DataFrame:
    """E1 fit for one column: (value, code)."""
    return fit_dictionaries(df, [col], order_by).drop("column")


def apply_dictionary(
    df: DataFrame,
    dictionary: DataFrame,
    col: str,
    out: str | None = None,
    unseen: int = -1,
) -> DataFrame:
    """E2 transform: value -> code, ``unseen`` for values missing from the dictionary.

    ``dictionary`` is (value, code) or (column, value, code); values are text.
    The planner and adaptive execution choose the join by its size.
    """
    out = out or col
    if "column" in dictionary.columns:
        dictionary = dictionary.where(F.col("column") == F.lit(col))
    d = dictionary.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    j = df.join(d, df[col].cast("string").eqNullSafe(d["__v"]), "left")
    code = F.coalesce(F.col("__code"), F.lit(unseen)).cast("int")
    cols = [code.alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(code.alias(out))
    return j.select(*cols)


def factorize(df: DataFrame, cols: list[str], order_by: list[str], suffix: str = "") -> DataFrame:
    """Replace each column by its first-appearance code, fitted on ``df`` itself."""
    cols = list(dict.fromkeys(cols))  # a repeated column is coded once
    dictionary = fit_dictionaries(df, cols, order_by)
    out = df
    for c in cols:
        out = apply_dictionary(out, dictionary, c, c + suffix)
    return out


class DictionaryEncoder:
    """Fit on train, transform any split; ``refit=True`` reproduces per-split coding."""

    def __init__(self, cols: list[str], order_by: list[str], unseen: int = -1, refit: bool = False):
        self.cols, self.order_by, self.unseen, self.refit = list(dict.fromkeys(cols)), order_by, unseen, refit
        self.dictionary: DataFrame | None = None

    def fit(self, df: DataFrame) -> DictionaryEncoder:
        self.dictionary = fit_dictionaries(df, self.cols, self.order_by)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        dictionary = fit_dictionaries(df, self.cols, self.order_by) if self.refit else self.dictionary
        out = df
        for c in self.cols:
            out = apply_dictionary(out, dictionary, c, c, self.unseen)
        return out


def fit_one_hot(df: DataFrame, cols: list[str], max_categories: int | None = None) -> dict[str, list]:
    """E3 fit: sorted distinct non-NULL values per column, all columns in one pass.

    The values become columns of the plan, so they are collected; a caller
    that wants a limit sets ``max_categories``. Wide columns belong in
    :func:`one_hot_positions`, which collects nothing.
    """
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("e")
    ).select("e.c", "e.v").where(F.col("v").isNotNull()).distinct()
    if max_categories is not None:
        wide = stacked.groupBy("c").count().where(F.col("count") > max_categories).first()
        if wide:
            raise ValueError(f"{wide['c']}: more than {max_categories} categories; use vector encoding instead")
    by_col: dict[str, set] = {c: set() for c in cols}
    for r in stacked.collect():
        by_col[r["c"]].add(r["v"])
    return {c: sorted(_from_text(v, df.schema[c].dataType) for v in by_col[c]) for c in cols}


def _from_text(v: str, t):
    """A value's text form (as Spark casts it) back to the column's Python type, for literals."""
    if isinstance(t, IntegralType):
        return int(v)
    if isinstance(t, FractionalType):
        return float(v)
    if isinstance(t, BooleanType):
        return v == "true"
    if isinstance(t, DateType):
        return dt.date.fromisoformat(v)
    return v


def one_hot_name(col: str, value) -> str:
    return f"{col}_{value}"


def one_hot(df: DataFrame, fitted: dict[str, list], keep: bool = False) -> DataFrame:
    """E3 transform + E4 alignment: one 0/1 column per fitted value, in fitted order.

    Values absent from the fit get no column (all zeros), fitted values absent
    from ``df`` still get a column (all zeros): train and test come out aligned.
    """
    new = []
    for c, values in fitted.items():
        for v in values:
            new.append(F.when(F.col(c) == F.lit(v), 1).otherwise(0).cast("int").alias(one_hot_name(c, v)))
    base = [F.col(x) for x in df.columns if keep or x not in fitted]
    return df.select(*base, *new)


def align_columns(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Add missing columns as ``fill``, drop extras, order as ``columns``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def one_hot_positions(df: DataFrame, cols: list[str]) -> DataFrame:
    """E3 fit for wide columns: ``col, value, position`` of every distinct non-NULL value, as a table.

    Positions are numbered from 0 by column and value (as text); nothing is collected.
    """
    cells = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)))
    found = df.select(F.inline(cells)).where("value is not null").distinct()
    return materialise(global_row_index(found, ["at", "value"], "position").select("col", "value", "position"), "positions")


def one_hot_sparse(df: DataFrame, cols: list[str], positions: DataFrame, out: str = "indices") -> DataFrame:
    """E3 transform for wide columns: every row with the ascending positions of its values, whose entries are 1.

    NULL and values that were not fitted have no position. Each column is joined with
    its part of the positions; adaptive execution sends small parts to all tasks and splits hot values.
    """
    for i, c in enumerate(cols):
        part = positions.where(F.col("col") == c).select(F.col("value").alias(f"__v{i}"), F.col("position").alias(f"__p{i}"))
        df = df.join(part, F.col(f"`{c}`").cast("string") == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    places = [f"__p{i}" for i in range(len(cols))]
    return df.withColumn(out, F.array_sort(F.array_compact(F.array(*places)))).drop(*places)


def sparse_vectors(rows: DataFrame, size: int, out: str = "features_onehot") -> DataFrame:
    """The indices as MLlib vectors of ``size`` entries."""
    vector = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    return rows.withColumn(out, vector("indices")).drop("indices")
