"""Large tables against many ids: a bit filter of a fixed size goes to every task first.

The ids are hashed into ``FILTER_BITS`` bits. A row whose bit is not set has
none of the ids for certain; only the others, the rows wanted and a few more,
are then joined with the ids exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcraft.llm._ship import ship_package

#: one eighth of this in bytes reaches the driver and every task, however many ids there are
FILTER_BITS = 1 << 25


def place(id_col: str | Column) -> Column:
    """The bit of an id; null for a null id."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(FILTER_BITS).cast("long")))


def bit_filter(ids: DataFrame, id_col: str) -> np.ndarray:
    """The bits of all non-null ids, as 64-bit words."""
    at = ids.select(place(id_col).alias("at")).where("at is not null")
    words = at.select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")
    )
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def held(bits: np.ndarray, at: pa.Array) -> np.ndarray:
    """Whether each place's bit is set; a null place has none."""
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    at = pc.fill_null(at, 0).to_numpy()
    return known & ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids`` (a column of that name); rows with a null id stay.

    Only rows that may go are shuffled; all others pass straight through.
    """
    ship_package(rows.sparkSession)
    ids = ids.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(ids, "__id"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(held(bits.value, batch.column(n)))], names=[*batch.schema.names[:n], "__maybe"]
            )

    names = [f"__c{k}" for k in range(len(rows.columns))]
    at = names[rows.columns.index(id_col)]
    plain = rows.toDF(*names)
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema))
    marked = plain.withColumn("__at", place(at)).mapInArrow(mark, f"{fields}, __maybe boolean")
    sure = marked.where("not __maybe").select(*names)
    checked = marked.where("__maybe").select(*names).join(ids, F.col(at) == F.col("__id"), "left_anti")
    return sure.unionByName(checked).toDF(*rows.columns)
