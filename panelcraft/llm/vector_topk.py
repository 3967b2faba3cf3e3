"""Exact top-k inner products by branch and bound over a vertical layout.

Vectors are cut into candidate blocks and query blocks of bounded size; every
pair of blocks is one bounded group. In a group the candidates lie dimension
block by dimension block. Partial inner products are accumulated block after
block; by Cauchy-Schwarz the dimensions still to come add at most the product
of the remaining norms, so a candidate whose upper bound is below the k-th best
lower bound is dropped and the survivors are compacted. Blocks report their
best k per query and a window keeps the best k of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.llm._ship import ship_package

INT64 = np.iinfo(np.int64)
EXACT = 2.0**52  # integers up to here are exact in a double


def floor_double(c):
    """Floor of a double as a double: SQL's ``floor`` gives a long, which large values overflow."""
    near = F.rint(c)
    return F.when(near > c, near - 1.0).otherwise(near)


def best_in_block(
    queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, ids: np.ndarray, layout: list[np.ndarray], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query: positions of its best ``k`` candidates in the block, and their scores.

    ``layout``: the candidates' components, one array (candidates x step) for
    each dimension block. A query's own row is no candidate; equal scores go to
    the smaller id.
    """
    cuts = np.cumsum([0, *(part.shape[1] for part in layout)])
    left = lambda x: np.sqrt(np.cumsum([np.square(p).sum(axis=1) for p in [*x, np.zeros((len(x[0]), 1))]][::-1], axis=0)[::-1])
    split = [queries[:, a:b] for a, b in zip(cuts, cuts[1:])]
    left_c, left_q = left(layout), left(split)
    first = split[0] @ layout[0].T
    found = []
    for i, row in enumerate(query_rows):
        alive = np.flatnonzero(rows != row)
        score = first[i, alive]
        for step in range(1, len(layout) + 1):
            if len(alive) > k:
                slack = left_q[step, i] * left_c[step, alive] * (1 + 1e-9)
                floor = np.partition(score - slack, -k)[-k]
                kept = score + slack >= floor
                alive, score = alive[kept], score[kept]
            if step < len(layout):
                score = score + layout[step][alive] @ split[step][i]
        top = np.lexsort((ids[alive], -score))[:k]
        found.append((alive[top], score[top]))
    return found


def best_exactly(queries, query_rows, rows, ids, candidates, k):
    """The same in Python's integers, for components too large for doubles."""
    found = []
    ints = [[int(x) for x in c] for c in candidates]
    for q, row in zip(queries, query_rows):
        q = [int(x) for x in q]
        scored = [(-sum(a * b for a, b in zip(q, c)), i, at) for at, (c, i) in enumerate(zip(ints, ids)) if rows[at] != row]
        top = sorted(scored)[:k]
        found.append((np.array([t[2] for t in top], np.int64), [min(max(-t[0], INT64.min), INT64.max) for t in top]))
    return found


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    scale: float = 256.0,
    step: int = 16,
    block_rows: int = 1024,
    block_queries: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every query row.

    Components become ``floor(scale * x)`` in double precision; the score is
    the integer inner product (held within 64 bits). ``is_query``: a condition
    on the id column. Candidates are all rows but the query's own row, so of
    repeated rows each is a query by itself and a candidate of the others.
    Vectors that are null or hold null or non-finite components, and rows with
    a null id, take no part; only vectors of one length are compared (empty
    ones score 0). Ties go to the smaller id. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    x = F.col("v")
    usable = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(
        F.col("id").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )
    usable = usable.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.transform("v", lambda c: floor_double(c * F.lit(scale))).alias("v"),
        F.size("v").alias("dim"),
    )
    queries = usable.where(is_query(F.col("id")))
    n_c = max(1, -(-usable.count() // block_rows))
    n_q = max(1, -(-queries.count() // block_queries))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n).cast("long"))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = usable.withColumn("c", block(n_c)).withColumn("q", others(n_q))
    right = queries.withColumn("q", block(n_q)).withColumn("c", others(n_c))

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if c.num_rows and q.num_rows:
            dim = q["dim"][0].as_py()
            unpack = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)
            cv, qv = unpack(c), unpack(q)
            ids, rows, query_rows = (t[n].to_numpy() for t, n in ((c, "id"), (c, "row"), (q, "row")))
            if dim and float(np.abs(cv).max()) * float(np.abs(qv).max()) * dim < EXACT:
                layout = [np.ascontiguousarray(cv[:, a : a + step]) for a in range(0, dim, step)]
                best = best_in_block(qv, query_rows, rows, ids, layout, k)
            else:
                best = best_exactly(qv, query_rows, rows, ids, cv, k)
            for query, row, (at, score) in zip(q["id"].to_pylist(), query_rows.tolist(), best):
                out["query_row"] += [row] * len(at)
                out["query_id"] += [query] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += [int(s) for s in score]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = (
        left.groupBy("c", "q", "dim")
        .cogroup(right.groupBy("c", "q", "dim"))
        .applyInArrow(run, "query_row long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
