"""Document quality as perplexity under an interpolated modified Kneser-Ney model.

The n-grams are over UTF-8 bytes, so every key is an exact integer and no text
is out of vocabulary. Trusted texts are counted in full by the tasks that read
them; continuation counts, discounts and context weights are aggregations of
the count table. For scoring, the table is cut into shards of bounded size by
the context's last byte, which all orders of a position share: a shard has
everything its positions need, so the shards are joined with the texts one
after the other and their log-probabilities add up per document. Documents are
kept up to a quantile of the perplexities of trusted documents of their
language that the model hasn't counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.llm._id_filter import bit_filter, held, place
from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import slices
from panelcraft.session import materialise

#: bytes of text worked on at once
CHUNK = 2 << 20
#: bytes of text whose distinct n-grams are looked up together
BLOCK = 16 << 20
#: rows of the model a partition of the first join has on average, at most
SHARD_ROWS = 4_000_000
#: perplexities are compared in steps of a thousandth of a nat
STEP = 1000


def byte_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (with the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def grams_of(data: np.ndarray, starts: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    """The ``n``-gram ending at each of the bytes ``a`` to ``b``; zero bytes stand before each text."""
    into = np.arange(a, b) - starts[np.searchsorted(starts, np.arange(a, b), side="right") - 1]
    out = data[a:b].astype(np.int64)
    for k in range(1, n):
        before = data[np.maximum(np.arange(a, b) - k, 0)].astype(np.int64)
        out |= np.where(into >= k, before, 0) << (8 * k)
    return out


def count_grams(docs: DataFrame, trusted: DataFrame, n: int) -> DataFrame:
    """``gram, times`` over whole trusted texts; ``trusted`` has their ids."""
    ship_package(docs.sparkSession)
    trusted = trusted.select("id").where("id is not null").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(trusted, "id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(held(bits.value, batch.column(2))))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["id", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            data, starts = byte_stream(batch.column(0))
            for a in range(0, len(data), CHUNK):
                new, often = np.unique(grams_of(data, starts, a, min(a + CHUNK, len(data)), n), return_counts=True)
                both, at = np.unique(np.concatenate([found, new]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, often]), len(both)).astype(np.int64)
                found = both
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["gram", "times"])

    id_type = docs.schema["id"].dataType.simpleString()
    maybe = docs.select("id", "text", place("id").alias("at")).mapInArrow(some, f"id {id_type}, text string")
    texts = maybe.join(trusted, "id", "left_semi").select("text")
    return texts.mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))


def model_rows(counts: DataFrame, n: int) -> DataFrame:
    """The model: ``order, gram, alpha, gamma``.

    ``alpha``: the discounted share of the gram in its context; ``gamma``: the
    weight that the context leaves to the lower order, 1 for unseen contexts.
    The highest order has raw counts, the others continuation counts.
    """
    orders = {n: counts.select("gram", F.col("times").alias("c"))}
    for order in range(n - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram")
        orders[order] = orders[order + 1].select(tail).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    parts = []
    for order, table in orders.items():
        row = table.agg(*(F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        seen = [max(1, row[f"n{k}"] or 0) for k in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        d = [min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.01), k - 0.01) for k in (1, 2, 3)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.expr("gram div 256")
        rows = table.select("gram", context.alias("context"), "c", cut.alias("cut"))
        total = rows.groupBy("context").agg(F.sum("c").alias("all"), F.sum("cut").alias("left"))
        parts.append(
            rows.join(total, "context").select(
                F.lit(order).alias("order"),
                "gram",
                ((F.col("c") - F.col("cut")) / F.col("all")).alias("alpha"),
                (F.col("left") / F.col("all")).alias("gamma"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def gram_nats(wanted: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``gram, nat``: negative natural log-probability of each wanted gram's last byte given the bytes before it.

    The orders are joined from the lowest up. A gram or context has one row in
    the model, and a tail at most 256 grams, so no key of a join is large.
    """
    tails = {n: wanted.select("gram")}
    for order in range(n - 1, 0, -1):
        tails[order] = tails[order + 1].select(F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram")).distinct()
    lower = None
    for order in range(1, n + 1):
        own = rows.where(F.col("order") == order)
        alphas = own.select("gram", "alpha")
        gammas = own.groupBy(F.expr("gram div 256").alias("context")).agg(F.max("gamma").alias("gamma"))
        found = tails[order].withColumn("context", F.expr("gram div 256"))
        found = found.join(gammas, "context", "left").join(alphas, "gram", "left")
        below = F.lit(1 / 256)
        if lower is not None:
            found = found.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).join(lower, "tail")
            below = F.col("p_tail")
        p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below
        lower = found.select(F.col("gram").alias("tail"), p.alias("p_tail"))
    return lower.select(F.col("tail").alias("gram"), (-F.log("p_tail")).alias("nat"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of ``row, text`` with their block: rows that follow each other, about ``most`` bytes, named by the first row."""
    block, filled = None, most
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ids = batch.column(0).to_numpy()
        begin = 0
        for i, size in enumerate(sizes.tolist()):
            if filled >= most:
                if i > begin:
                    yield block, batch.slice(begin, i - begin)
                block, begin, filled = int(ids[i]), i, 0
            filled += size
        if len(ids) > begin:
            yield block, batch.slice(begin)


def _block_grams(n: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(found), CHUNK):
                part = found[a : a + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), pa.array(part)], names=["block", "gram"])

        for block, piece in _blocks(batches, most):
            if block != now:
                yield from out()
                now, found = block, np.zeros(0, np.int64)
            data, starts = byte_stream(piece.column(1))
            for a in range(0, len(data), CHUNK):
                found = np.union1d(found, grams_of(data, starts, a, min(a + CHUNK, len(data)), n))
        yield from out()

    return run


def _with_block(most: int):
    """Per piece of a block its rows and texts in one cell, compressed: the shuffle's own codec leaves texts twice as large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for block, whole in _blocks(batches, most):
            for piece in slices([whole], 1):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as writer:
                    writer.write_batch(piece)
                cells = [pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["block", "piece"])

    return run


def _block_scores(n: int):
    def run(texts: pa.Table, nats_of: pa.Table) -> pa.Table:
        nats_of = nats_of.combine_chunks()
        keys, values = nats_of.column("gram").to_numpy(), nats_of.column("nat").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        out = []
        for piece in texts.column("piece"):
            batch = pa.ipc.open_stream(piece.as_buffer()).read_next_batch()
            data, starts = byte_stream(batch.column("text"))
            nats = np.zeros(len(starts) - 1)
            for a in range(0, len(data), CHUNK):
                b = min(a + CHUNK, len(data))
                bits = values[np.searchsorted(keys, grams_of(data, starts, a, b, n))]
                sums = np.concatenate([[0.0], np.cumsum(bits)])
                nats += np.diff(sums[np.clip(starts, a, b) - a])
            out.append(pa.table({"row": batch.column("row"), "nats": nats, "n_bytes": np.diff(starts)}))
        none = {"row": pa.array([], pa.int64()), "nats": pa.array([], pa.float64()), "n_bytes": pa.array([], pa.int64())}
        return pa.concat_tables(out) if out else pa.table(none)

    return run


def score(docs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``row, nats, n_bytes``: each text's negative log-probability.

    Texts are taken in blocks; the distinct grams of a block are joined with
    the model, and return to the block's texts with their log-probabilities.
    Nothing of the model reaches the driver.
    """
    texts = docs.select("row", "text")
    grams = texts.mapInArrow(_block_grams(n, BLOCK), "block long, gram long")
    wanted = materialise(grams.groupBy("gram").agg(F.collect_list("block").alias("blocks")), "wanted")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))
    nats = gram_nats(wanted.select("gram").repartition(shards, "gram"), rows, n)
    back = wanted.join(nats, "gram").select(F.explode("blocks").alias("block"), "gram", "nat")
    blocks = texts.mapInArrow(_with_block(BLOCK), "block long, piece binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_block_scores(n), "row long, nats double, n_bytes long")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    n: int = 5,
    high: float = 0.99,
    low: float | None = None,
    held_out: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """One row per input row: id, ``lang``, ``n_bytes``, ``perplexity`` (per byte), ``keep``.

    Trusted texts: labelled 1 in ``labels`` (any of a repeated id's rows). One
    in ``held_out`` of them, by the hash of the id, is not counted: a model knows
    its own texts too well for them to set a limit. A document is kept if its
    mean negative log-probability, in thousandths of a nat, is at most the
    ``high`` quantile (and at least the ``low`` one, if given) of the trusted texts
    held out in its language; in a language without any (null is a language),
    of all held out; without those all texts are kept. Null and empty texts have
    a null perplexity and are not kept. Repeated rows are scored each. Other
    columns are not read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.monotonically_increasing_id().alias("row"),
    )
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    unseen = F.pmod(F.xxhash64("id"), F.lit(held_out).cast("long")) == 0
    rows = materialise(model_rows(materialise(count_grams(docs, trusted.where(~unseen), n), "grams"), n), "model")
    scored = score(docs, rows, n)
    scored = docs.select("row", "id", "lang").join(scored, "row")
    scored = scored.withColumn("nat", F.when(F.col("n_bytes") > 0, F.col("nats") / F.col("n_bytes")))
    scored = materialise(scored.withColumn("step", F.floor(F.col("nat") * STEP)), "scores")

    # exact quantiles of whole steps: a language has as many rows here as steps
    known = scored.join(trusted.where(unseen), "id", "left_semi").where("step is not null")
    by_lang = known.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("lang"))
    every = by_lang.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))

    def bounds(table: DataFrame) -> DataFrame:
        cut = lambda q: F.min(F.when(F.col("share") >= q, F.col("step")))
        return table.withColumn("share", share).groupBy("lang").agg(cut(low or 0.0).alias("least"), cut(high).alias("most"))

    total = bounds(every).first()
    least, most = (total["least"], total["most"]) if total else (None, None)
    limits = bounds(by_lang).withColumnRenamed("lang", "of")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    inside = F.col("step") <= F.coalesce("most", F.lit(most))
    if low is not None:
        inside &= F.col("step") >= F.coalesce("least", F.lit(least))
    return out.select(
        F.col("id").alias(id_col),
        F.col("lang").alias(lang_col),
        "n_bytes",
        F.exp("nat").alias("perplexity"),
        F.when(F.col("step").isNull(), False).otherwise(F.coalesce(inside, F.lit(True))).alias("keep"),
    )
