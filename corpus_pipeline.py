"""A corpus pipeline of five stages, each calling one operator of ``panelcraft.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``. ``run`` applies them to ``documents``. Decisions are made for
each row: a stage numbers the rows it reads, so null and repeated ids count as
rows of their own.

A stage's result reads tables that the stage wrote to the checkpoint folder. The
next stage deletes them, unless its ``docs`` is not a table read from files or is one
of them: consume a stage's result before calling another stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcraft.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from panelcraft.llm._id_filter import without_ids
from panelcraft.llm.queries import MIX_BLOCK, MIX_PERIOD, SHARD_BYTES, held_out
from panelcraft.session import materialise, materialised, release_tables


#: folders that the stage called last has written
_LEFT: list[str] = []


def _plain_table(docs: DataFrame) -> bool:
    return docs._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"


def _stage(function):
    """The function, which also frees what the stage before it has left in the checkpoint folder."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _plain_table(docs):
            roots = docs._jdf.queryExecution().optimizedPlan().relation().location().rootPaths().mkString("\n")
            release_tables(spark, [p for p in _LEFT if p not in roots])
            _LEFT.clear()
        before = set(materialised())
        out = function(spark, docs, sf_dir)
        _LEFT.extend(p for p in materialised() if p not in before)
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, usable=lambda doc_id: ~held_out(doc_id))
    return toxicity.harmless(docs, model, threshold=0.3)


def _unused(name: str, docs: DataFrame) -> str:
    """The name, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, the same each time they are read, and that column's name.

    Rows read from files come in the same partitions and order each time; all others are written first.
    """
    if not _plain_table(docs):
        docs = materialise(docs, "pipeline-input")
    row = _unused("__row", docs)
    return docs.withColumn(row, F.monotonically_increasing_id()), row


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over 5-word shingles, one row: of the smallest id, null ids last."""
    rows, number = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().cast("int").alias("unnamed"), F.col("doc_id").alias("id"), F.col(number).alias("row"))
    groups = ngram_join.similar_groups(rows.select(key.alias("doc_id"), "text"), n=5, percent=80)
    copies = groups.where(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias(number))
    return without_ids(rows, copies, number).drop(number)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a 10-word window of a benchmark item."""
    rows, number = _numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(rows, items, n=10, id_col=number)
    return without_ids(rows, found.where("n_hit > 0"), number).drop(number)


def _positions(rows: DataFrame, number: str) -> DataFrame:
    """Each row's place in the mixture: its number, ``position``, ``slot``, ``in_ratio``."""
    slim = rows.select(F.col(number).alias("row_number"), "doc_id", "source")
    mixed = mixing.mix(slim, mixing.temperature_weights(slim, MIX_PERIOD), block_rows=MIX_BLOCK, row_col="row_number")
    return mixed.select("row_number", "position", "slot", "in_ratio")


@_stage
def interleave_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture."""
    rows, number = _numbered(docs)
    place = _unused("__position", rows)
    placed = materialise(_positions(rows, number), "positions").select(F.col("row_number").alias(number), F.col("position").alias(place))
    return rows.join(placed, number).orderBy(place).select(*docs.columns)


@_stage
def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard, and its place in the mixture as the reading order within the shard.

    Parquet files keep no order that a later reader could rely on, so the
    place is worked out again from the same schedule. ``in_ratio`` tells the rows
    before the first ``slot`` that isn't full, up to which the weights of the mixture hold.
    ``text_hash`` (of the whole text) tells rows of one id, or without one, apart.
    """
    rows, number = _numbered(docs)
    # two plans of half the size, each written once: less to plan and compile at a time in the driver
    placed = materialise(_positions(rows, number), "positions")
    own = F.struct(F.col(number).alias("row_number"), F.xxhash64("text").alias("text_hash"))
    parts = sharding.shards(rows.select("doc_id", "text", own.alias("own")), max_bytes=SHARD_BYTES, row_col="own")
    parts = materialise(parts.select("own.*", "doc_id", "n_bytes", "depth", "shard", "page"), "shards")
    return parts.join(placed, "row_number").select(
        "doc_id", "n_bytes", "depth", "shard", "page", "position", "slot", "in_ratio", "text_hash"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mixing", interleave_sources),
    ("sharding", assign_shards),
]

#: learned scores and positional matching are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
