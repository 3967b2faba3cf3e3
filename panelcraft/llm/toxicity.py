"""Toxic passages as maximum-scoring segments of token log-odds.

``fit`` counts words (and, for unseen words, their beginnings) in toxic and
other training texts, turns them into log-odds under an informative Dirichlet
prior, and keeps those that are surely on the toxic side. ``score`` walks every
text once: kept tokens add their log-odds, all others subtract a drift, and the
linear-time all-maximal-segments scan yields the toxic passages. Extreme-value
statistics say how many segments of such a score a harmless text of that
length has by chance; the surplus evidence of all significant segments, with
the training rate as prior odds, gives the probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import ALNUM_WORDS, slices, split_words
from panelcraft.session import materialise

#: beginnings of words (in characters) that stand in for words not kept themselves
PREFIXES = (6, 5, 4)


@dataclass(frozen=True)
class Model:
    """Scores of toxic words and word beginnings; bounded by the training sample."""

    words: dict[str, float]
    prefixes: dict[str, float]
    drift: float
    rate: float  # of toxic texts in the training sample
    decay: float  # lambda of the extreme-value law
    scale: float  # K of the extreme-value law


def training_rows(
    labels: DataFrame, max_docs: int, label_col: str = "toxic", id_col: str = "doc_id", usable=None
) -> DataFrame:
    """At most ``max_docs`` labelled ids (smallest hashes first): ``id, toxic``.

    A repeated id is toxic if any of its rows is; null ids and labels are left out.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    rows = rows.where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    if usable is not None:
        rows = rows.where(usable(F.col("id")))
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(max_docs)


def _features(vocabulary: list[str]) -> list[list[str]]:
    """Per word: the word (" " before it) and its beginnings."""
    return [[" " + w, *(w[:n] for n in PREFIXES if len(w) > n)] for w in vocabulary]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that have a feature."""
    for batch in slices(batches, 0):
        words = split_words(batch.column(0), ALNUM_WORDS)
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        features = _features(words.vocabulary.to_pylist())
        found: dict[str, list[int]] = {}
        for i, (start, end) in enumerate(zip(words.starts, words.starts[1:])):
            for f in {f for code in np.unique(words.codes[start:end]).tolist() for f in features[code]}:
                found.setdefault(f, [0, 0])[not toxic[i]] += 1
        in_toxic, in_other = list(zip(*found.values())) or [[], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(in_toxic, pa.int64()), pa.array(in_other, pa.int64())],
            names=["feature", "in_toxic", "in_other"],
        )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable=None,
    max_docs: int = 20_000,
    prior: float = 1 / 30,
    min_z: float = 2.5,
    min_strength: float = 0.86,
    drift: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on at most ``max_docs`` labelled texts (the bound of all that reaches the driver).

    ``usable``: condition on the id column for rows labels may be taken from.
    The ids, a bounded set, are broadcast, so no text is shuffled. Without a
    toxic or without a harmless text nothing is toxic. Counts are of distinct
    texts with the word, so copies and repeats don't weigh in. ``prior``: weight
    of the mean frequency of both classes, as a share of each class, so a log-odds
    ratio doesn't depend on the classes' sizes. A word of toxic texts only gets about
    ``log(1 + 2 / prior)``; a token is kept with ``min_strength`` of that or more, if
    its ratio under a prior of the pooled frequencies is ``min_z`` standard errors from 0.
    """
    ship_package(docs.sparkSession)
    rows = F.broadcast(training_rows(labels, max_docs, label_col, id_col, usable))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(rows, "id")
    texts = materialise(texts.select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity")
    sample = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n1 = float(sample[1] or 0)
    n0 = sample[0] - n1
    rate = (n1 + 1.0) / (n1 + n0 + 2.0)
    if not n1 or not n0:
        return Model({}, {}, drift, rate, 1.0, 1.0)
    counts = (
        texts.mapInArrow(_count, "feature string, in_toxic long, in_other long")
        .groupBy("feature")
        .agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))
    )
    y1, y0, weight = F.col("in_toxic"), F.col("in_other"), prior * (n1 + n0)
    pooled = F.lit(prior) * (y1 + y0)
    odds = lambda y, n: F.log(y / (F.lit(n) - y))
    surely = odds(y1 + pooled, n1 + weight) - odds(y0 + pooled, n0 + weight)
    mean = (y1 / n1 + y0 / n0) / 2
    smooth = lambda y, n: (y + F.lit(prior * n) * mean)
    delta = odds(smooth(y1, n1), n1 * (1 + prior)) - odds(smooth(y0, n0), n0 * (1 + prior))
    kept = (
        counts.where(F.col("in_toxic") > 1)
        .select(
            "feature",
            delta.alias("delta"),
            (surely / F.sqrt(1 / (y1 + pooled) + 1 / (y0 + pooled))).alias("z"),
            (smooth(y0, n0) / F.lit(n0 * (1 + prior))).alias("background"),
        )
        .where((F.col("z") >= min_z) & (F.col("delta") >= min_strength * math.log(1 + 2 / prior)))
        .collect()
    )
    words = {r.feature[1:]: r.delta for r in kept if r.feature[0] == " "}
    prefixes = {r.feature: r.delta for r in kept if r.feature[0] != " "}
    per_text = max(1.0, texts.select(F.avg(F.size(F.split("text", " ")))).first()[0])
    background = [(r.background / per_text, r.delta) for r in kept if r.feature[0] == " "]
    return Model(words, prefixes, drift, rate, _decay(background, drift), sum(p for p, _ in background) or 1.0)


def _decay(background: list[tuple[float, float]], drift: float) -> float:
    """The positive root of E[exp(decay * score)] = 1 over harmless tokens."""
    rest = 1.0 - sum(p for p, _ in background)
    mean = lambda x: sum(p * math.exp(min(x * s, 500)) for p, s in background) + rest * math.exp(-x * drift) - 1.0
    low, high = 1e-6, 1e-6
    while mean(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def token_scores(vocabulary: list[str], model: Model) -> np.ndarray:
    """Score of each word: its own, else of its longest kept beginning, else minus the drift."""

    def one(word: str) -> float:
        if word in model.words:
            return model.words[word]
        for n in PREFIXES:
            if len(word) > n and word[:n] in model.prefixes:
                return model.prefixes[word[:n]]
        return -model.drift

    return np.fromiter(map(one, vocabulary), np.float64, len(vocabulary))


def maximal_segments(positions: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a sequence that scores ``-drift``
    everywhere but at ``positions`` (ascending; ``scores`` > 0 there). Linear in the positions."""
    stack: list[list[float]] = []  # first, last, cumulative score before, cumulative score after
    total, at = 0.0, 0
    for position, score in zip(positions.tolist(), scores.tolist()):
        total -= drift * (position - at)
        new = [position, position, total, total + score]
        total, at = total + score, position + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in stack]


def probability(segments: list[tuple[int, int, float]], n_words: int, model: Model) -> float:
    """Probability that a text of ``n_words`` words with these segments is toxic.

    A harmless text has K * n * exp(-lambda * S) segments scoring S or more by
    chance; evidence adds up over the segments that have less than one.
    """
    space = math.log(model.scale * max(n_words, 1) + 1.0)
    evidence = sum(max(0.0, model.decay * s - space) for _, _, s in segments)
    logit = math.log(model.rate / (1 - model.rate)) + evidence - (0.0 if segments else 1.0)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def scan(texts: pa.Array, model: Model) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
    """The maximal segments of every text and its probability of being toxic."""
    words = split_words(texts, ALNUM_WORDS)
    per_word = token_scores(words.vocabulary.to_pylist(), model)[words.codes] if len(words.codes) else np.zeros(0)
    hits = np.flatnonzero(per_word > 0)
    cuts = np.searchsorted(hits, words.starts)
    found = []
    for i, start in enumerate(words.starts[:-1]):
        at = hits[cuts[i] : cuts[i + 1]]
        found.append(maximal_segments(at - start, per_word[at], model.drift) if len(at) else [])
    return found, [probability(s, n, model) for s, n in zip(found, words.counts.tolist())]


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``score`` (0 to 1), ``predicted``, ``segments`` (first word, last word, score).

    Words are numbered from 0 within the whole text. Null and empty texts have
    no segments and a low score; repeated rows are scored each. Only the text
    enters the score; other columns are not read.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    segment_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found, p = scan(batch.column(1), model)
            dicts = [[dict(zip(("first", "last", "score"), x)) for x in s] for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(dicts, segment_type)],
                names=["id", "score", "predicted", "segments"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, score double, predicted int, segments array<struct<first:long,last:long,score:double>>"
    )
    return out.withColumnRenamed("id", id_col)


def harmless(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``; nothing is shuffled."""
    ship_package(docs.sparkSession)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield batch.filter(pa.array([x < threshold for x in scan(batch.column(column), model)[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
