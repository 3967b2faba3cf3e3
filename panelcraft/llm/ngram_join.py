"""Exact Jaccard self-join on word n-gram sets by vertical partitioning.

Sets are kept as 64-bit hashes under one global order of all n-grams: frequent
ones (seen repeatedly within batches of texts, all texts counted) last, the
rest by hash. The order serves twice. Its front gives each set's prefix, and
two sets that reach the similarity must share a prefix n-gram; pairs that do,
and that length and position bounds leave over, are candidates. Short sets are then
compared whole; for longer ones the hash range is cut into fragments: each
candidate's overlap is counted fragment by fragment, apart from the others, and the
partial overlaps are summed per pair.

Only links are needed, not all pairs of a group of copies. Equal sets are one
node. Each node is first compared with one leader, the set in whose prefix a
shared n-gram stands first; what links is one component from then on, and only
pairs between different components become candidates. While a component meets
many other nodes in an n-gram, these are compared with some of its nodes, chosen
by hash, before all pairs are listed: a large group of near copies grows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcraft.llm._components import components
from panelcraft.llm._id_filter import bit_filter, held, place
from panelcraft.llm._ship import ship_package
from panelcraft.llm._words import SPACE_WORDS, mix64, slices, split_words, window_hashes
from panelcraft.session import materialise

#: frequent n-grams that are placed last in the order, at most (12 bytes each on the driver and in tasks)
MAX_FREQUENT = 500_000
#: the hash range is cut into so many fragments
FRAGMENTS = 8
#: sets of fewer n-grams are compared whole, as one fragment with this number
WHOLE = 2048
ENTIRE = -1
#: the place in the order, coarsely, of a prefix that ends with a frequent n-gram
LATE = (1 << 31) - 1
#: so many nodes of a large component are compared with each of the others, and twice as many each further turn
LEADERS = 32
#: further turns, at most; there are some only while the candidates with such components are more than this share of the
#: postings, and more than a few
TURNS = 4
CROWDED = 0.25
FEW = 10_000
#: frequent n-grams' postings are dealt out over so many groups
SALTS = 64


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The ascending distinct n-gram hashes of every text."""
    hashes, cuts = window_hashes(split_words(texts, SPACE_WORDS), n)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h = np.sort(hashes[a:b])
        yield h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def node_of(grams: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix64(np.array([mix64(grams).sum(dtype=np.uint64) ^ np.uint64(len(grams))]))[0].view(np.int64))


def prefix_size(n: int, percent: int) -> int:
    """So many first n-grams of a set of ``n`` hold one of any set with that similarity."""
    return n - -(-percent * n // 100) + 1


def _profile(n: int):
    """Per text its node and set size; per batch the n-grams of several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in slices([batch], 1) for s in gram_sets(part.column(1), n)]
            nodes = [node_of(s) if len(s) else None for s in sets]
            first = {node: s for node, s in zip(nodes, sets) if node is not None}
            grams, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *first.values()]), return_counts=True)
            grams, times = grams[times > 1], times[times > 1]
            some, none = batch.num_rows, len(grams)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(none, batch.column(0).type)]),
                    pa.concat_arrays([pa.array(nodes, pa.int64()), pa.nulls(none, pa.int64())]),
                    pa.concat_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.nulls(none, pa.int64())]),
                    pa.concat_arrays([pa.nulls(some, pa.int64()), pa.array(grams.view(np.int64))]),
                    pa.concat_arrays([pa.nulls(some, pa.int64()), pa.array(times, pa.int64())]),
                ],
                names=["id", "node", "n", "gram", "times"],
            )

    return run


def frequent_grams(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that come last, ascending, and their counts: the most frequent, MAX_FREQUENT at most.

    The order only decides how much work the join is, never its result.
    """
    counts = profile.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times"))
    counts = materialise(counts, "gram-counts")
    level = F.least(F.col("times"), F.lit(10_000))
    total, least = 0, 10_001
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        total += row["count"]
        if total > MAX_FREQUENT:
            break
        least = row.level
    found = counts.where(level >= least).toPandas()
    grams = found["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found["times"].to_numpy(np.int64)[order]


def _postings(n: int, percent: int, frequent: np.ndarray, times: np.ndarray):
    """Prefix n-grams of every set, once per batch: gram, node, size and position, whether frequent,
    and where in the global order the prefix ends (coarsely)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            seen, parts = set(), []
            for grams in gram_sets(batch.column(0), n):
                node = node_of(grams) if len(grams) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                at = np.minimum(np.searchsorted(frequent, grams), max(len(frequent) - 1, 0))
                late = np.zeros(len(grams), np.int64)
                if len(frequent):
                    late = np.where(frequent[at] == grams, times[at], 0)
                order = np.argsort(late, kind="stable")[: prefix_size(len(grams), percent)]
                end = order[-1]
                end = LATE if late[end] else int(grams[end] >> np.uint64(33)) - 1
                parts.append((grams[order], late[order] > 0, np.full(len(order), node), (len(grams) << 32) + np.arange(len(order)), np.full(len(order), end)))
            if parts:
                grams, late, node, place, end = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(node.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(late), pa.array(end.astype(np.int32))],
                    names=["gram", "node", "place", "late", "end"],
                )

    return run


def _bound(percent: int, most: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets that share ``most`` n-grams at most can reach the similarity."""
    return (F.lit(100 + percent) * most >= F.lit(percent) * (n_a + n_b)) & (
        F.lit(100) * F.least(n_a, n_b) >= F.lit(percent) * F.greatest(n_a, n_b)
    )


def _left(x: str) -> Column:
    """N-grams of a set from a position on."""
    return F.col(f"n_{x}") - F.col(f"at_{x}")


def _first(percent: int) -> Column:
    """Whether an n-gram can be the first that two linked sets share: they share at most what is left from it on."""
    return _bound(percent, F.least(_left("a"), _left("b")), F.col("n_a"), F.col("n_b"))


def _fragments(grams: np.ndarray, percent: int, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """A set as ``ENTIRE`` if one that is compared whole can reach the similarity with it, and in fragments unless it is one itself."""
    if len(grams) * percent < whole * 100:
        yield ENTIRE, grams
    if len(grams) >= whole:
        cuts = np.searchsorted(grams >> np.uint64(32), np.arange(1, FRAGMENTS).astype(np.uint64) * np.uint64((1 << 32) // FRAGMENTS))
        yield from ((k, part) for k, part in enumerate(np.split(grams, cuts)) if len(part))


def _read_again(docs: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """``node, fragment, grams`` of the wanted nodes (``id`` of one text with that set).

    Tasks read only the texts whose id passes the bit filter, and nothing but
    their sets is shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "id"))
    nameless = wanted.where("id is null").limit(1).count() > 0
    whole = WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            kept = held(bits.value, batch.column(1))
            if nameless:
                kept |= pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
            nodes, fragments, grams = [], [], []
            for s in gram_sets(batch.column(0).filter(pa.array(kept)), n):
                if len(s):
                    for k, part in _fragments(s, percent, whole):
                        nodes.append(node_of(s))
                        fragments.append(k)
                        grams.append(part.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(grams, pa.list_(pa.int64()))],
                names=["node", "fragment", "grams"],
            )

    read = docs.select("text", place("id").alias("at")).mapInArrow(run, "node long, fragment int, grams array<long>")
    return read.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "fragment"])


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of the pairs."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b, n_a, n_b``) that reach the similarity, by partial overlaps of all fragments.

    Sizes of a pair are such that it can reach it: a set that is compared whole is with any of its partners.
    """
    side = lambda x: segments.select(F.col("node").alias(x), "fragment", F.col("grams").alias(f"grams_{x}"))
    whole = lambda c: c.alias("whole")
    partial = (
        pairs.select("a", "b", "n_a", "n_b", whole(F.least("n_a", "n_b") < WHOLE))
        .join(side("a").select("*", whole(F.col("fragment") == ENTIRE)), ["a", "whole"])
        .join(side("b"), ["b", "fragment"])
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    )
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def _with_sets(docs: DataFrame, segments: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The segments, with those of the nodes of ``pairs`` that they don't have yet."""
    unread = materialise(_ends(pairs).join(segments.select("node").distinct(), "node", "left_anti"), "unread")
    if unread.isEmpty():
        return segments
    return segments.unionByName(materialise(_read_again(docs, nodes.join(unread, "node", "left_semi"), n, percent), "segments"))


def _large(member: DataFrame, least: int) -> DataFrame:
    """``gram, component, inside``: the component with most nodes in an n-gram, if more than ``least``."""
    size = member.groupBy("gram", "component").count()
    size = size.groupBy("gram").agg(F.max(F.struct("count", "component")).alias("most"))
    return size.select("gram", "most.component", F.col("most.count").alias("inside")).where(F.col("inside") > least)


def _drawn(member: DataFrame, turn: int) -> DataFrame:
    """``a, b, of``: nodes that share n-grams with a large component, each with some of its nodes that have one of these
    n-grams (``of`` as many in all to each). Both are drawn by hash, others in another turn."""
    leaders = LEADERS << turn
    large = _large(member, leaders).withColumnRenamed("component", "large")
    near = member.join(large, "gram").withColumn("of_it", F.col("component") == F.col("large"))
    chosen = (
        near.where("not of_it")
        .groupBy(F.col("node").alias("a"), "large")
        .agg(F.min(F.struct(F.xxhash64("gram", F.lit(turn)), "gram")).alias("one"))
        .select("a", F.col("one.gram").alias("gram"))
    )
    lot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20).cast("long"))
    drawn = near.where("of_it").where(lot * F.col("inside") < F.lit(leaders << 20))
    drawn = drawn.select("gram", F.col("node").alias("b"), (F.col("inside") / leaders).alias("of"))
    return chosen.join(drawn, "gram").groupBy("a", "b").agg(F.max("of").alias("of"))


def _mixed(member: DataFrame) -> DataFrame:
    """The postings of n-grams that more than one component has."""
    gram = member.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("gram")
    return member.join(gram, "gram", "left_semi")


def similar_groups(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` (set size), ``component_id``, ``copies`` (texts with an equal set).

    Words: runs of anything but ASCII white space, A-Z lower-cased. A text's
    set: its distinct ``n``-word shingles; the whole sequence as one if there
    are fewer words. Texts link when ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable by links. Null and empty
    texts have no set and link with nothing (their own id). Repeated rows are
    copies of each other; null ids link like others but are no component_id
    unless a component has no other. Other columns are not read. Sets and
    shingles are compared by 64-bit hashes.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    profile = materialise(
        docs.mapInArrow(_profile(n), f"id {id_type}, node long, n long, gram long, times long"), "profile"
    )
    rows = profile.where("gram is null").select("id", "node", "n")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes, "nodes")

    frequent, times = frequent_grams(profile)
    salt = F.when(F.col("late"), F.pmod("node", F.lit(SALTS).cast("long"))).otherwise(F.lit(0).cast("long"))
    together = Window.partitionBy("gram", "salt")
    postings = (
        docs.select("text")
        .mapInArrow(_postings(n, percent, frequent, times), "gram long, node long, place long, late boolean, end int")
        .withColumn("salt", salt)
        .withColumn("least", F.min("node").over(together))
        .withColumn("most", F.max("node").over(together))
        .where("late or least < most")
    )
    kept = postings.select("gram", "salt", "node", "place", "end").distinct().drop("salt")
    place = (F.shiftright("place", 32).alias("n"), F.expr("place & 4294967295").alias("at"))
    shared = materialise(kept, "shared").select("gram", "node", *place, "end")

    # one leader per node: of the prefix n-grams it shares, most come with that leader
    lead = shared.groupBy("gram").agg(
        F.min(F.struct("at", "n", "node")).alias("lead"), F.max("node").alias("most"), F.min("node").alias("least")
    )
    lead = lead.where("least < most").select(
        "gram", *(F.col(f"lead.{c}").alias(name) for c, name in (("node", "b"), ("n", "n_b"), ("at", "at_b")))
    )
    follow = (
        shared.select("gram", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
        .join(lead, "gram")
        .where((F.col("a") != F.col("b")) & _first(percent))
        .groupBy("a", "n_a", "b", "n_b")
        .count()
        .where(F.col("count") * 6 * 100 >= F.lit(100 - percent) * F.col("n_a"))
        .groupBy("a", "n_a")
        .agg(F.max(F.struct("count", "n_b", "b")).alias("best"))
        .select("a", "n_a", F.col("best.b").alias("b"), F.col("best.n_b").alias("n_b"))
    )
    follow = materialise(follow, "followers")
    segments = materialise(_read_again(docs, nodes.join(_ends(follow), "node", "left_semi"), n, percent), "segments")
    stars = materialise(linked(follow, segments, percent).select("a", "b"), "stars")

    # what is left: pairs across the components so far
    group = materialise(components(stars), "components")
    member = shared.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = materialise(_mixed(member), "members")
    # all shared n-grams of both prefixes are known, and one shared beyond the prefix that ends first is
    # among the rest of that set
    front = member.groupBy("node").agg(F.collect_set("gram").alias("grams"), F.first("n").alias("n"), F.first("end").alias("end"))
    front = materialise(front, "prefixes")
    prefix = lambda x: front.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("grams", "n", "end")))
    rest = lambda x: F.expr(f"({percent} * n_{x} + 99) div 100 - 1")
    beyond = F.when(F.col("end_a") < F.col("end_b"), rest("a")).when(F.col("end_a") > F.col("end_b"), rest("b"))
    beyond = F.coalesce(beyond, F.greatest(rest("a"), rest("b")))

    def candidates(pairs: DataFrame, *more: str) -> DataFrame:
        found = pairs.join(prefix("a"), "a").join(prefix("b"), "b")
        found = found.where(_bound(percent, F.size(F.array_intersect("grams_a", "grams_b")) + beyond, F.col("n_a"), F.col("n_b")))
        return found.select("a", "b", "n_a", "n_b", *more)

    for turn in range(TURNS):
        drawn = materialise(candidates(_drawn(member, turn), "of"), "drawn")
        if (drawn.agg(F.sum("of")).first()[0] or 0) <= max(FEW, CROWDED * member.count()):
            break
        segments = _with_sets(docs, segments, drawn, nodes, n, percent)
        stars = stars.unionByName(materialise(linked(drawn, segments, percent).select("a", "b"), "stars"))
        group = materialise(components(stars), "components")
        member = member.drop("component").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        member = materialise(_mixed(member), "members")
    side = lambda x: member.select("gram", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at", "component")))
    met = (
        side("a")
        .join(side("b"), "gram")
        .where("node_a < node_b and component_a <> component_b")
        .where(_first(percent))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    pairs = materialise(candidates(met), "pairs")
    segments = _with_sets(docs, segments, pairs, nodes, n, percent)
    links = stars.unionByName(linked(pairs, segments, percent).select("a", "b"))

    final = materialise(components(links), "components")
    named = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    by_node = named.join(smallest, "component").select("node", "component_id", "copies")
    out = rows.join(by_node, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )
