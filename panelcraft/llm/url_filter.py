"""URL filters: captures against block and allow lists as they stood when each page was fetched.

Dated list entries (a pattern added or removed on a day) become validity
intervals per pattern. Every distinct place (host and as many path parts as the
list's deepest pattern has) and day
of the captures is then looked up as of that day, and the captures take the
verdict of their place and day. A host that holds a third of all captures is a
few rows by then, one for each place and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The lower-case host of a URL without user, port and final dot; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(F.lower(found), r"\.$", "")


def path_parts(url: Column, depth: int) -> Column:
    """The first ``depth`` parts of a URL's path, as an array."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, depth)


def deepest(listed: DataFrame) -> int:
    """Path parts of the pattern that has the most."""
    return listed.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, since, until``: from each change of a pattern to its next (until null: for good).

    Of changes of one pattern on one day the last counts, in the order remove,
    allow, block. Rows with a null pattern, day or action are no entries.
    """
    rows = entries.select(F.lower("pattern").alias("pattern"), F.to_date("day").alias("since"), F.lower("action").alias("action"))
    rows = rows.where(F.col("pattern").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("remove", "allow", "block"))
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    rows = rows.groupBy("pattern", "since").agg(F.max_by("action", strength).alias("action"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return rows.withColumn("until", until)


def keys(site: Column, parts: Column) -> Column:
    """All patterns that can hold for a place: the host and its parent domains, each with and without path parts."""
    labels = F.split(site, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.concat(F.array(F.lit("")), F.slice(parts, 1, n)), "/"))
    return F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """One row per capture: id, ``host``, ``day``, ``pattern`` and ``since`` of the deciding entry, ``verdict``.

    ``entries``: ``pattern`` (domain, or domain/path parts; covers subdomains
    and deeper paths), ``day``, ``action`` (block, allow, remove). Among the
    entries active on the day of the fetch the one with the longest pattern
    decides; ties go to the later text. The verdict is ``block`` or ``keep``.
    Captures without host or day match nothing and are kept; repeated rows are
    reported each; an entry holds from its own day on. Other columns are not
    read.
    """
    url = F.col(url_col)
    listed = intervals(entries)
    depth = deepest(listed)
    rows = captures.select(
        F.col(id_col).alias("id"), host(url).alias("host"), path_parts(url, depth).alias("parts"), F.to_date(F.col(day_col)).alias("day")
    ).withColumn("host", F.when(F.col("host") != "", F.col("host")))
    places = rows.where("host is not null and day is not null").select("host", "parts", "day").distinct()
    asked = places.withColumn("pattern", F.explode(keys(F.col("host"), F.col("parts"))))

    # as of each asked day: the last change of the pattern up to it
    changes = listed.select("pattern", F.col("since").alias("day"), F.struct("action", "since", "until").alias("change"))
    days = asked.select("pattern", "day").distinct().join(listed.select("pattern").distinct(), "pattern", "left_semi")
    days = days.withColumn("change", F.lit(None).cast(changes.schema["change"].dataType))
    order = Window.partitionBy("pattern").orderBy("day", F.col("change").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    state = (
        changes.unionByName(days)
        .withColumn("state", F.last("change", ignorenulls=True).over(order))
        .where(F.col("change").isNull() & F.col("state.action").isin("block", "allow"))
        .select("pattern", "day", F.col("state.action").alias("action"), F.col("state.since").alias("since"))
    )
    decided = (
        asked.join(state, ["pattern", "day"])
        .groupBy("host", "parts", "day")
        .agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "since")).alias("best"))
        .select("host", "parts", "day", "best.pattern", "best.since", "best.action")
    )
    out = rows.join(decided, ["host", "parts", "day"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "host",
        "day",
        "pattern",
        "since",
        F.when(F.col("action") == "block", "block").otherwise("keep").alias("verdict"),
    )
