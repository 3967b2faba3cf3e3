"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units compared are a text's lines (a licence notice stands on a line of its
own) and the whole text (the text is a licence). Sets of bigrams with sizes
``a`` and ``b`` reach a Dice coefficient ``d`` only if ``d / (2 - d) <= a / b <=
(2 - d) / d``, so a unit is compared only with templates of about its size, and
most units with none. A match also shares most of the template's bigrams, so
units without any of a few telling words are passed over at once.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual one-paragraph notices and titles of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


#: Words too frequent to tell a licence from other text.
EVERYDAY = {"a", "all", "and", "any", "at", "by", "for", "in", "is", "it", "of", "or", "that", "the", "this", "to", "under", "with", "work", "you"}


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling_words(own: list[str], percent: int, known: set[str]) -> set[str]:
    """Words of which every matching unit has at least one.

    A match shares at least ``percent / (200 - percent)`` of the template's
    bigrams, so it has one of any larger remainder: words are taken, those in
    ``known`` first, everyday words last and long ones before short ones, until
    they touch that many bigrams.
    """
    least = -(-percent * len(own) // (200 - percent))
    pairs = [set(g.split()) for g in own]
    taken: set[str] = set()
    for word in sorted(set().union(*pairs), key=lambda w: (w not in known, w in EVERYDAY, -len(w), w)):
        if sum(bool(p & taken) for p in pairs) > len(own) - least:
            break
        taken.add(word)
    return taken


def _once(value: Column) -> Column:
    """The value as a generated row: a filter on it is not pushed below, where it would be worked out again."""
    return F.explode(F.array(value))


def _words(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, ``n_units``, ``n_matched``, ``licenses`` (sorted names), ``best`` (per mille).

    A unit matches its best template (highest Dice coefficient, ties to the
    later name) if the coefficient reaches ``percent``; ``best`` is the highest
    coefficient of a matching unit, in whole per mille, 0 without a match.
    Words are runs of a-z and 0-9 of the lower-cased text. Units without a
    bigram match nothing; null and empty texts have no units that do. Templates
    need two words. Repeated rows and null ids are reported each. Other columns
    are not read.
    """
    grams = {name: template_bigrams(text) for name, text in templates.items()}
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    counted = rows.select("row", "id", F.when(F.col("text").isNull(), 0).otherwise(F.size(units)).alias("n_units"))
    telling: set[str] = set()
    for own in grams.values():
        telling |= telling_words(own, percent, telling)
    low = F.lower("unit")
    units = rows.select("row", F.explode(units).alias("unit"))
    likely = units.where(reduce(or_, (low.contains(w) for w in sorted(telling))))
    words = likely.select("row", _once(_words(F.col("unit"))).alias("words"))
    # size bounds, first by words (a unit has fewer distinct bigrams than words), then by bigrams
    smallest = min(len(g) for g in grams.values())
    words = words.where((200 - percent) * (F.size("words") - 1) >= percent * smallest)
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b))
    sized = words.select("row", _once(F.array_distinct(pairs)).alias("grams")).withColumn("n", F.size("grams"))

    def dice(name: str, own: list[str]) -> Column:
        fits = ((200 - percent) * F.col("n") >= percent * len(own)) & (percent * F.col("n") <= (200 - percent) * len(own))
        common = F.size(F.array_intersect("grams", F.array(*map(F.lit, own))))
        return F.when(
            fits, F.struct((2 * common / (F.col("n") + len(own))).alias("dice"), common.alias("common"), F.lit(name).alias("name"))
        )

    largest = max(len(g) for g in grams.values())
    found = (
        sized.where(percent * F.col("n") <= (200 - percent) * largest)
        .select("row", "n", _once(F.array_max(F.array(*(dice(k, g) for k, g in grams.items())))).alias("best"))
        .where(F.col("best.dice") * 100 >= percent)
        .groupBy("row")
        .agg(
            F.count(F.lit(1)).alias("n_matched"),
            F.array_join(F.array_sort(F.collect_set("best.name")), ",").alias("licenses"),
            F.max(F.floor(F.col("best.dice") * 1000)).cast("int").alias("best"),
        )
    )
    return counted.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "n_units",
        F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("best", F.lit(0)).alias("best"),
    )


def oracle(percent: int = 80) -> str:
    """The same in DuckDB's SQL, over ``documents`` (distinct ids)."""
    names = ", ".join(
        f"('{k}', [{', '.join(repr(g) for g in template_bigrams(t))}])" for k, t in TEMPLATES.items()
    )
    return f"""
WITH templates(name, own) AS (VALUES {names}
), units AS (
  SELECT doc_id, unnest(CASE WHEN len(string_split(text, chr(10))) > 1
    THEN list_append(string_split(text, chr(10)), text) ELSE string_split(text, chr(10)) END) AS unit
  FROM documents
), words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
), grams AS (
  SELECT doc_id, row_number() OVER () AS u,
         list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
), scored AS (
  SELECT doc_id, u, name, 2 * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grams, templates
), best AS (
  SELECT doc_id, u, max(dice) AS dice, arg_max(name, (dice, name)) AS name FROM scored WHERE dice * 100 >= {percent} GROUP BY doc_id, u
), found AS (
  SELECT doc_id, count(*) AS n_matched, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(floor(dice * 1000))::INT AS best
  FROM best GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_units FROM units GROUP BY doc_id
)
SELECT doc_id, coalesce(n_units, 0)::INT AS n_units, coalesce(n_matched, 0) AS n_matched, coalesce(licenses, '') AS licenses, coalesce(best, 0) AS best
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN found USING (doc_id)
"""
