"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions alone.

A text's units are its lines and, where it has several, the whole text. Letters are lower-cased and all
but letters and digits becomes a space. A unit whose set of word bigrams reaches ``THRESHOLD`` with a
template's is reported with the best one. Two sets can only reach it if their sizes are close; a
template is therefore listed under every size that could, and units meet templates by size. Nor can
they if more than a share of the template's bigrams is missing: units without any of a few words
that lie in more than that share are left out beforehand, which loses nothing.

Null and empty texts and units of one word match nothing. Equal scores go to the licence that sorts
first. Repeated rows, rows that share a doc_id and rows without one are reported each; a very long text
is one whole unit and as many as it has lines; other columns, whatever their names, are not looked at;
an empty table gives an empty result. The templates are a fixed small table, so it is broadcast.

Passages are found wherever they stand, wrapped over lines, inside a longer text or inside a line: a
passage is a stretch of the whole text's words that begins and ends with a bigram of the template and
has at most ``(2 - threshold) / threshold`` times its number of bigrams, repeated ones counted. A unit
that reaches the threshold has more than a share of the template's bigrams, so only stretches with so
many are compared, which loses nothing. Of passages that overlap, that with more of its template counts.
"""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS

THRESHOLD = 0.8
#: Words that many texts have; any choice of words is right, this one is quick.
COMMON = frozenset("a and any by for in is of on or the this to under with work".split())
# Notices as their licences' publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def all_bigrams(text: Column) -> Column:
    """The pairs of neighbouring words of a text, normalised, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a text, normalised."""
    return F.array_distinct(all_bigrams(text))


def telling_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every unit that matches has one: for each template, words in more of its
    bigrams than may be missing. Long words, and those chosen already, come first, common ones last."""
    chosen: list[str] = []
    for _, notice in templates:
        words = regex.findall(r"[\p{L}\p{N}]+", notice.lower())
        pairs = set(zip(words, words[1:]))
        missing = len(pairs) - threshold / (2 - threshold) * len(pairs) + 1e-9
        own: set[str] = set()
        for word in sorted(set(words), key=lambda w: (w in COMMON, w not in chosen, -len(w), w)):
            if sum(bool(own & {*p}) for p in pairs) > missing:
                break
            own.add(word)
        chosen += sorted(own - {*chosen})
    return chosen


def template_sizes(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """license, pairs and every number of bigrams with which a unit can reach the threshold."""
    t = spark.createDataFrame(templates, "license string, notice string").select("license", bigrams(F.col("notice")).alias("pairs"))
    n = F.size("pairs")
    low, high = F.ceil(n * (threshold / (2 - threshold)) - 1e-9), F.floor(n * ((2 - threshold) / threshold) + 1e-9)
    return t.withColumn("size", F.explode(F.sequence(low, high)))


def told(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 1; 0 is the whole text), license and dice of every unit that matches."""
    templates = templates or TEMPLATES
    words = telling_words(templates, threshold)
    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit")))).otherwise(F.array().cast("array<struct<line:int,unit:string>>"))
    each = F.transform(lines, lambda x, k: F.struct((k + 1).alias("line"), x.alias("unit")))
    units = docs.where("text is not null").where(told(F.col("text"), words)).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.concat(whole, each)).alias("u"))
    sized = units.where(told(F.col("u.unit"), words)).select("doc_id", "u.line", bigrams(F.col("u.unit")).alias("own")).withColumn("size", F.size("own").cast("long"))
    by_size = template_sizes(docs.sparkSession, templates, threshold).groupBy("size").agg(F.collect_list(F.struct("license", "pairs")).alias("listed"))

    def scored(t: Column) -> Column:
        return F.struct((F.size(F.array_intersect("own", t["pairs"])) * -2.0 / (F.col("size") + F.size(t["pairs"]))).alias("d"), t["license"].alias("license"))

    best = F.array_min(F.filter(F.transform("listed", scored), lambda x: -x["d"] >= threshold))
    rows = sized.join(F.broadcast(by_size), "size").select("doc_id", "line", best.alias("b")).where("b is not null")
    return rows.select("doc_id", "line", "b.license", (-F.col("b.d")).alias("dice"))


def bound(value: Column, use) -> Column:
    """use of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stretches(own: Column, t: Column, threshold: float) -> Column:
    """For each start in a text's bigrams the best passage of a template: shared and dice (negative, for
    sorting), license, start and last."""
    n = F.size(t["pairs"])

    def scored(p: Column, q: Column) -> Column:
        def dice(piece: Column) -> Column:
            shared = F.size(F.array_intersect(piece, t["pairs"]))
            return F.struct((-shared).alias("shared"), (shared * -2.0 / (F.size(piece) + n)).alias("dice"), t["license"].alias("license"), p.alias("start"), q.alias("last"))

        return bound(F.array_distinct(F.slice(own, p, q - p + 1)), dice)

    def from_places(at: Column) -> Column:
        def best(p: Column, k: Column) -> Column:
            ends = F.filter(F.slice(at, k + t["need"], t["span"]), lambda q: q - p < t["span"])
            return F.array_min(F.filter(F.transform(ends, lambda q: scored(p, q)), lambda x: -x["dice"] >= threshold))

        return F.filter(F.transform(at, best), lambda x: x.isNotNull())

    places = bound(F.array_intersect(own, t["pairs"]), lambda known: F.filter(F.sequence(F.lit(1), F.size(own)), lambda k: F.array_contains(known, F.get(own, k - 1))))
    return bound(places, from_places)


def find_passages(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_word (from 1), n_words, license and dice of every passage that matches."""
    templates = templates or TEMPLATES + TEXTS
    listed = docs.sparkSession.createDataFrame(templates, "license string, notice string").select("license", all_bigrams(F.col("notice")).alias("every")).withColumn("pairs", F.array_distinct("every"))
    need = F.ceil(F.size("pairs") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    span = F.floor(F.size("every") * ((2 - threshold) / threshold) + 1e-9).cast("int")
    listed = listed.agg(F.collect_list(F.struct("license", "pairs", need.alias("need"), span.alias("span"))).alias("listed"))
    listed = listed.withColumn("known", F.array_distinct(F.flatten(F.transform("listed", lambda t: t["pairs"]))))
    told_docs = docs.where("text is not null").where(told(F.col("text"), telling_words(templates, threshold)))
    own = told_docs.select(F.col("doc_id").cast("long").alias("doc_id"), all_bigrams(F.col("text")).alias("own")).crossJoin(F.broadcast(listed))
    held = own.withColumn("held", F.array_intersect("own", "known"))
    likely = held.withColumn("likely", F.filter("listed", lambda t: F.size(F.array_intersect("held", t["pairs"])) >= t["need"])).where(F.size("likely") > 0)
    found = likely.select("doc_id", F.array_sort(F.flatten(F.transform("likely", lambda t: stretches(F.col("own"), t, threshold)))).alias("found")).where(F.size("found") > 0)
    none = F.filter("found", lambda x: F.lit(False))
    apart = F.aggregate("found", none, lambda kept, x: F.when(F.exists(kept, lambda y: (x["start"] <= y["last"]) & (y["start"] <= x["last"])), kept).otherwise(F.concat(kept, F.array(x))))
    rows = found.select("doc_id", F.explode(apart).alias("f"))
    return rows.select("doc_id", F.col("f.start").alias("first_word"), (F.col("f.last") - F.col("f.start") + 2).alias("n_words"), "f.license", (-F.col("f.dice")).alias("dice"))
