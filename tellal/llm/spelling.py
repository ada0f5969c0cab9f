"""Spelling variants: words that differ by one letter, found through PartEnum signatures.

A word's multiset of letters is a binary vector with a dimension for each letter and occurrence. One
letter inserted or deleted is a Hamming distance of one between words whose lengths differ by one; one
letter replaced is a distance of two between words of one length. For a distance of at most k the
dimensions are dealt into ``groups`` groups of ``parts`` parts: two vectors that near differ in at most
(k + 1) / groups, rounded up, less one, of the parts of some group, so they agree on all others, and each
choice of parts to agree on is a signature (``choices``). Words are joined on signature and length alone,
which loses no pair, and a pair of the join counts if its edit distance is one.

Counting words is a partial aggregation, so a word that is everywhere is one row a task. A word's form is
its commonest near word, if that is at least ``factor`` times as frequent; as counts then grow at least
so much along forms, chains are short and end, and roots are found by doubling their steps. Tables of
words are merged, never broadcast: below the size at which Spark broadcasts, their files are packed, and the
driver would unpack them.

A null text has no words; a null doc_id counts as the empty text in the digest that misspells. Repeated
rows count as often as they occur; an empty table gives an empty result; other columns are not looked
at, whatever their names. Very long texts are taken apart within their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored, texts

RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FACTOR, ONE_IN = 6, 5, 5, 199
#: (distance, groups, parts) of the signatures for one letter replaced and for one more or less.
REPLACED, INSERTED = (2, 1, 7), (1, 1, 4)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word, n: the runs of letters of all texts, one letter deleted where a digest of document and run
    says so, of at least so many code points and occurrences."""
    runs = texts(docs).select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def choices(distance: int, groups: int, parts: int) -> list[tuple[int, ...]]:
    """The sets of parts, numbered through the groups, of which two vectors within the distance agree on one."""
    differ = -(-(distance + 1) // groups) - 1
    if parts <= differ:
        raise ValueError("too few parts")
    return [tuple(g * parts + p for p in kept) for g in range(groups) for kept in combinations(range(parts), parts - differ)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str], distance: int, groups: int, parts: int) -> np.ndarray:
    """One row a word, one column a choice."""
    size = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    order = np.lexsort((letter, owner))
    owner, letter = owner[order], letter[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (letter[1:] != letter[:-1])]) if len(owner) else np.zeros(0, bool)
    place = np.arange(len(owner))
    occurrence = place - np.maximum.accumulate(np.where(new, place, 0))
    dimension = mixed((letter << 24 | occurrence).astype(np.uint64))
    part = (mixed(dimension) % np.uint64(groups * parts)).astype(np.int64)
    sums = np.zeros((len(words), groups * parts), np.uint64)
    np.add.at(sums, (owner, part), dimension)
    sums = mixed(sums + mixed(np.arange(groups * parts, dtype=np.uint64)))
    kept = choices(distance, groups, parts)
    number = mixed(np.arange(1, len(kept) + 1, dtype=np.uint64))
    return np.stack([mixed(sums[:, list(c)].sum(axis=1, dtype=np.uint64) + number[k]) for k, c in enumerate(kept)], axis=1)


def signed(words: DataFrame, scheme: tuple[int, int, int], shorter: int = 0) -> DataFrame:
    """word with each of its signatures and its length, less ``shorter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word").to_pylist()
            keys = signatures(found, *scheme)
            size = np.array([len(w) for w in found], np.int32) - shorter
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(size, n)), batch.column("word").take(pa.array(np.repeat(np.arange(len(found)), n)))],
                ["signature", "size", "word"],
            )

    return in_batches(words.select("word"), run, "signature long, size int, word string")


def near_words(words: DataFrame, replaced: tuple[int, int, int] = REPLACED, inserted: tuple[int, int, int] = INSERTED) -> DataFrame:
    """(word, near), both ways, once each: words an inserted, deleted or replaced letter apart."""
    key, apart = ["signature", "size"], F.levenshtein("word", "near", 1) == 1

    def joined(left: DataFrame, right: DataFrame, condition: F.Column) -> DataFrame:
        a, b = left.alias("a"), right.withColumnRenamed("word", "near").alias("b")
        return a.join(b.hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [condition & apart]).select("word", "near")

    same = joined(signed(words, replaced), signed(words, replaced), F.col("word") < F.col("near"))
    longer = joined(signed(words, inserted), signed(words, inserted, 1), F.lit(True))
    pairs = same.unionByName(longer)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """forms: word, form. Where following forms, steps of them at most, ends: word, root."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words: word, n. Each with its number of near words, its form and the form's n, and its root."""
    words = stored(words)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    near = near_words(words).join(counts.hint("merge"), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    fits = -F.col("best.minus") >= F.col("n") * factor
    found = stored(words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    least, most = found.agg(F.min("n"), F.max("n")).first()
    steps = math.ceil(math.log(most / least, factor)) + 1 if most else 0
    ends = roots(found.where("form is not null"), steps)
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
