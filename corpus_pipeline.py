"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes what the one before it kept, as Parquet, and all but the last return the columns
of ``documents``. The stages' operators are in ``tellal.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellal.llm import bpe, decontam, langid, ngram_join, substring
from tellal.llm.common import packed, scratch, shared_dir, table, unpacked

#: A prediction of less than this is no language.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null, without letters, or undecided."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(packed(docs), model, ("text", "rest"))
    return unpacked(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts whose five-word shingle sets have a Jaccard similarity of
    0.8 or more: that of the smallest doc_id. Texts without words are in no group: of them, and of
    any group, only rows with the same doc_id and text are one. Rows without a doc_id stay."""
    chosen = shared_dir(spark)
    with scratch(spark):
        groups = ngram_join.similar_components(docs, size=5, threshold="8/10", with_groups=True).where("doc_id is not null")
        rows = groups.groupBy("group", "doc_id", "part").agg(F.count("*").alias("rows"))
        first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "part", "rows")).alias("f")).select("f.*")
        first.unionByName(rows.where("group is null").drop("group")).write.parquet(chosen)
    # which rows stay is all that is needed from here on
    first = spark.read.parquet(chosen)
    kept = packed(docs).withColumn("part", F.xxhash64("text")).join(first.hint("merge"), ["doc_id", "part"])
    if first.where("rows > 1").limit(1).count():
        alike = Window.partitionBy("doc_id", "part").orderBy(F.xxhash64("rest"))
        again = kept.where("rows > 1").withColumn("k", F.row_number().over(alike)).where("k = 1").drop("k")
        kept = kept.where("rows = 1").unionByName(again)
    return unpacked(kept, docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of 50 words that a document of a smaller doc_id has; documents left without a word go."""
    cut = unpacked(substring.deduplicate(packed(docs), keep=("rest",)).where("n_words > n_removed"), docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_texts(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", tokenize),
]
#: Learned language profiles, clusters and encodings are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
