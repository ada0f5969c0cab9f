"""Language identification, words first, with backoff to character n-grams.

A known word scores its log frequency in each language. An unseen word is cut into the longest
n-grams the model knows, ``LONGEST`` characters first, shorter ones where those are unknown. The
sum over a text, made a posterior, gives language and score.

A model is fitted on a bounded sample: about ``SAMPLE`` documents of each language that any document
has, of a longer one a slice of ``SAMPLE_CHARS`` characters from somewhere in it; only languages that the sample holds countable units of are ever predicted.
Prediction reads every whole text, however long, without a shuffle. Text that is null or holds no
letter (digits, fractions and Roman numeral signs are none) is ``und`` with score 0, and so is every
text if no language was learned. Ties go to the language that sorts first. Repeated rows are
predicted each, rows without a doc_id like others, an empty table gives an empty result, and columns
are passed on only where they are named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, texts, with_fields

SAMPLE = 500
SAMPLE_CHARS = 20_000
LONGEST = 5
#: A word or n-gram must occur so often in the sample to be known.
LEAST = 3
#: Evidence beyond so many words does not sharpen the score further.
ENOUGH = 30
WORD = regex.compile(r"\p{L}+")
REMEMBERED = 400_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    log_words: np.ndarray
    log_grams: np.ndarray


def counted(units: DataFrame, key: str) -> DataFrame:
    return units.groupBy(key, "lang").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(key))).where(F.col("all") >= LEAST).drop("all")


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """docs: doc_id, text, lang."""
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for lang in sizes for x in (lang, min(million, million * sample // sizes[lang] + 1))])
    some = known.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(million)) < share[F.col("lang")])
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    some = some.select("lang", F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)).alias("text"))
    words = some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = words.persist()
    marked = words.withColumn("w", F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    cut = F.expr(f"flatten(transform(sequence(1, {LONGEST}), k -> transform(sequence(1, greatest(length(w) - k + 1, 1)), p -> substring(w, p, k))))")
    grams = counted(marked.select("lang", "n", F.explode(cut).alias("gram")), "gram")
    rows_w, rows_g = counted(words, "word").collect(), grams.collect()
    words.unpersist()
    languages = sorted({r["lang"] for r in [*rows_w, *rows_g]})
    order = {lang: k for k, lang in enumerate(languages)}

    def logs(rows: list, key: str) -> tuple[dict[str, int], np.ndarray]:
        """Log relative frequencies. What a language lacks counts the same in every language: half an
        occurrence in the largest sample; and a sample below a tenth of the largest counts as a tenth,
        so that few words or none are no advantage."""
        index: dict[str, int] = {}
        for u in sorted({r[key] for r in rows}):
            index[u] = len(index)
        count = np.zeros((len(index), len(languages)))
        for r in rows:
            count[index[r[key]], order[r["lang"]]] += r["n"]
        total = count.sum(0)
        most = max(1.0, total.max(initial=0))
        return index, np.log(np.maximum(count / np.maximum(total, most / 10), 0.5 / most))

    words_at, log_words = logs(rows_w, "word")
    grams_at, log_grams = logs(rows_g, "gram")
    return LanguageModel(languages, words_at, grams_at, log_words.astype(np.float32), log_grams.astype(np.float32))


class Scores(dict):
    """Word to its row in a growing table of log scores per language."""

    def __init__(self, model: LanguageModel):
        self.model, n = model, len(model.languages)
        self.rows = np.zeros((1 << 12, n), np.float32)
        self.floor = np.zeros(n, np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.of(word)
        self[word] = k
        return k

    def of(self, word: str) -> np.ndarray:
        m = self.model
        at = m.words.get(word)
        if at is not None:
            row = m.log_words[at]
            return row - row.max()
        w, p, total = f" {word} ", 0, np.zeros(len(m.languages), np.float32)
        while p < len(w):
            for k in range(min(LONGEST, len(w) - p), 0, -1):
                g = m.grams.get(w[p : p + k])
                if g is not None:
                    total = total + m.log_grams[g]
                    break
            else:
                k = 1
                total = total + self.floor
            p += k
        return total - total.max()


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns named in keep, of which the text may be one."""
    docs = texts(docs, *(c for c in keep if c != "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            langs, out = [], []
            for text in batch.column("text").to_pylist():
                words = WORD.findall(text.lower()) if text else []
                if not words or not model.languages:
                    langs.append(UNKNOWN)
                    out.append(0.0)
                    continue
                if len(scores) > REMEMBERED:
                    scores = Scores(model)
                at = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
                total = scores.rows[at].mean(0, dtype=np.float64) * min(len(words), ENOUGH)
                best = int(total.argmax())
                langs.append(model.languages[best])
                out.append(1 / sum(math.exp(x - total[best]) for x in total))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(out, pa.float64()), *(batch.column(c) for c in keep)], ["doc_id", "lang_pred", "score", *keep])

    return in_batches(docs, run, with_fields("doc_id long, lang_pred string, score double", docs, keep))
