"""Quality classifier that compares compressed sizes.

Two zstandard dictionaries hold labelled text, one of good and one of bad documents. A text is cut
into blocks; each is compressed with either dictionary, and the difference of the two sums over
their total, a number that needs no length, becomes a score by logistic calibration.

A model is fitted on a bounded sample: at most ``SAMPLE`` labelled documents of each label, of a
longer one a slice of ``SAMPLE_CHARS`` characters from somewhere in it, so the driver sees at most
2 * SAMPLE * SAMPLE_CHARS characters. Rows that share a doc_id count once there, with the text that
sorts first and the higher label. Scoring reads every whole text, however long, without a shuffle;
repeated rows and rows without a doc_id are scored like others. A null or empty text gets the base
rate of label 1; with one label only, every score is that label's. An empty table gives an empty
result, and columns are passed on only where they are named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, texts, with_fields

SAMPLE = 1500
SAMPLE_CHARS = 20_000
BLOCK = 160
DICTIONARY = 224 << 10
SLICE = 256
LEVEL = 6


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    base: float

    def compressors(self) -> tuple:
        made = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)


def difference(text: str, compressors: tuple) -> float | None:
    """Compressed with the bad dictionary minus with the good one, over both; None without text."""
    data = text.encode()
    if not data.strip() or not compressors:
        return None
    good, bad = compressors
    g = b = 0
    for k in range(0, len(data), BLOCK):
        block = data[k : k + BLOCK]
        g += len(good.compress(block))
        b += len(bad.compress(block))
    return (b - g) / (b + g)


def dictionary(samples: list[str], others: list[str], size: int | None = None) -> bytes:
    """Slices of all samples in turn, spread over their whole length, until the dictionary is full.
    Lines that the other label's samples have too say nothing about the label and are left out."""
    size, shared = size or DICTIONARY, {line for t in others for line in t.split("\n")}
    data = [d for t in samples if (d := "\n".join(x for x in t.split("\n") if x not in shared).encode()).strip()]
    out, total, k = [], 0, 0
    while total < size and any(len(d) > k * SLICE for d in data):
        for n, d in enumerate(data):
            parts = -(-len(d) // SLICE)
            if k < parts and total < size:
                at = (k + n) % parts * SLICE
                out.append(d[at : at + SLICE])
                total += len(out[-1])
        k += 1
    return b"".join(out)[:size]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a light ridge."""
    scale = max(1e-6, float(np.std(x)))
    a, w = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """docs: doc_id, text; labels: doc_id and the 0/1 label. Half of the sample fills the
    dictionaries, the other half calibrates; weights restore the labels' true shares."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not counts:
        return QualityModel(b"", b"", 0.0, 0.0, 0.5)
    base = counts.get(1, 0) / sum(counts.values())
    rows = []
    for y in sorted(counts):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        found = texts(docs).where(F.length("text") > 0).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
        begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
        rows += sorted(map(tuple, found.select("doc_id", F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)), "y").collect()))
    ys = {y for _, _, y in rows}
    if len(ys) < 2:
        return QualityModel(b"", b"", 0.0, 0.0, base)
    own = {y: [t for _, t, v in rows if v == y] for y in ys}
    model = QualityModel(dictionary(own[1][::2] or own[1], own[0]), dictionary(own[0][::2] or own[0], own[1]), 1.0, 0.0, base)
    made = model.compressors()
    held = [(t, y) for y in (0, 1) for t in (own[y][1::2] or own[y])]
    pairs = [(d, y) for t, y in held if (d := difference(t, made)) is not None]
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    share = np.where(y == 1, base / max(1, (y == 1).sum()), (1 - base) / max(1, (y == 0).sum())) * len(y)
    model.slope, model.shift = calibrate(x, y, share)
    return model


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns named in keep."""
    docs = texts(docs, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.compressors() if model.good and model.bad else ()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                d = difference(text or "", made)
                out.append(model.base if d is None else float(1 / (1 + np.exp(-np.clip(model.slope * d + model.shift, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), *(batch.column(c) for c in keep)], ["doc_id", "score", *keep])

    return in_batches(docs, run, with_fields("doc_id long, score double", docs, keep))
