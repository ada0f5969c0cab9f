"""Document fingerprints by winnowing.

The rolling hashes of all character k-grams are cut into windows; each window keeps its smallest
hash, the rightmost of equal ones, with its position. Two texts that share a passage of
``K + WINDOW - 1`` characters share a fingerprint from it; positions tell where. A text shorter than a
k-gram has one hash of its whole, an empty or null one has none. Very long texts are hashed in
blocks. Repeated rows have a fingerprint each; other columns pass through only where they are asked
for by name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, texts, with_fields

K = 16
WINDOW = 16
BLOCK = 1 << 20
#: Ranges of ids at most: their first ids go to the driver. Rows stream, so a range may be long.
MOST_RANGES = 10_000
#: The hash keeps the upper bits; the lower ones order equal hashes in a block by position.
LOW = np.uint64((1 << 21) - 1)
BASE = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of every k-gram: sums of powers, joined from halves, then spread."""
    h, size, have, power = points.astype(np.uint64) + np.uint64(1), 1, None, BASE
    left, base = k, 0
    while left:
        if left & 1:
            part = h[base : base + max(0, len(points) - k + 1)]
            have = part if have is None else have * np.uint64(power) + part
            base += size
        left >>= 1
        if left:
            h = h[: len(h) - size] * np.uint64(power) + h[size:] if len(h) > size else h[:0]
            size, power = size * 2, power * power & (1 << 64) - 1
    x = have
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest key of each window, by doubling."""
    size, low = 1, keys
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = window - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions that the windows select, by position."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = code_points(text)
    if len(points) < k:
        return np.array([int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")], np.uint64) & ~LOW, np.zeros(1, np.int64)
    hashes, places = [], []
    grams = len(points) - k + 1
    for start in range(0, max(1, grams - window + 1), BLOCK):
        some = points[start : start + BLOCK + window - 1 + k - 1]
        h = gram_hashes(some, k) & ~LOW
        low = window_minima(h | (LOW - np.arange(len(h), dtype=np.uint64)), min(window, len(h)))
        picked = low[np.append(True, low[1:] != low[:-1])]
        hashes.append(picked & ~LOW)
        places.append((LOW - (picked & LOW)).astype(np.int64) + start)
    h, p = np.concatenate(hashes), np.concatenate(places)
    new = np.append(True, p[1:] != p[:-1])
    return h[new], p[new]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(prints: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex digest of the selected hashes with their positions."""
    return hashlib.sha256(prints[0].astype(">u8").tobytes() + prints[1].astype(">i8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id with the selected hashes (as signed numbers) and their positions; no shuffle."""
    docs = texts(docs, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [winnow(t or "") for t in batch.column("text").to_pylist()]
            cols = [batch.column("doc_id"), pa.array([h.view(np.int64) for h, _ in out], pa.list_(pa.int64())), pa.array([p for _, p in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(c) for c in keep], ["doc_id", "hashes", "positions", *keep])

    return in_batches(docs, run, with_fields("doc_id long, hashes array<long>, positions array<long>", docs, keep))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the following text as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successors(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of doc_id and text dealt into ranges of doc_id, each range followed by the first row of
    the next one (the first of all after the last), marked by ``lead``; sorted within partitions.

    Ranges come from quantiles of the ids, so texts move once; what goes to the driver is one id
    for each range, and tasks look ranges up by binary search. A range is a partition.
    """
    cuts = np.array(sorted(set(docs.stat.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else [], np.int64)

    def places(ids: pa.Array) -> np.ndarray:
        """Range 0 holds nulls and what is at most the first cut."""
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, ids.fill_null(0).to_numpy(), "left"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(batch.column(0)), pa.int32()), batch.column(0)], ["bucket", "doc_id"])

    by_range = in_batches(docs.select("doc_id"), least, "bucket int, doc_id long").groupBy("bucket")
    firsts = by_range.agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()
    first = [None if r["nulls"] else r["first"] for r in firsts]
    lent = {f: firsts[k - 1]["bucket"] for k, f in enumerate(first)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "bucket", "lead"]
        for batch in batches:
            own = places(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(own, pa.int32()), pa.array(np.zeros(len(own), bool))], names)
            ids = batch.column("doc_id").to_pylist()
            if again := [k for k, doc in enumerate(ids) if doc in lent]:
                some = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), pa.array([lent[ids[k]] for k in again], pa.int32()), pa.array([True] * len(again))], names)

    return in_batches(docs, deal, "doc_id long, text string, bucket int, lead boolean").repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "lead", "doc_id", "text")


def compare_edits(docs: DataFrame, rows_a_range: int = 4_000) -> DataFrame:
    """Per document the fingerprints of its text and of its edited text (see ``edited``), and how
    alike the text's is to the edited text's and to the next document's, by ascending doc_id; after
    the last comes the first. Null ids sort first, equal ids by text; of equal rows each follows the
    one before. The fingerprint is a digest of the selected hashes with their positions, which
    ``fingerprints`` returns themselves."""
    docs = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // rows_a_range)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for doc, text, bucket, lead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "lead"))):
                if held and held[0] != bucket:
                    held = None
                if lead and not held:
                    continue
                prints = winnow(text)
                if held:
                    _, own, before, its = held
                    changed = edited(before, text)
                    theirs = winnow(changed) if changed != before else its
                    out.append((own, len(before), hashlib.sha256(changed.encode()).hexdigest(), digest(its), digest(theirs), likeness(its[0], theirs[0]), likeness(its[0], prints[0])))
                held = None if lead else (bucket, doc, text, prints)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return in_batches(with_successors(docs, ranges), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
