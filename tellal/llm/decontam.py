"""Benchmark decontamination by q-gram filtering and banded alignment.

An item of m characters, aligned with at most e edits, keeps m - q + 1 - q e of its q-grams, all on
diagonals that are no more than e apart (the q-gram lemma). Shared q-grams of a document and an item
are counted in overlapping bands of diagonals; a band that reaches the bound marks a region, and an
alignment that keeps to the band decides it. Case and runs of white space do not count as
differences. An item counts where the whole of it occurs, however long it is. With ``excerpt`` given, a
stretch of so many characters of any item is enough: an item is then searched as overlapping segments of
two thirds of that, of which every such stretch holds one; shorter items as a whole.

At most ``EDIT_RATE`` of an item's (or segment's) characters may differ, and no more than the lemma's
bound allows: an item under two q-grams must occur as it is, as must one shorter than a q-gram. A
text that is null, empty or shorter than every item matches nothing; very long texts are searched
whole. Items without text match nothing; items of equal text each match, and an item without an
item_id does so with a null one. Of equally good places of an item in a document the band with most
shared q-grams counts. Rows repeat in the result as often as in the input; other columns, whatever
their names, are left as they are by ``drop_leaks`` and not looked at by ``find_leaks``. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored, texts
from .winnow import code_points, gram_hashes

Q = 8
#: Edits allowed per character of an item.
EDIT_RATE = 0.08
#: Characters of benchmark text that go to the tasks at once; a larger benchmark goes in blocks.
BLOCK_CHARS = 2_000_000
#: A first look-up in a bit table of 2 ** TABLE_BITS entries.
TABLE_BITS = 23
SPACE = 32


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with single spaces, and where each stood in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    points = code_points(low).copy()
    white = (points == SPACE) | ((points >= 9) & (points <= 13)) | (points == 0xA0) | (points == 0x3000)
    points[white] = SPACE
    use = ~white
    use[1:] |= white[1:] & ~white[:-1]
    at = np.flatnonzero(use)
    if len(at) and points[at[-1]] == SPACE:
        at = at[:-1]
    return points[at], at


def allowed(m: int) -> int:
    """The edit budget of an item of m characters, such that the q-gram bound stays positive."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q))


@dataclass
class Items:
    """The q-grams of a block of benchmark items."""

    ids: list[int]
    points: list[np.ndarray]
    excerpt: int | None = None

    def __post_init__(self):
        cut = [(k, part) for k, p in enumerate(self.points) for part in segments(p, self.excerpt)]
        #: Of each pattern, the number of its item.
        self.of = [k for k, _ in cut]
        self.points = [part for _, part in cut]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([allowed(len(p)) for p in self.points], np.int64)
        self.bound = self.size - Q + 1 - Q * self.edits
        self.tiny = [k for k, p in enumerate(self.points) if len(p) < Q]
        own = [gram_hashes(p, Q) if len(p) >= Q else np.zeros(0, np.uint64) for p in self.points]
        item = np.repeat(np.arange(len(own)), [len(h) for h in own])
        place = np.concatenate([np.arange(len(h)) for h in own]) if own else np.zeros(0, np.int64)
        h = np.concatenate(own) if own else np.zeros(0, np.uint64)
        by = np.argsort(h, kind="stable")
        self.gram, first = np.unique(h[by], return_index=True)
        self.item, self.place = item[by], place[by]
        self.start = np.append(first, len(h))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        large = self.size >= Q
        self.reach = int((self.size + self.edits)[large].max(initial=0))
        self.least = int(self.bound[large].min()) if large.any() else 0
        #: Wide enough that every band of diagonals, overlapping by the edits, holds an alignment.
        self.band = 1 << max(4, int(self.edits.max(initial=0)).bit_length())

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document's q-grams that some item has, in stretches dense enough to matter."""
        none = np.zeros(0, np.int64)
        if len(points) < Q or not len(self.gram):
            return none, none
        h = gram_hashes(points, Q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        at = at[self.dense(at)]
        if not len(at):
            return none, none
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        real = self.gram[k] == h[at]
        at, k = at[real], k[real]
        use = self.dense(at)
        return at[use], k[use]

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Which places lie within the reach of an alignment together with as many as any bound asks for."""
        n = max(1, self.least)
        if len(at) < n:
            return np.zeros(len(at), bool)
        full = at[n - 1 :] - at[: len(at) - n + 1] < self.reach
        use = np.zeros(len(at) + 1, np.int64)
        use[: len(full)] += full
        use[n : n + len(full)] -= full
        return np.cumsum(use[:-1]) > 0

    def regions(self, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, least diagonal, largest diagonal) of the bands that reach an item's bound."""
        at, gram = self.hits(points)
        if not len(at):
            return
        many = self.start[gram + 1] - self.start[gram]
        k = np.repeat(self.start[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, diagonal = self.item[k], np.repeat(at, many) - self.place[k] + self.reach
        band, inside = diagonal // self.band, diagonal % self.band
        again = inside < self.edits[item]
        span = (len(points) + 2 * self.reach) // self.band + 2
        key = np.concatenate([item * span + band + 1, (item * span + band)[again]])
        found, count = np.unique(key, return_counts=True)
        ok = count >= self.bound[found // span]
        for x in found[ok][np.argsort(-count[ok], kind="stable")]:
            b = int(x % span) - 1
            yield int(x // span), b * self.band - self.reach, (b + 1) * self.band + int(self.edits[x // span]) - self.reach

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, begin, end, edits) of the best alignment of each item, in characters of the text."""
        points, where = normalised(text or "")
        best: dict[int, tuple[int, int, int]] = {}
        for k, low, high in self.regions(points):
            item = self.of[k]
            if item in best and not best[item][2]:
                continue
            found = align(self.points[k], points, low, high, int(self.edits[k]))
            if found and (item not in best or found[2] < best[item][2]):
                best[item] = found
        for k in self.tiny:
            at = place_of(self.points[k], points)
            if at >= 0:
                best[self.of[k]] = (at, at + len(self.points[k]), 0)
        return [(self.ids[k], int(where[a]), int(where[b - 1]) + 1, e) for k, (a, b, e) in sorted(best.items()) if b > a]


def segments(points: np.ndarray, excerpt: int | None = None) -> list[np.ndarray]:
    """An item's patterns: itself, or, where excerpts count, its segments, the last one up to its end."""
    if not excerpt or len(points) <= excerpt:
        return [points] if len(points) else []
    stride = excerpt // 3 or 1
    size = max(1, excerpt - stride)
    return [points[k : k + size] for k in [*range(0, len(points) - size, stride), len(points) - size]]


def place_of(pattern: np.ndarray, points: np.ndarray) -> int:
    """Where the pattern first occurs as it is, or -1."""
    data, sought = points.tobytes(), pattern.tobytes()
    at = data.find(sought)
    while at >= 0 and at % 4:
        at = data.find(sought, at + 1)
    return at // 4 if at >= 0 else -1


def align(pattern: np.ndarray, points: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of where the whole pattern lies in the points with fewest edits, by
    alignments on the diagonals from low up to high; None if more than ``most`` are needed."""
    down = last_row(pattern, points, low, high, most)
    if down is None or down.min() > most:
        return None
    k = int(down.argmin())
    end, edits = len(pattern) + low + k, int(down[k])
    part = points[max(0, end - len(pattern) - edits) : end][::-1]
    back = last_row(pattern[::-1], part, -edits, edits + 1, edits, anchored=True)
    return end - (len(pattern) - edits + int(back.argmin())), end, edits


#: More than any distance.
FAR = 1 << 40


def last_row(pattern: np.ndarray, points: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> np.ndarray | None:
    """For each diagonal d from low up to high the edit distance of the pattern to what ends at
    len(pattern) + d in the points and begins anywhere, or, if anchored, at their start. Only cells
    of these diagonals are computed. None as soon as all exceed ``most``."""
    n, width = len(points), high - low
    steps = np.arange(width)
    starts = steps + low
    row = np.where((starts < 0) | (starts > n), FAR, np.where(anchored, starts, 0))
    # no character is the pad's
    pad = np.full(max(0, -low) + 1, 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([pad, points[: max(0, len(pattern) + high)], np.full(max(0, len(pattern) + high - n) + 1, 0xFFFFFFFF, np.uint32)])
    for i, c in enumerate(pattern, 1):
        if i % 16 == 0 and row.min() > most:
            return None
        begin = len(pad) + i + low - 1
        now = row + (padded[begin : begin + width] != c)
        now[:-1] = np.minimum(now[:-1], row[1:] + 1)
        now = np.minimum.accumulate(now - steps) + steps
        now[max(0, n - i - low + 1) :] = FAR
        row = now
    return row


def item_blocks(benchmark: DataFrame) -> tuple[int, Callable[[int], tuple[list[int], list[np.ndarray]]]]:
    """In how many blocks of a bounded size the benchmark goes, and how one of them is fetched."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text")).cast("long")).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))

    def fetch(k: int) -> tuple[list[int], list[np.ndarray]]:
        rows = sorted(((r["item_id"], r["text"]) for r in items.where(part == k).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        return [r[0] for r in rows], [normalised(r[1])[0] for r in rows]

    return blocks, fetch


def find_leaks(docs: DataFrame, benchmark: DataFrame, excerpt: int | None = None) -> DataFrame:
    """doc_id, item_id, begin, end and edits of every item, or excerpt of one, that a document holds. One pass for each
    block of the benchmark; the result of one is written before the next is fetched, so that the
    driver holds one block."""
    docs = texts(docs)
    names, schema = ["doc_id", "item_id", "begin", "end", "edits"], "doc_id long, item_id long, begin long, end long, edits int"

    def search(ids: list[int], points: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(ids, points, excerpt)
            for batch in batches:
                rows = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in items.matches(text)]
                types = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        return in_batches(docs, run, schema)

    blocks, fetch = item_blocks(benchmark)
    found = [stored(search(*fetch(k))) if blocks > 1 else search(*fetch(k)) for k in range(blocks)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, excerpt: int | None = None) -> DataFrame:
    """The documents that hold no benchmark item, or excerpt of one, with all their columns."""
    text_at, schema = docs.columns.index("text"), docs.schema

    def without(docs: DataFrame, ids: list[int], points: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(ids, points, excerpt)
            for batch in batches:
                clean = [not items.matches(text) for text in batch.column(text_at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return in_batches(docs, run, schema)

    blocks, fetch = item_blocks(benchmark)
    for k in range(blocks):
        docs = without(docs, *fetch(k))
        docs = stored(docs) if blocks > 1 else docs
    return docs
