"""Hard negatives by a vertical scan of columnar vectors (BOND).

Rows are laid out in blocks, dimension by dimension, each block with the least and the greatest value
of every dimension. For an anchor the dimensions of a block are read in the order of the anchor's
descending magnitudes. What the dimensions not read yet can contribute lies between two sums of those
extremes, so every candidate has a lower and an upper bound, and the bitmap of candidates shrinks
whenever dimensions have been read: first to those that may be among the nearest of the anchor's own
label, then to those that may be among the best of a window below one of its positives. What is left
when all dimensions are read is exact.

Anchors meet rows in cells of two blocks of bounded size, dealt by both, so no task holds more,
whatever the labels' or vectors' frequencies are; a cell returns a few rows for each of its anchors.
Rows of one label lie together, so positives are only sought in cells whose labels meet.

Rows with a null label or vector, or with a null or non-finite component, take no part. A component x
counts as floor(256 * x), kept within ``component_bound``, so that an inner product fits 64 bits; vectors of different lengths are compared as if the shorter ended in zeros, and
an empty one scores 0 with every other. Every row is a row of its own: equal rows are each other's
positives, and of anchors that occur twice each has results. Rows without a vec_id are no anchors and
come last among ties. An anchor without positives or negatives has no rows; neither has an empty table.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, stored

#: Rows and anchors of a block at most, and about how many components.
ROWS, ANCHORS, COMPONENTS = 8192, 2048, 1 << 22
#: Dimensions that are read between two looks at the bounds.
STEP = 8
SCALE = 256
#: Bits of a block's number that count within its part, and of a row's that count within its block.
PART, ROWS_BITS = 24, 13
BLOCK = "block long, n int, dims int, kinds array<long>, labels binary, ids binary, uids binary, data binary, wide int"
NO_ID = np.iinfo(np.int64).max


def component_bound(dims: np.ndarray) -> np.ndarray:
    """The magnitude to which components are kept, so that a product of dims of them fits 64 bits."""
    return np.floor(np.sqrt(2.0**62 / np.maximum(dims, 1)))


def quantised(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors take part, and the offsets and whole components of those that do."""
    finite = np.isfinite(values)
    wrong = np.concatenate([[0], np.cumsum(~finite)])
    part = wrong[offsets[1:]] == wrong[offsets[:-1]]
    size = np.diff(offsets)
    most = np.repeat(component_bound(size), size)
    used = np.repeat(part, size)
    whole = np.clip(np.floor(values[used] * SCALE), -most[used], most[used]).astype(np.int64)
    return part, np.concatenate([[0], np.cumsum(size[part])]), whole


class Block:
    """Rows of a block, sorted by label: x[d, k] is component d of row k."""

    def __init__(self, row: dict):
        self.n, self.dims = row["n"], row["dims"]
        self.labels, self.ids, self.uids = (np.frombuffer(row[c], np.int64) for c in ("labels", "ids", "uids"))
        self.x = np.frombuffer(row["data"], f"i{row['wide']}").reshape(self.dims, self.n)


def packed_rows(frames: list[tuple[np.ndarray, ...]], dims: int, block: int) -> dict:
    """A block's columns, from (ids, labels, uids, offsets, values) of several batches."""
    ids, labels, uids = (np.concatenate([f[k] for f in frames]) for k in range(3))
    x, at = np.zeros((len(ids), dims), np.int64), 0
    for _, _, _, offsets, values in frames:
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        x[at + row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)] = values
        at += len(size)
    order = np.lexsort((uids, ids, labels))
    most = int(np.abs(x).max(initial=0))
    wide = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    uids = uids if len(uids) and uids[0] >= 0 else (block << ROWS_BITS) + np.arange(len(ids))[np.argsort(order)]
    return dict(block=block, n=len(ids), dims=dims, kinds=np.unique(labels), labels=labels[order].tobytes(), ids=ids[order].tobytes(), uids=uids[order].tobytes(), data=x[order].T.astype(f"i{wide}").tobytes(), wide=wide)


BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("kinds", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("labels", "ids", "uids", "data")), ("wide", pa.int32())])


def row_blocks_of(rows: DataFrame) -> DataFrame:
    """rows (vec_id, label, embedding) in blocks, cut off from their lineage, of one label or neighbouring ones."""
    parts = max(1, -(-rows.count() // ROWS))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("label is not null and v is not null").repartitionByRange(parts, "label", F.xxhash64("vec_id", "v"))
    return blocks(rows.withColumn("part", F.spark_partition_id()), ROWS, numbered=False)


def anchor_blocks_of(anchors: DataFrame) -> DataFrame:
    """Anchors in blocks of their own, those of neighbouring blocks of rows together."""
    parts = F.floor((F.shiftright("uid", PART + ROWS_BITS)) * ROWS / (ANCHORS * 50)).cast("int")
    return blocks(anchors.withColumn("part", parts).repartition("part"), ANCHORS, numbered=True)


def blocks(rows: DataFrame, most: int, numbered: bool) -> DataFrame:
    """Blocks of at most ``most`` rows of one part, numbered by part and place in it. Numbered rows have a
    uid and whole components, the others get both here."""
    rows = rows.select("part", "vec_id", "label", "v", *["uid"] * numbered).sortWithinPartitions("part", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, frames, held, values = None, 0, [], 0, 0

        def block() -> pa.RecordBatch:
            dims = max(int(np.diff(f[3]).max(initial=0)) for f in frames)
            return pa.RecordBatch.from_pylist([packed_rows(frames, dims, (now << PART) + made)], BLOCK_ARROW)

        for batch in batches:
            k = 0
            parts = batch.column("part").to_numpy()
            while k < batch.num_rows:
                if parts[k] != now:
                    if held:
                        yield block()
                    now, made, frames, held, values = int(parts[k]), 0, [], 0, 0
                end = int(np.searchsorted(parts, now, "right"))
                part = batch.slice(k, min(most - held, end - k))
                k += part.num_rows
                v = part.column("v")
                offsets, x = np.asarray(v.offsets), v.flatten().to_numpy(zero_copy_only=False)
                offsets = offsets - offsets[0]
                ids, labels = (part.column(c).fill_null(NO_ID).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                if numbered:
                    uids = part.column("uid").to_numpy(zero_copy_only=False)
                else:
                    use, offsets, x = quantised(offsets, x.astype(np.float64))
                    ids, labels = ids[use], labels[use]
                    uids = np.full(len(ids), -1)
                if not len(ids):
                    continue
                frames.append((ids, labels, uids, offsets, x))
                held, values = held + len(ids), values + len(x)
                if held == most or values >= COMPONENTS:
                    yield block()
                    made, frames, held, values = made + 1, [], 0, 0
        if held:
            yield block()

    return stored(in_batches(rows, run, BLOCK))


def anchors_of(row_blocks: DataFrame, every: int) -> DataFrame:
    """The rows of blocks whose vec_id is divisible by every, as rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                at = np.flatnonzero((b.ids % every == 0) & (b.ids != NO_ID))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(b.uids[at]), pa.array(list(b.x[:, at].T.astype(np.int64)), pa.list_(pa.int64()))],
                    ["vec_id", "label", "uid", "v"],
                )

    return in_batches(row_blocks, run, "vec_id long, label long, uid long, v array<long>")


class Scan:
    """The scans of one block's rows for anchors of another."""

    def __init__(self, rows: Block, anchors: Block):
        self.rows = rows
        dims = min(rows.dims, anchors.dims)
        self.low, self.high = rows.x[:dims].min(axis=1).astype(np.int64), rows.x[:dims].max(axis=1).astype(np.int64)
        most = np.maximum(np.abs(self.low), np.abs(self.high)).astype(np.float64) @ np.abs(anchors.x[:dims]).max(axis=1).astype(np.float64) if dims else 0.0
        # the narrowest numbers in which every partial sum is exact
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.x = rows.x[:dims].astype(self.kind)
        self.q = anchors.x[:dims].astype(self.kind)
        self.low, self.high = self.low.astype(self.kind), self.high.astype(self.kind)

    def order(self, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor a's components by descending magnitude, their dimensions, and the least and the greatest
        sum of what is not read yet, before each of them and at the end."""
        q = self.q[:, a]
        dims = np.argsort(-np.abs(q), kind="stable")
        q = q[dims]
        ends = q * self.low[dims], q * self.high[dims]
        rest = [np.append(np.cumsum(f(*ends)[::-1])[::-1], 0).astype(self.kind) for f in (np.minimum, np.maximum)]
        return q, dims, rest[0], rest[1]

    def read(self, a: int, live: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that useful(lower, upper) never rules out, and their exact scores."""
        q, dims, least, most = self.order(a)
        score = np.zeros(len(live), self.kind)
        for k in range(0, len(q), STEP):
            keep = useful(score + least[k], score + most[k])
            if not keep.all():
                live, score = live[keep], score[keep]
                if not len(live):
                    return live, score
            some = dims[k : k + STEP]
            part = self.x[some] if len(live) == self.rows.n else self.x[some[:, None], live]
            score = score + q[k : k + STEP] @ part
        keep = useful(score, score)
        return live[keep], score[keep].astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, ties by smaller id."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        few = np.flatnonzero(scores >= least)
        return few[np.lexsort((ids[few], -scores[few]))][:most]
    return np.lexsort((ids, -scores))


def same_label(rows: Block, label: int) -> tuple[int, int]:
    return int(np.searchsorted(rows.labels, label)), int(np.searchsorted(rows.labels, label, "right"))


def nearest(scan: Scan, anchors: Block, a: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's rows of anchor a's label, without itself, that score highest."""
    rows = scan.rows
    live = np.arange(*same_label(rows, anchors.labels[a]))
    live = live[rows.uids[live] != anchors.uids[a]]

    def useful(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= np.partition(lower, len(lower) - most)[len(lower) - most] if len(lower) > most else np.ones(len(lower), bool)

    live, scores = scan.read(a, live, useful)
    at = best(scores, rows.ids[live], most)
    return live[at], scores[at]


def in_windows(scan: Scan, anchors: Block, a: int, windows: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window (least, greatest score) the block's rows of other labels in it that score highest."""
    rows = scan.rows
    begin, end = same_label(rows, anchors.labels[a])
    live = np.concatenate([np.arange(begin), np.arange(end, rows.n)])
    least, greatest = windows[:, 0].astype(scan.kind), windows[:, 1].astype(scan.kind)

    def useful(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        near = np.flatnonzero(upper >= least.min())
        lower, upper = lower[near], upper[near]
        for w in range(len(least)):
            reach = least[w]
            sure = lower[(lower >= reach) & (upper <= greatest[w])]
            if len(sure) > most:
                reach = np.partition(sure, len(sure) - most)[len(sure) - most]
            keep[near[(upper >= reach) & (lower <= greatest[w])]] = True
        return keep

    live, scores = scan.read(a, live, useful)
    for w, (low, high) in enumerate(windows):
        there = np.flatnonzero((scores >= low) & (scores <= high))
        at = there[best(scores[there], rows.ids[live[there]], most)]
        if len(at):
            yield w, live[at], scores[at]


def part_of(block: str) -> F.Column:
    """The partition in which a block was made."""
    return F.shiftright(block, PART)


def cells(row_blocks: DataFrame, anchor_blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: block, part. Each block of rows beside each block of anchors of that part, as a struct, dealt
    by both: a row of the result is what one call of a scan holds."""
    n = 2 * max(1, min(row_blocks.count() * anchor_blocks.count(), 10_000))
    held = anchor_blocks.select(part_of("block").alias("part"), F.struct(*anchor_blocks.columns).alias("anchors"))
    left, right = row_blocks.join(pairs, "block"), held.join(pairs, "part")
    if n > int(row_blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = (x.repartition(n, "block", "part") for x in (left, right))
    # few cells go with the join's own shuffle, whose empty partitions are put together
    return left.join(right.hint("merge"), ["block", "part"]).drop("part")


def find_positives(row_blocks: DataFrame, anchor_blocks: DataFrame, most: int) -> DataFrame:
    """uid of an anchor, k (from 0), positive_id, positive_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, anchors = Block(row), Block(row["anchors"])
                scan, out = Scan(rows, anchors), []
                for a in range(anchors.n):
                    at, scores = nearest(scan, anchors, a, most)
                    out.append((np.full(len(at), anchors.uids[a]), rows.ids[at], scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["uid", "id", "score"])

    theirs = anchor_blocks.select(part_of("block").alias("part"), F.explode("kinds").alias("label")).distinct()
    pairs = row_blocks.select("block", F.explode("kinds").alias("label")).join(theirs, "label").select("block", "part").distinct()
    found = in_batches(cells(row_blocks, anchor_blocks, pairs), run, "uid long, id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    top = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return top.select("uid", (F.col("k") - 1).alias("k"), F.when(F.col("id") != NO_ID, F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))


def find_negatives(row_blocks: DataFrame, anchor_blocks: DataFrame, positives: DataFrame, least: int, greatest: int, most: int) -> DataFrame:
    """uid, k, negative_id, negative_score, rank of what lies between least and greatest hundredths of a positive's score."""
    held = positives.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "positive_score"))).alias("p"))
    members = anchor_blocks.select("block", "uids")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids = np.frombuffer(row["uids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uids), row["block"])), pa.array(uids)], ["block", "uid"])

    sought = in_batches(members, expand, "block long, uid long").join(held, "uid").groupBy("block").agg(F.collect_list(F.struct("uid", "p")).alias("sought"))
    with_windows = anchor_blocks.join(sought, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, anchors, out = Block(row), Block(row["anchors"]), []
                scan = Scan(rows, anchors)
                place = {int(u): a for a, u in enumerate(anchors.uids)}
                for s in row["anchors"]["sought"]:
                    p, k = (np.array([x[c] for x in s["p"]], np.int64) for c in ("positive_score", "k"))
                    # whole scores n with least * p <= 100 * n <= greatest * p; in parts, so that nothing overflows
                    whole, rest = p // 100, p % 100
                    windows = np.stack([whole * least - (-rest * least // 100), whole * greatest + rest * greatest // 100], axis=1)
                    use = np.flatnonzero(windows[:, 0] <= windows[:, 1])
                    if not len(use):
                        continue
                    for w, at, scores in in_windows(scan, anchors, place[s["uid"]], windows[use], most):
                        out.append((np.full(len(at), s["uid"]), np.full(len(at), k[use[w]]), rows.ids[at], scores))
                cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cols[0], cols[1].astype(np.int32), cols[2], cols[3])], ["uid", "k", "id", "score"])

    parts = anchor_blocks.agg(F.max(part_of("block"))).first()[0] or 0
    pairs = row_blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts).cast("long"))).alias("part"))
    found = in_batches(cells(row_blocks, with_windows, pairs), run, "uid long, k int, id long, score long")
    order = Window.partitionBy("uid", "k").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.select("uid", "k", F.when(F.col("id") != NO_ID, F.col("id")).alias("negative_id"), F.col("score").alias("negative_score"), "rank")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, greatest: int = 95) -> DataFrame:
    """rows: vec_id, label, embedding. For each row whose vec_id is divisible by
    ``every`` and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    other labels whose score is between least and greatest hundredths of the positive's."""
    row_blocks = row_blocks_of(rows)
    chosen = stored(anchors_of(row_blocks, every))
    anchor_blocks = anchor_blocks_of(chosen)
    near = stored(find_positives(row_blocks, anchor_blocks, positives))
    far = find_negatives(row_blocks, anchor_blocks, near, least, greatest, negatives)
    named = chosen.select("uid", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["uid", "k"]).join(named, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
