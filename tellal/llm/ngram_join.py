"""Exact Jaccard join on word shingles by T-occurrence search, up to connected components.

1. Every text becomes a set of hashed shingles; equal sets are one class and go on as one, so
   copies cost a count.
2. Shingles have a fixed order: a sampled share of the hash range by how many classes have them,
   rarest first, those of very many classes last, then the rest by hash. Linked sets share one of the
   first ``n - need + 1`` shingles, the prefix (``need``: the overlap a set of n asks for). A class
   whose sampled shingles of its own alone fill the prefix links with nothing. The others' prefixes
   are inverted; classes on a common list are candidates.
3. Sets that common lists connect are searched together, with an inverted index of their shingles:
   each set is a query on the others; the short lists are heap-merged, skipping what cannot reach the
   count, the long ones are probed by binary search for what the short ones leave (DivideSkip), and
   sets that reach the overlap are linked. A candidate that is connected already needs no probe, and
   one whose first common shingle, rarest first, comes too late in either set for the overlap is left
   out beforehand (positions), so texts of one template that do not link are not merged.
   Where common lists connect more sets than a task can hold, they are searched in blocks, then
   delegates of the components found, and then, one by one, only those lists of the prefixes on which
   two components still meet, without the sets that come too late on a list for any size on it.
4. Links and classes give components.

Classes are told apart by 128 bits of a digest. Nulls and empty texts link with nothing and are their
own component. A text of fewer words than a shingle has one element, its whole sequence; a very long
one has a large set. Rows that share a doc_id and differ in text are searched each. Repeated rows
count once. Rows without a doc_id only join the component of a text equal to theirs. Other columns
are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hot
from .common import in_batches, stored, texts
from .components import as_stars, components

#: Documents and shingles in one block of sets that are searched together.
BLOCK_DOCS = 4000
BLOCK_SHINGLES = 1_500_000
#: Shingles that one task brings together.
BUCKET = 1_000_000
#: Buckets at least, so that a class's shared shingles fall into about as many rows at every size.
FEWEST = 64
#: A shingle of more classes can be a hot one.
HOT = 20_000
#: The count of hot shingles: they come last, in the order of their hashes.
VERY_MANY = np.uint32(0xFFFFFFFF)
#: The sampled share of the shingles, as a multiple of the share that linked sets may differ in.
SAMPLED = 2.0
#: DivideSkip's cost of one binary search against one step of the merge.
PROBE_COST = 0.0085
#: Documents that are compared at once, before the merge, with what may well be their copy.
GUESSES = 3
#: Documents that stand for a component when blocks are first joined.
DELEGATES = 8
#: Parts of a list whose members are looked up.
SALTS = 16
#: Ranges of sizes for each factor of e.
SIZE_RANGES = 50
REMEMBERED = 1_000_000
SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int, known: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes. ASCII letters are lower-cased; words end at ASCII white space."""
    h = word_hashes((text or "").encode().lower().split(), known)
    if not len(h):
        return h
    n = min(size, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = mixed(total + h[k : len(h) - n + 1 + k] * SEEDS[k % 5] + np.uint64(n * 31 + k))
    return np.unique(total)


def needed(n: int, threshold: Fraction) -> int:
    """Elements that a set of n shares with any set it links to."""
    return -(-threshold.numerator * n // threshold.denominator)


def split_sample(shingles: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The sampled shingles, and those that the prefix needs beyond them, if it is longer."""
    share = min(1.0, SAMPLED * (1 - float(threshold)) + 1e-3)
    rank = mixed(shingles + SEEDS[3])
    sampled = rank < np.uint64(int(share * (1 << 64) * (1 - 1e-12)))
    more = len(shingles) - needed(len(shingles), threshold) + 1 - int(sampled.sum())
    rest = ~sampled
    return shingles[sampled], shingles[rest][np.argsort(rank[rest], kind="stable")[: max(0, more)]] if len(shingles) else shingles


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def read_sets(docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """Per document: its text's hash, number of shingles, class, sampled shingles and those the prefix
    needs besides."""
    names = ["doc_id", "part", "n_shingles", "class", "sampled", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, size, known)
                sampled, late = split_sample(s, threshold)
                rows.append((len(s), class_of(s), sampled.tobytes(), late.tobytes() if len(late) else None))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    return in_batches(texts(docs).withColumn("part", F.xxhash64("text")), run, "doc_id long, part long, n_shingles long, class binary, sampled binary, late binary")


def numbers_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in batch.column(column).to_pylist() if x), np.uint64)


def shared_shingles(classes: DataFrame, total: int) -> DataFrame:
    """classes: node, sampled. Per node and bucket the sampled shingles that other classes have too,
    and how many have them. Hot shingles do not go to a bucket: where they are is known beforehand."""
    buckets = max(FEWEST, -(-total // BUCKET))
    frequent = hot.hot_keys(classes.select("sampled"), lambda batch: numbers_of(batch, "sampled"), total, HOT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            own = [np.frombuffer(b, np.uint64) for b in batch.column("sampled").to_pylist()]
            index = np.repeat(np.arange(len(node), dtype=np.uint16), [len(s) for s in own])
            sig = np.concatenate(own) if own else np.zeros(0, np.uint64)
            use = ~hot.among(sig, frequent)
            sig, index = sig[use], index[use]
            bucket = ((sig >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, index, bucket = sig[order], index[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(sig) else np.zeros(0, np.int64)
            out: list[list] = [[], [], []]
            for a, b in zip(cut, np.append(cut[1:], len(sig))):
                used, local = np.unique(index[a:b], return_inverse=True)
                out[0].append(sig[a:b].tobytes())
                out[1].append(local.astype(np.uint16).tobytes())
                out[2].append(node[used].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "sig", "index", "nodes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def shared() -> pa.RecordBatch:
            sig = np.concatenate([np.frombuffer(s, np.uint64) for s, _, _ in held])
            node = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(i, np.uint16)] for _, i, n in held])
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            cut = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            many = np.diff(np.append(cut, len(sig)))
            many = np.repeat(many, many)
            use = many > 1
            sig, node, many = sig[use], node[use], many[use].astype(np.uint32)
            order = np.argsort(node, kind="stable")
            return by_node(node[order], sig[order], many[order])

        for batch in batches:
            for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sig", "index", "nodes"))):
                if held and bucket != now:
                    yield shared()
                    held = []
                now = bucket
                held.append(blobs)
        if held:
            yield shared()

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b, np.uint64) for b in batch.column("sampled").to_pylist()]
            own = [s[hot.among(s, frequent)] for s in own]
            node = np.repeat(batch.column("node").to_numpy(), [len(s) for s in own])
            yield by_node(node, np.concatenate(own) if own else np.zeros(0, np.uint64), np.full(len(node), VERY_MANY))

    schema = "node long, shared binary, many binary"
    dealt = in_batches(classes.select("node", "sampled"), deal, "bucket long, sig binary, index binary, nodes binary")
    met = in_batches(dealt.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket"), meet, schema)
    return met.unionByName(in_batches(classes.select("node", "sampled"), stay, schema)) if len(frequent) else met


def by_node(node: np.ndarray, sig: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """node, shared, many: one row for each stretch of equal nodes."""
    cut = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[cut]), pa.array([sig[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([many[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], ["node", "shared", "many"])


def prefixes(classes: DataFrame, shared: DataFrame, threshold: Fraction) -> DataFrame:
    """node, signatures: the shingles of a class's prefix that another class may have, and rooms: what
    it can share with a class whose first common shingle, in the fixed order, is that one."""
    own = shared.groupBy("node").agg(F.collect_list(F.struct("shared", "many")).alias("parts"))
    rows = classes.join(own, "node", "left").where("parts is not null or late is not null").select("node", "n_shingles", "n_sampled", "late", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, out, rooms = [], [], []
            for node, n, n_sampled, late, parts in zip(*(batch.column(c).to_pylist() for c in ("node", "n_shingles", "n_sampled", "late", "parts"))):
                sig = np.frombuffer(b"".join(p["shared"] for p in parts or []), np.uint64)
                many = np.frombuffer(b"".join(p["many"] for p in parts or []), np.uint32)
                length = n - needed(n, threshold) + 1
                take = min(length, n_sampled) - (n_sampled - len(sig))
                if take > 0 or late:
                    nodes.append(node)
                    out.append(sig[np.lexsort((sig, many))[: max(0, take)]].tobytes() + (late or b""))
                    # shingles of its own come first, the late ones after all sampled ones
                    place = np.concatenate([n_sampled - len(sig) + np.arange(max(0, take)), n_sampled + np.arange(len(late or b"") // 8)])
                    rooms.append((n - place).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary()), pa.array(rooms, pa.binary())], ["node", "signatures", "rooms"])

    return in_batches(rows, run, "node long, signatures binary, rooms binary")


def candidate_edges(classes: DataFrame, total: int) -> DataFrame:
    """classes: node, signatures. Edges that connect the classes which share a signature. A task joins
    those it reads itself and sends one of them on, so a signature that very many have is no hot key."""
    buckets = max(1, -(-total // BUCKET))
    names = ["bucket", "sig", "owner", "a", "b"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> pa.RecordBatch:
            sig, owner = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            sig, owner, a, b = stars_by(sig, owner)
            bucket = ((sig >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, owner, bucket = sig[order], owner[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(sig) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(sig))
            # the edges found here travel with the signatures, in even parts
            parts = [np.linspace(0, len(a), len(cut) + 1).astype(int)[k : k + 2] for k in range(len(cut))]
            columns = [[x[i:j].tobytes() for i, j in zip(cut, ends)] for x in (sig, owner)] + [[x[i:j].tobytes() for i, j in parts] for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *(pa.array(x, pa.binary()) for x in columns)], names)

        for batch in batches:
            sigs = [np.frombuffer(b, np.uint64) for b in batch.column("signatures").to_pylist()]
            held.append((np.concatenate(sigs) if sigs else np.zeros(0, np.uint64), np.repeat(batch.column("node").to_numpy(), [len(s) for s in sigs])))
            n += len(held[-1][0])
            if n >= BUCKET:
                yield joined()
                held, n = [], 0
        if held:
            yield joined()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def edges() -> pa.RecordBatch:
            sig, owner, a, b = (np.concatenate([np.frombuffer(h[k], d) for h in held]) for k, d in enumerate((np.uint64, np.int64, np.int64, np.int64)))
            _, _, c, d = stars_by(sig, owner)
            a, b = as_stars(np.concatenate([a, c]), np.concatenate([b, d]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and bucket != now:
                    yield edges()
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield edges()

    dealt = in_batches(classes, deal, "bucket long, sig binary, owner binary, a binary, b binary")
    return in_batches(dealt.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket"), meet, "a long, b long")


def stars_by(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct signatures with their smallest owner, and edges that connect all owners of each."""
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    low = owner[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))] if len(sig) else owner
    return sig[first], owner[first], *as_stars(low[low != owner], owner[low != owner])


class Index:
    """Inverted lists of the sets of a block, smallest set first."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        n, self.docs = len(sets), len(sets)
        flat = np.concatenate(sets)
        _, element = np.unique(flat, return_inverse=True)
        self.element = np.split(element, np.cumsum(self.size)[:-1])
        doc = np.repeat(np.arange(n), self.size)
        #: Sorted by element, then by document: list e is keys[start[e]:start[e + 1]] - e * n.
        keys = element.astype(np.int64) * n + doc
        by_key = np.argsort(keys)
        self.keys = keys[by_key]
        self.length = np.bincount(element)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        #: What a key's document can share with one whose first common element, rarest first, is the key's.
        rarest = np.lexsort((element, self.length[element], doc))
        room = np.empty(len(flat), np.int64)
        room[rarest] = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(flat))
        self.room = room[by_key]

    def lists(self, elements: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents in [lo, hi) on the elements' lists, one list after the other, where each begins,
        and the places of their keys."""
        a = np.searchsorted(self.keys, elements * self.docs + lo)
        b = np.searchsorted(self.keys, elements * self.docs + hi)
        n = b - a
        begins = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(a - begins[:-1], n) + np.arange(begins[-1])
        return self.keys[at] - np.repeat(elements * self.docs, n), begins, at

    def probed(self, elements: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """On how many of the lists each document is."""
        want = (elements[:, None] * self.docs + docs[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want).reshape(len(elements), len(docs)).sum(0)


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """The documents on at least so many of the sorted lists, and on how many: a heap holds the lists'
    heads; where too few agree, as many lists jump to the next head that still can."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        doc, popped = heap[0][0], []
        while heap and heap[0][0] == doc:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found.append((doc, len(popped)))
            ahead = doc + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            ahead = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], ahead, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found


def search_links(sets: list[np.ndarray], threshold: Fraction, side: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets; with sides, what links between sides connect.
    Sets of equal group number are known to be connected."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    index = Index([sets[k] for k in order])
    sides = None if side is None else side[order]
    root = np.arange(len(sets)) if group is None else np.unique(group[order], return_inverse=True)[1]
    num, den = threshold.numerator, threshold.denominator
    links = []

    def linked(q: int, docs: np.ndarray, overlap: np.ndarray) -> None:
        for d in docs[(den + num) * overlap >= num * (index.size[q] + index.size[docs])]:
            if root[d] != root[q]:
                root[root == root[d]] = root[q]
                links.append((order[q], order[int(d)]))

    for q in range(1, len(sets)):
        n = int(index.size[q])
        need = -(-num * n // den)
        lo = int(np.searchsorted(index.size, need))
        if lo >= q or (root[lo:q] == root[q]).all():
            continue
        elements = index.element[q][np.argsort(index.length[index.element[q]], kind="stable")]
        docs, begins, at = index.lists(elements[: n - need + 1], lo, q)
        room = np.minimum(index.room[at], n - np.repeat(np.arange(n - need + 1), np.diff(begins)))
        docs = docs[(den + num) * room >= num * (n + index.size[docs])]
        docs = docs[root[docs] != root[q]]
        if sides is not None:
            docs = docs[sides[docs] != sides[q]]
        if not len(docs):
            continue
        able = np.zeros(q, bool)
        able[docs] = True
        longest = int(index.length[elements[-1]])
        skipped = min(need - 1, int(need / (PROBE_COST * math.log2(longest + 1) + 1)))
        short, long = np.sort(elements[: n - skipped]), elements[n - skipped :]
        docs, begins, _ = index.lists(short, lo, q)
        begins = np.concatenate([[0], np.cumsum(able[docs])])[begins]
        docs = docs[able[docs]]
        # the last set on a short list is likely a copy: once linked, its component needs no merge
        some = np.unique(docs[begins[1:][np.diff(begins) > 0] - 1])[-GUESSES:]
        linked(q, some, index.probed(elements, some))
        apart = root[docs] != root[q]
        ends = np.concatenate([[0], np.cumsum(apart)])[begins]
        docs = docs[apart].tolist()
        lists = [docs[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()) if b > a]
        found = sorted(merge_skip(lists, need - skipped), key=lambda x: -x[1])
        found, count = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
        step = 8
        while len(found):
            some, had = found[:step], count[:step]
            linked(q, some, had + (index.probed(long, some) if skipped else 0))
            found, count = found[step:], count[step:]
            apart = root[found] != root[q]
            found, count = found[apart], count[apart]
            step = min(256, step * 2)
    return links


def shard_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs: text, node and class, shard, block and blocks. The same with the shingles for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = WordHash(), ["node", "shard", "block", "blocks"]
        for batch in batches:
            own = [shingle_set(t, size, known) for t in batch.column("text").to_pylist()]
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], [*names, "n", "shingles"])
            yield made.filter(pa.array([class_of(s) == c for s, c in zip(own, batch.column("class").to_pylist())], pa.bool_()))

    return in_batches(docs.select("text", "node", "class", "shard", "block", "blocks"), run, "node long, shard long, block int, blocks int, n long, shingles binary")


def links_within(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """sets: node, shard, k1, k2, side, known, shingles, n. Links (a, b) that connect what is connected
    among the rows of equal (shard, k1, k2): between sides where side is not null, and but for what
    ``known``, the component so far, connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            sides = None if held[0][1] is None else np.array([h[1] for h in held])
            found = search_links([np.frombuffer(h[3], np.uint64) for h in held], threshold, sides, np.array([h[2] for h in held]))
            a, b = as_stars(*(np.array([held[f[k]][0] for f in found], np.int64) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for shard, k1, k2, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "k1", "k2", "node", "side", "known", "shingles"))):
                if held and now != (shard, k1, k2):
                    yield links()
                    held = []
                now = (shard, k1, k2)
                if not held or held[-1][0] != row[0]:
                    held.append(row)
        if held:
            yield links()

    rows = sets.select("shard", "k1", "k2", "n", "node", "side", "known", "shingles")
    return in_batches(rows.repartition("shard", "k1", "k2").sortWithinPartitions("shard", "k1", "k2", "n", "node"), run, "a long, b long")


def blocks_of(shingles: str) -> Column:
    """Blocks that the rows of a group need."""
    return F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(shingles) / BLOCK_SHINGLES)).cast("int")


def on_lists(chosen: DataFrame) -> DataFrame:
    """chosen: node, signatures, rooms, n, known, shard, block. One row for each node and signature (list)."""
    names = ["node", "n", "known", "shard", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.frombuffer(b, np.int64) for b in batch.column("signatures").to_pylist()]
            rooms = [np.frombuffer(b, np.int64) for b in batch.column("rooms").to_pylist()]
            n = [len(s) for s in sigs]
            rows = [np.repeat(batch.column(c).to_numpy(), n) for c in names]
            both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sigs, rooms)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, both), *map(pa.array, rows)], ["list", "room", *names])

    return in_batches(chosen.select("signatures", "rooms", *names), run, "list long, room long, node long, n long, known long, shard long, block int")


def links_on_lists(rows: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """rows: list, node, n, room, known (its component so far), shard, block; sets: node, n, shingles.
    Links that connect what is connected on each list, but for what is known.

    Two nodes need min(room) >= the overlap of their sizes on the first list that both are on. So a
    list's rooms and sizes are told in about a hundred ranges of sizes, and a node which none of them
    lets reach the overlap needs nothing on that list.
    Lists on which only one component is left need nothing. Of two nodes of different components on a
    list one is outside the list's largest component: such a node is a query to the other blocks that
    have a node on one of its lists, to each once, whichever lists lead there. A block with many
    queries gets them in parts.
    """
    sizes = rows.groupBy("list", "known").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("list").agg(F.max_by("known", F.struct("size", "known")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    ranges = rows.groupBy("list", F.floor(F.log("n") * SIZE_RANGES).alias("range")).agg(F.min("n").alias("n"), F.max("room").alias("room"))
    met = ranges.groupBy("list").agg(F.collect_list(F.struct("n", "room")).alias("met"))
    open_ = open_.join(met, "list").select("list", "largest", "met", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    num, both = threshold.numerator, threshold.numerator + threshold.denominator
    able = F.exists("met", lambda m: both * F.least("room", m["room"]) >= num * (F.col("n") + m["n"]))
    touched = stored(salted.join(open_, ["list", "salt"]).where(able).drop("salt", "met", "room", "n"))
    there = touched.select("list", F.col("block").alias("k1")).distinct()
    asking = touched.where("known <> largest").join(there, "list").where("k1 <> block").select("node", "known", "shard", "k1").distinct()
    probes = stored(asking.join(sets.select("node", "n"), "node"))
    parts = probes.groupBy("shard", "k1").agg(blocks_of("n").alias("parts"))
    asked = probes.join(parts, ["shard", "k1"]).select("shard", "k1", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("k2"), "node", F.lit(1).alias("side"), "known")
    members = touched.select("node", "known", "shard", F.col("block").alias("k1")).distinct().join(parts, ["shard", "k1"])
    against = members.select("shard", "k1", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k2"), "node", F.lit(0).alias("side"), "known")
    return links_within(asked.unionByName(against).join(sets.select("node", "n", "shingles"), "node"), threshold)


def shard_components(sets: DataFrame, chosen: DataFrame, threshold: Fraction) -> DataFrame:
    """Components of the links within shards (what common lists connect). A shard of one block is one
    search. In a larger one,

    1. every block is searched by itself;
    2. a few delegates of each component found are searched together, which joins most of what
       belongs together;
    3. the lists of the prefixes on which different components still meet are searched.

    Sets that link share a list of their prefixes, so no link is lost; lists of one group of near
    copies are done after the second step, and of a chain of lists that connects what does not link
    only blocks that a list connects are compared.
    """
    none = F.lit(None).cast("int").alias("side")
    alone = sets.select("shard", F.col("block").alias("k1"), F.lit(0).alias("k2"), "n", "node", none, F.col("node").alias("known"), "shingles")
    links = stored(links_within(alone, threshold))
    large = sets.where("blocks > 1").dropDuplicates(["node"])
    if not sets.where("blocks > 1").limit(1).count():
        return components(links)
    large = stored(large)

    def grouped(so_far: DataFrame) -> DataFrame:
        of = components(so_far)
        return stored(large.drop("shingles").join(of, "node", "left").select("*", F.col("component").isNotNull().alias("linked")).withColumn("known", F.coalesce("component", "node")).drop("component"))

    now = grouped(links)
    in_block = Window.partitionBy("shard", "known", "block").orderBy(F.xxhash64("node"))
    in_all = Window.partitionBy("shard", "known").orderBy(F.xxhash64("node"))
    few = now.where("linked").withColumn("k", F.row_number().over(in_block)).where(f"k <= {DELEGATES}").withColumn("k", F.row_number().over(in_all)).where(f"k <= {DELEGATES}")
    parts = few.groupBy("shard").agg(blocks_of("n").alias("parts"))
    delegates = few.join(parts, "shard").select("shard", F.lit(-1).alias("k1"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("k2"), "node", none, "known")
    links = stored(links.unionByName(links_within(delegates.join(large.select("node", "n", "shingles"), "node"), threshold)))

    now = grouped(links)
    rows = on_lists(chosen.join(now.select("node", "n", "known", "shard", "block"), "node"))
    return components(links.unionByName(links_on_lists(rows, large, threshold)))


def similar_components(docs: DataFrame, size: int = 5, threshold: Fraction | str = Fraction(8, 10), with_groups: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of
    every row; documents link when the Jaccard similarity of their shingle sets is at least the
    threshold. With groups, also the hash of the text (part) and a number of the component (group,
    null without shingles), which tells texts that share a doc_id apart."""
    threshold = Fraction(threshold)
    sets = stored(read_sets(docs, size, threshold))
    full = sets.where("n_shingles > 0 and doc_id is not null")
    found = full.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("sampled").alias("sampled"), F.max("late").alias("late"))
    classes = stored(found.withColumns({"n_sampled": (F.length("sampled") / 8).cast("int"), "node": F.monotonically_increasing_id()}))
    sums = classes.agg(F.sum("n_sampled").cast("long"), F.sum("copies").cast("long")).first()
    chosen = stored(prefixes(classes, shared_shingles(classes, sums[0] or 0), threshold))
    shards = components(candidate_edges(chosen, chosen.agg(F.sum(F.length("signatures") / 8).cast("long")).first()[0] or 0)).withColumnRenamed("component", "shard")
    members = stored(shards.join(classes, "node").select("node", "class", "shard", "rep", "n_shingles"))
    blocks = members.groupBy("shard").agg(blocks_of("n_shingles").alias("blocks"))
    placed = members.join(blocks, "shard").select("node", "class", "shard", "blocks", F.col("rep").alias("doc_id"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    groups = shard_components(stored(shard_sets(texts(docs).join(placed.hint("merge"), "doc_id"), size)), chosen, threshold)
    named = classes.select("class", "node", "rep", "copies").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = named.where("component is not null").groupBy("group").agg(F.min("rep").alias("least"))
    linked = named.join(least, "group", "left").select("class", "group", "copies", F.coalesce("least", "rep").alias("component_id"))
    rows = hot.left_join(sets.select("doc_id", "part", "n_shingles", "class"), linked, "class", "copies", sums[1] or 0)
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return rows.select("doc_id", "n_shingles", component, *(["part", "group"] if with_groups else []))
