"""Substring deduplication with an FM-index per shard.

A word goes if a run of ``window`` words that covers it also starts in a document of a smaller
doc_id; runs are judged on the input.

1. Every run has an anchor: its smallest hash of ``GRAM`` words. Equal runs have equal anchors, so
   only runs whose anchor lies in two documents or more can repeat. Anchors meet in buckets; those
   that very many places have are found beforehand and do not go there.
2. Around each shared anchor, the stretch of text that its runs cover goes to the anchor's shard.
   Anchors of many documents are dealt run by run, by content, so that no shard has to hold them
   all. Of runs that very many places have, the smallest document is found by aggregation, and their
   places are decided where they are.
3. A shard builds an FM-index over the stretches that a larger document could repeat, and streams
   those that a smaller one could have through it: backward search over the wavelet matrix gives
   matching statistics, where a match reaches the threshold, of which the smallest document counts.
   What a smaller document has is reported as an interval of words.
4. Intervals are joined to their documents and cut out.

A null or empty text has no words, a text shorter than a run loses none, a very long one is hashed in
blocks. Rows without a doc_id are kept whole and remove nothing. Rows that share a doc_id, repeated
ones or not, do not remove each other's words, as neither doc_id is smaller. Other columns pass
through only where they are named in ``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot
from .common import in_batches, stored, with_fields
from .fm_index import NONE, ShardIndex
from .ngram_join import WordHash, word_hashes
from .winnow import LOW, gram_hashes, window_minima

WINDOW = 50
#: Words of an anchor, at most; fewer for short windows.
GRAM = 24
#: Anchors that meet in one bucket, and words of text in one shard.
BUCKET = 600_000
SHARD_WORDS = 300_000
#: An anchor of more documents is dealt run by run; one of more places, and a run of more, can be hot.
HOT = 4000
#: What is known of a stretch: a smaller document has its anchor, a larger one has, very many have.
SMALLER, LARGER, MANY = 1, 2, 4
BLOCK = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of a document: anchor hash, first run and number of runs, per stretch of runs
    with the same anchor."""
    runs, gram = len(hashes) - window + 1, min(GRAM, window)
    out = [[], [], []]
    for start in range(0, max(0, runs), BLOCK):
        some = hashes[start : min(start + BLOCK, runs) + window - 1]
        h = gram_hashes(some, gram)
        low = window_minima((h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64)), window - gram + 1)
        at = (LOW - (low & LOW)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[0].append(h[at[first]])
        out[1].append(first + start)
        out[2].append(np.diff(np.append(first, len(at))))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def split_by(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The distinct keys and, for each column, the bytes of each key's values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(key))
    return key[cut], [[c[a:b].tobytes() for a, b in zip(cut, ends)] for c in (c[order] for c in columns)]


PLACE = np.dtype([("doc", "<i8"), ("part", "<i4"), ("first", "<i4"), ("runs", "<u2")])


def anchored(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Per batch and bucket all anchors and their places."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            found, places = [], []
            for doc, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text"))):
                h, first, runs = anchors(word_hashes(text.encode().split(), known), window)
                place = np.empty(len(h), PLACE)
                place["doc"], place["part"], place["first"], place["runs"] = doc, part, first, runs
                found.append(h.astype(np.uint64))
                places.append(place)
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            place = np.concatenate(places) if places else np.zeros(0, PLACE)
            key, (a, b) = split_by(((h >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64), h, place)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["bucket", "anchors", "places"])

    return in_batches(docs, deal, "bucket long, anchors binary, places binary")


def anchors_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("anchors").to_pylist()), np.uint64)


def shared_anchors(dealt: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, part, anchor, first, runs and role of the stretches whose anchor lies in two documents,
    and of all whose anchor is frequent."""

    def rows(h: np.ndarray, p: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        cols = [p["doc"], p["part"], h.view(np.int64), p["first"], p["runs"].astype(np.int32), role.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc_id", "part", "anchor", "first", "runs", "role"])

    def only(batches: Iterator[pa.RecordBatch], hot_ones: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for bucket, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "anchors", "places"))):
                h = np.frombuffer(a, np.uint64)
                use = hot.among(h, frequent) == hot_ones
                if use.any():
                    yield bucket, h[use], np.frombuffer(b, PLACE)[use]

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, h, place in only(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([h.tobytes()], pa.binary()), pa.array([place.tobytes()], pa.binary())], ["bucket", "anchors", "places"])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, place in only(batches, True):
            yield rows(h, place, np.full(len(h), SMALLER | LARGER | MANY))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def shared() -> pa.RecordBatch:
            h = np.concatenate([np.frombuffer(a, np.uint64) for a, _ in held])
            place = np.concatenate([np.frombuffer(b, PLACE) for _, b in held])
            order = np.lexsort((place["doc"], h))
            h, place = h[order], place[order]
            doc = np.ascontiguousarray(place["doc"])
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(h))[: len(cut)]
            new_doc = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))]) if len(h) else np.zeros(0, np.int64)
            docs_of, low, high = (np.repeat(x, ends - cut) for x in (new_doc[ends - 1] - new_doc[cut] + 1, doc[cut], doc[ends - 1]))
            use = docs_of > 1
            role = SMALLER * (doc > low) + LARGER * (doc < high) + MANY * (docs_of > HOT)
            return rows(h[use], place[use], role[use])

        for batch in batches:
            for bucket, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "anchors", "places"))):
                if held and bucket != now:
                    yield shared()
                    held = []
                now = bucket
                held.append((a, b))
        if held:
            yield shared()

    schema = "doc_id long, part int, anchor long, first int, runs int, role int"
    rest = in_batches(dealt, cold, "bucket long, anchors binary, places binary") if len(frequent) else dealt
    met = in_batches(rest.repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket"), meet, schema)
    return met.unionByName(in_batches(dealt, stay, schema)) if len(frequent) else met


def run_digests(hashes: np.ndarray, window: int) -> np.ndarray:
    """128 bits of each run of words, as two columns."""
    other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return np.stack([gram_hashes(hashes, window), gram_hashes(other, window)], 1)


RUN = np.dtype([("x", "<u8"), ("y", "<u8")])


def digest_keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(RUN)[:, 0]


def owners_of_hot_runs(docs: DataFrame, frequent: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs at frequent anchors those that very many places have: sorted digests, and the smallest
    document of each. Every task sends a run on once; the driver gets 2 * hot.MOST runs at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = WordHash(), [], 0

        def least() -> pa.RecordBatch:
            key, doc = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            key, at, count = np.unique(key, return_inverse=True, return_counts=True)
            low = np.full(len(key), NONE)
            np.minimum.at(low, at, doc)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key["x"]).view(np.int64)), pa.array(np.ascontiguousarray(key["y"]).view(np.int64)), pa.array(low), pa.array(count)], ["x", "y", "owner", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = word_hashes(text.encode().split(), known)
                # an anchor is one of these; most texts have no frequent one
                if len(words) < window or not hot.among(gram_hashes(words, min(GRAM, window)), frequent).any():
                    continue
                h, first, runs = anchors(words, window)
                use = hot.among(h.astype(np.uint64), frequent)
                if use.any():
                    at = np.concatenate([np.arange(a, a + k) for a, k in zip(first[use].tolist(), runs[use].tolist())])
                    held.append((digest_keys(run_digests(words, window)[at]), np.full(len(at), doc, np.int64)))
                    n += len(at)
            if n >= hot.CHUNK:
                yield least()
                held, n = [], 0
        if held:
            yield least()

    all_runs = stored(in_batches(docs, run, "x long, y long, owner long, n long").groupBy("x", "y").agg(F.min("owner").alias("owner"), F.sum("n").alias("n")))
    total = all_runs.agg(F.sum("n").cast("long")).first()[0] or 0
    rows = all_runs.where(F.col("n") > hot.limit(total, HOT)).collect()
    key = np.array([(r["x"] & (1 << 64) - 1, r["y"] & (1 << 64) - 1) for r in rows], RUN)
    order = np.argsort(key)
    return key[order], np.array([r["owner"] for r in rows], np.int64)[order]


LINE_PLACE = np.dtype([("line", "<i4"), ("doc", "<i8"), ("part", "<i4"), ("first", "<i4"), ("role", "i1")])
INTERVAL = np.dtype([("doc", "<i8"), ("part", "<i4"), ("begin", "<i4"), ("end", "<i4")])


def stretches(docs: DataFrame, shards: int, window: int, hot_runs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs: doc_id, part, text and the list ``at`` of shared anchors' stretches. Per batch and
    shard: the distinct stretches of text, one a line, and where each occurs. Places of hot runs are
    decided here; their intervals travel with any shard's rows."""
    digests, owners = hot_runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = WordHash(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            lines: dict[int, dict[bytes, int]] = {}
            places: dict[int, list[tuple]] = {}
            decided: list[tuple] = []

            def send(key: int, line: bytes, doc: int, part: int, first: int, role: int) -> None:
                shard = (key >> 9) % shards
                own = lines.setdefault(shard, {})
                places.setdefault(shard, []).append((own.setdefault(line, len(own)), doc, part, first, role))

            for doc, part, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text", "at"))):
                words = text.encode().split()
                many = [(a["first"], a["runs"]) for a in at if a["role"] & MANY]
                for a in at:
                    if not a["role"] & MANY:
                        send(a["anchor"] & (1 << 64) - 1, b" ".join(words[a["first"] : a["first"] + a["runs"] + window - 1]), doc, part, a["first"], a["role"])
                if many:
                    firsts = np.concatenate([np.arange(f, f + n) for f, n in many])
                    owner = np.full(len(firsts), -1, np.int64)
                    if len(digests):
                        key = digest_keys(run_digests(word_hashes(words, known), window)[firsts])
                        k = np.minimum(np.searchsorted(digests, key), len(digests) - 1)
                        owner = np.where(digests[k] == key, owners[k], NONE)
                        decided += [(doc, part, f, f + window) for f in firsts[owner < doc].tolist()]
                        firsts = firsts[owner == NONE]
                    for f in firsts.tolist():
                        line = b" ".join(words[f : f + window])
                        send(int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little"), line, doc, part, f, SMALLER | LARGER)
            keys = list(lines) or [0] * bool(decided)
            spread = np.array_split(np.array(decided, INTERVAL), len(keys)) if keys else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array([pack.compress(b"\n".join(lines.get(k, ()))) for k in keys], pa.binary()),
                    pa.array([np.array(places.get(k, []), LINE_PLACE).tobytes() for k in keys], pa.binary()), pa.array([x.tobytes() for x in spread], pa.binary()),
                ],
                ["shard", "lines", "places", "decided"],
            )

    return in_batches(docs, run, "shard long, lines binary, places binary, decided binary")


def repeated_intervals(dealt: DataFrame, shards: int, window: int) -> DataFrame:
    """doc_id, part, begin and end of the words that runs from smaller documents cover."""

    def rows(doc: np.ndarray, part: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        cols = [doc.astype(np.int64), part.astype(np.int32), begin.astype(np.int32), end.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc_id", "part", "begin", "end"])

    def intervals(held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        found, unpack = [], zstandard.ZstdDecompressor()
        for lines, places in held:
            number = np.array([known.setdefault(x, len(known)) for x in unpack.decompress(lines).split(b"\n")], np.int64)
            p = np.frombuffer(places, LINE_PLACE).copy()
            p["line"] = number[p["line"]]
            found.append(p)
        p = np.concatenate(found)
        owner = np.full(len(known), NONE)
        np.minimum.at(owner, p["line"], p["doc"])
        indexed, asked = (np.unique(p["line"][p["role"] & bit > 0]) for bit in (LARGER, SMALLER))
        if not len(indexed) or not len(asked):
            return
        lines, words = list(known), {}
        sequences = [np.array([words.setdefault(w, len(words)) for w in lines[k].split(b" ")], np.int64) for k in indexed.tolist()]
        index = ShardIndex(sequences, owner[indexed], window)
        _, least = index.stream([np.array([words.get(w, -1) for w in lines[k].split(b" ")], np.int64) for k in asked.tolist()])
        least = [x[: len(x) - window + 1] for x in least]
        p = p[p["role"] & SMALLER > 0]
        line = np.searchsorted(asked, p["line"])
        runs = np.array([len(x) for x in least])
        flat, start = np.concatenate(least), np.cumsum(runs) - runs
        n = runs[line]
        row = np.repeat(np.arange(len(p)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        covered = flat[start[line][row] + inside] < p["doc"][row]
        row, inside = row[covered], inside[covered]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1))) if len(row) else row
        last = np.append(first[1:], len(row)) - 1 if len(row) else row
        q, base = p[row[first]], p["first"][row[first]]
        yield rows(q["doc"], q["part"], base + inside[first], base + inside[last] + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, lines, places, decided in zip(*(batch.column(c).to_pylist() for c in ("shard", "lines", "places", "decided"))):
                if decided:
                    d = np.frombuffer(decided, INTERVAL)
                    yield rows(d["doc"], d["part"], d["begin"], d["end"])
                if held and shard != now:
                    yield from intervals(held)
                    held = []
                now = shard
                if places:
                    held.append((lines, places))
        if held:
            yield from intervals(held)

    return in_batches(dealt.repartition(min(shards, 20_000), "shard").sortWithinPartitions("shard"), run, "doc_id long, part int, begin int, end int")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, part and ``spans``, the word intervals to remove, of the documents that have any."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("part", F.hash("text"))
    words = keyed.agg(F.sum(F.length("text")).cast("long")).first()[0] or 0
    buckets = max(1, words // 5 // 12 // BUCKET + 1)
    dealt = stored(anchored(keyed, window, buckets))
    total = dealt.agg(F.sum(F.length("anchors") / 8).cast("long")).first()[0] or 0
    frequent = hot.hot_keys(dealt.select("anchors"), anchors_of, total, HOT)
    hot_runs = owners_of_hot_runs(keyed, frequent, window) if len(frequent) else (np.zeros(0, RUN), np.zeros(0, np.int64))
    shared = stored(shared_anchors(dealt, buckets, frequent))
    weight = F.when(F.col("role") >= MANY, F.col("runs") * window).otherwise(F.col("runs") + window - 1)
    shards = max(1, -(-(shared.agg(F.sum(weight)).first()[0] or 0) // SHARD_WORDS))
    of_doc = shared.groupBy("doc_id", "part").agg(F.collect_set(F.struct("anchor", "first", "runs", "role")).alias("at"))
    found = repeated_intervals(stretches(keyed.join(of_doc.hint("merge"), ["doc_id", "part"]), shards, window, hot_runs), shards, window)
    return found.groupBy("doc_id", "part").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))


def without(text: str, spans: list, total: int) -> str:
    """The text without the words of the spans and the white space before each of them."""
    gone = np.zeros(total + 1, bool)
    for s in spans:
        gone[s["begin"] : s["end"]] = True
    starts, last, out = [m.span() for m in WORD.finditer(text)], 0, []
    for k, (_, end) in enumerate(starts):
        if not gone[k]:
            out.append(text[last:end])
        last = end
    return "".join(out) + ("" if total and gone[total - 1] else text[last:])


def deduplicate(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row doc_id, n_words, n_removed, the SHA-256 of the words left, joined by one space, and,
    unless keep_text is false, the text left, in its own spacing. Columns named in keep pass through."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep).withColumn("part", F.hash("text"))
    rows = keyed.join(removals(docs, window).hint("merge"), ["doc_id", "part"], "left").select("doc_id", "text", "spans", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, left = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode().split()
                total = len(words)
                if spans:
                    use = np.ones(total + 1, bool)
                    for s in spans:
                        use[s["begin"] : s["end"]] = False
                    words = [words[k] for k in np.flatnonzero(use[:total])]
                joined = b" ".join(words)
                n.append(total)
                gone.append(total - len(words))
                digest.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    left.append(without(text, spans, total) if spans else text)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(left, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols + [batch.column(c) for c in keep], names + [*keep])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return in_batches(rows, run, with_fields(schema, rows, keep))
