"""Byte-level BPE of overlapping chunks, stitched where their pre-token boundaries meet.

A text longer than ``CHUNK`` characters is cut into chunks, each with an overlap into the next one that
reaches beyond a place where any two readings must meet (``MEET``). Chunks are dealt to tasks by
document and number; each finds its pre-tokens from its own first character, as if a boundary were
there, which may be wrong. As nothing in the pattern looks back, two readings that share one boundary
agree from there on; so a chunk, which also sees how the next one begins, hands over at the first
boundary that both have, encodes the pieces before it, and says how many tokens stand before each of its
own first boundaries. In a document's order the chunks' tokens are then put together: what stands before
the place where a chunk was entered is left out. Shorter texts are one chunk and meet no other.

Tokens are those of a table of ranks, each pre-token merged by itself, lowest rank and leftmost first;
decoding concatenates the tokens' bytes.

Null text counts as empty: no tokens, digests of nothing. A very long text is cut within its own row and
otherwise passes in chunks; a run without any place to meet is one chunk, since its end decides how it
is read. Rows repeat in the result as often as in the input, equal ids and texts included; an empty table
gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT
from .common import in_batches, stored, texts

#: Characters of a chunk, of its overlap at least (so that a chunk is entered before the next one begins, no
#: more than CHUNK), and that must be seen behind a boundary to be sure of it.
CHUNK, OVERLAP, MARGIN = 1 << 14, 256, 4
#: A boundary lies behind each of these, wherever reading began: no pre-token goes on there.
MEET = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|\S(?=\s)")
#: Pre-tokens that a worker remembers.
REMEMBERED = 400_000
CHUNKS = "document string, doc_id long, number int, begin long, head int, core int, text string"
ENCODED = "document string, doc_id long, number int, begin long, next long, starts array<int>, before array<int>, ids array<int>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Strings:
    """Byte strings by number, of which many are joined at once."""

    def __init__(self, strings: list[bytes]):
        self.all, self.size = np.frombuffer(b"".join(strings), np.uint8), np.array([*map(len, strings)], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return self.all[np.repeat(self.begin[numbers] - before, size) + np.arange(size.sum())].tobytes()


class Ranks:
    """A table of ranks: lines of a token in base 64 and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {i: token for token, i in self.rank.items()}
        self.known = Known(self)
        n = 1 + max(self.bytes_of, default=-1)
        self.decimals, self.data = Strings([b"%d " % i for i in range(n)]), Strings([self.bytes_of.get(i, b"") for i in range(n)])

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token."""
        if piece in self.rank:
            return [self.rank[piece]]
        return self._merge_short(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        # parts are places in the piece, so that a merge takes one away and makes no bytes but those looked up
        rank, never = self.rank, len(self.rank) << 1
        get, cuts = rank.get, list(range(len(piece) + 1))
        ranks = [get(piece[k : k + 2], never) for k in range(len(piece) - 1)]
        while ranks and (least := min(ranks)) < never:
            k = ranks.index(least)
            del ranks[k], cuts[k + 1]
            if k < len(ranks):
                ranks[k] = get(piece[cuts[k] : cuts[k + 2]], never)
            if k:
                ranks[k - 1] = get(piece[cuts[k - 1] : cuts[k + 1]], never)
        return [rank[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, for pieces in which looking for the least pair would take long."""
        rank, n = self.rank, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = end[k]
            # a pair stands as long as its two parts do
            if gone[k] or middle >= n or end[middle] != stop:
                continue
            end[k], gone[middle], before[stop] = stop, 1, k
            for a, b in ((before[k], stop), (k, end[stop] if stop < n else -1)):
                if a >= 0 and b > 0 and (r := rank.get(piece[a:b])) is not None:
                    heapq.heappush(heap, (r, a, b))
        out, k = [], 0
        while k < n:
            out.append(rank[piece[k : end[k]]])
            k = end[k]
        return out


class Piece(NamedTuple):
    """The tokens of a pre-token, how many they are, their decimals with a space behind each, and their bytes."""

    ids: list[int]
    n: int
    decimals: str
    data: bytes


TOKENS = itemgetter(0)


class Known(dict):
    """Pre-token to Piece; starts anew when full."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks

    def __missing__(self, piece: str) -> Piece:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.ranks.merge(piece.encode())
        out = Piece(ids, len(ids), "".join([f"{i} " for i in ids]), b"".join(map(self.ranks.bytes_of.__getitem__, ids)))
        if len(piece) <= 64:
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    return Ranks(path)


def cut(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(begin, head, core, text) of a text's chunks: where it begins, the characters that the chunk before
    has as well, and after how many the next chunk begins (-1: there is none)."""
    begin = head = 0
    while True:
        nominal = begin + CHUNK
        met = MEET.search(text, nominal) if nominal < len(text) else None
        if not met or met.end() + MARGIN >= len(text):
            yield begin, head, -1, text[begin:]
            return
        # behind a run that goes on beyond the overlap the next chunk begins where the run ends
        after = nominal if met.end() - nominal <= OVERLAP else met.end()
        stop = max(after + OVERLAP, met.end() + MARGIN)
        yield begin, head, after - begin, text[begin:stop]
        begin, head = after, min(stop, len(text)) - after


def sure_pieces(text: str) -> tuple[list[str], int]:
    """The pre-tokens of a text's beginning that nothing behind the text can change, and where they end."""
    pieces, end = SPLIT.findall(text), len(text)
    while pieces and end + MARGIN > len(text):
        end -= len(pieces.pop())
    return pieces, end


def chunk_pieces(text: str, core: int) -> tuple[list[str], int]:
    """A chunk's pre-tokens up to where the next chunk takes over, and that place (-1: no next chunk)."""
    if core < 0:
        return SPLIT.findall(text), -1
    mine, end = sure_pieces(text)
    theirs = {core + at for at in accumulate(map(len, sure_pieces(text[core:])[0]), initial=0)}
    # both readings agree behind the first boundary that they share, so going back they agree down to it
    over, kept = -1, len(mine)
    for k in range(len(mine), -1, -1):
        if end in theirs:
            over, kept = end, k
        if end <= core:
            break
        end -= len(mine[k - 1])
    return mine[:kept], over


def chunks_of(docs: DataFrame) -> DataFrame:
    """The chunks of each row's text, of documents with a name of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                name, rows, size = uuid.uuid4().hex, [], 0
                for number, (begin, head, core, part) in enumerate(cut(text)):
                    rows.append((name, doc_id, number, begin, head, core, part))
                    size += len(part)
                    if size >= 1 << 21:
                        yield chunk_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield chunk_batch(rows)

    return in_batches(docs, run, CHUNKS)


CHUNK_ARROW = pa.schema([("document", pa.string()), ("doc_id", pa.int64()), ("number", pa.int32()), ("begin", pa.int64()), ("head", pa.int32()), ("core", pa.int32()), ("text", pa.string())])


def chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNK_ARROW)], schema=CHUNK_ARROW)


def encode_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Each chunk's tokens up to where the next one takes over (next), and for its boundaries in the part
    that the chunk before has as well (starts) how many tokens stand before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(path).known
        for batch in batches:
            out = {k: [] for k in ("next", "starts", "before", "ids")}
            for begin, head, core, text in zip(*(batch.column(c).to_pylist() for c in ("begin", "head", "core", "text"))):
                pieces, over = chunk_pieces(text, core)
                found = [*map(TOKENS, map(known.__getitem__, pieces))]
                starts = [at for at in accumulate(map(len, pieces[:head]), initial=0) if at <= head]
                before = [*accumulate(map(len, found[: len(starts) - 1]), initial=0)]
                out["next"].append(begin + over if over >= 0 else -1)
                out["starts"].append(starts)
                out["before"].append(before)
                out["ids"].append(array("i", chain.from_iterable(found)))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("document", "doc_id", "number", "begin")), pa.array(out["next"], pa.int64()), *(pa.array(out[c], lists) for c in ("starts", "before", "ids"))],
                ["document", "doc_id", "number", "begin", "next", "starts", "before", "ids"],
            )

    return in_batches(chunks, run, ENCODED)


class Digests:
    """n_tokens, ids_sha256, decoded_sha256, and ids if they are kept."""

    def __init__(self, ranks: Ranks, keep_ids: bool):
        self.ranks, self.n, self.ids_sha, self.text_sha = ranks, 0, hashlib.sha256(), hashlib.sha256()
        self.ids = array("i") if keep_ids else None

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.ids_sha.update(b" " * (self.n > 0) + self.ranks.decimals.joined(ids)[:-1])
            self.text_sha.update(self.ranks.data.joined(ids))
            self.n += len(ids)
            if self.ids is not None:
                self.ids.frombytes(ids.astype(np.int32).tobytes())

    def row(self, doc_id: int | None) -> tuple:
        return (doc_id, self.n, self.ids_sha.hexdigest(), self.text_sha.hexdigest(), *([self.ids.tolist()] if self.ids is not None else []))


def schema_of(keep_ids: bool) -> tuple[str, pa.Schema]:
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids, pa.schema(fields)


def joined(encoded: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    """Puts the chunks of each document together, in order, one chunk at a time."""
    ddl, arrow = schema_of(keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, name, digests, entry, doc_id = load(path), None, None, 0, None
        for batch in batches:
            done, ids = [], batch.column("ids")
            at, values = np.asarray(ids.offsets), np.asarray(ids.values)
            for k, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                if row["document"] != name:
                    if digests:
                        done.append(digests.row(doc_id))
                    name, doc_id, digests, entry = row["document"], row["doc_id"], Digests(ranks, keep_ids), row["begin"]
                digests.add(values[at[k] + row["before"][row["starts"].index(entry - row["begin"])] : at[k + 1]])
                entry = row["next"]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(digests.row(doc_id), arrow)], schema=arrow)

    return in_batches(encoded, run, ddl)


def encode_whole(docs: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    """Texts of a single chunk."""
    ddl, arrow = schema_of(keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(path).known
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = [*map(known.__getitem__, chunk_pieces(text or "", -1)[0])]
                ids, n, decimals, data = zip(*found) if found else ((), (), (), ())
                shas = hashlib.sha256("".join(decimals)[:-1].encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()
                rows.append((doc_id, sum(n), *shas, *([[*chain.from_iterable(ids)]] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return in_batches(docs, run, ddl)


def encode_texts(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Per document its token count, digests of the ids and of the decoded bytes, and, unless keep_ids is
    false, the ids themselves."""
    path, docs = path or default_path(), texts(docs)
    long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    chunks = stored(chunks_of(docs.where(long)))
    encoded = encode_chunks(chunks.repartition("document", "number"), path)
    return encode_whole(docs.where(~long), path, keep_ids).unionByName(joined(encoded.repartition("document").sortWithinPartitions("document", "number"), path, keep_ids))
