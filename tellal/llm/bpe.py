"""Byte-level BPE as a streaming transducer with bounded lookahead.

``sufficient_lookahead`` derives from the merge list how far to the right of a token the input can
still change it. Every text, short or long, goes through ``StreamEncoder`` in pieces of ``BLOCK``
characters; it finds pre-tokens as they become certain and runs their bytes through ``ByteStream``,
which emits tokens once they are stable. What is held is bounded: the characters that can still
change a pre-token's end, and of a pre-token that goes on and on, a window of bytes. What the
transducer emitted for a pre-token is remembered. ``StreamDecoder`` is an incremental byte-to-text
state machine.

Null text counts as empty: no tokens, the digest of nothing. Very long texts pass in blocks, and a
single unbroken run of letters, however long, in windows. Rows repeat in the result as often as in
the input; an empty table gives an empty result; columns that are not asked for are not looked at,
whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_batches, texts, with_fields

SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
RUNS = {k: regex.compile(p) for k, p in (("letter", r"\p{L}*"), ("digit", r"\p{N}*"), ("other", r"[^\s\p{L}\p{N}]*"), ("space", r"\s*"))}
#: Characters that the encoder is fed at a time.
BLOCK = 1 << 12
#: Where two neighbours never merge.
NEVER = (1 << 60, -1)
#: Pre-tokens that a worker remembers.
REMEMBERED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], width: list[int]) -> int:
    """Bytes to the right of a token after which no continuation can change it.

    merges: left, right and merged id, by priority. Appended bytes can undo a merge only through a
    merge of higher priority that takes its right part as a left part; the part set free can in
    turn only join a merge of lower priority whose right part it is. Such a chain runs along
    strictly falling priorities, so the longest chain, in bytes of the left parts it crosses, plus
    the widest token bounds how far back a change reaches.
    """
    reach: dict[int, int] = {}
    far = 0
    for left, right, _ in reversed(merges):
        f = width[left] + reach.get(left, 0)
        reach[right] = max(reach.get(right, 0), f)
        far = max(far, f + width[right])
    return far + max(width)


class Model:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in token)
        self.byte_id = [vocab[c] for c in byte_letters()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, m) for r, (a, b, m) in reversed([*enumerate(merges)])}
        self.lookahead = sufficient_lookahead(merges, [len(b) for b in self.bytes_of])
        #: Bytes that are merged at a time while a pre-token goes on; a token always fits.
        self.window = 4 * self.lookahead
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Characters held back: a special token or a contraction may begin there.
        self.hold = 3 + max([0, *map(len, self.special)])
        self.known = Known(self)

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a whole pre-token."""
        return self._merge_short(data) if len(data) <= 48 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ids, rank = [self.byte_id[b] for b in data], self.rank
        ranks = [rank.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is NEVER:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank.get((ids[k], ids[k + 1]), NEVER)
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], ids[k]), NEVER)
        return ids

    def _merge_long(self, data: bytes) -> list[int]:
        ids: list[int] = [self.byte_id[b] for b in data]
        n, rank = len(ids), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := rank.get((ids[k], ids[k + 1])))]
        heap = [(r, k, m, a, b) for r, m, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, merged, a, b = heapq.heappop(heap)
            nxt = right[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = merged, -1
            right[k] = right[nxt]
            if right[k] < n:
                left[right[k]] = k
            for p, q in ((left[k], k), (k, right[k])):
                if p >= 0 and q < n and (found := rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (found[0], p, found[1], ids[p], ids[q]))
        return [i for i in ids if i >= 0]


class Known(dict):
    """Pre-token to tokens, as the transducer emits them at first sight; starts anew when full."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        stream = ByteStream(self.model)
        out = (*stream.feed(piece.encode()), *stream.finish())
        if len(piece) <= 64:
            self[piece] = out
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


class ByteStream:
    """The tokens of one pre-token whose bytes arrive in parts.

    Bytes are held until ``lookahead`` more have arrived behind a token: from then on nothing that
    may follow can change it. Of a run that does not end, ``lookahead`` bytes and one window stay.
    """

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def feed(self, data: bytes) -> Iterator[int]:
        self.held += data
        window = self.model.window
        while len(self.held) >= window + self.model.lookahead:
            end = 0
            for i in self.model.merge(self.held[: window + self.model.lookahead]):
                if end + len(self.model.bytes_of[i]) > window:
                    break
                end += len(self.model.bytes_of[i])
                yield i
            self.held = self.held[end:]

    def finish(self) -> list[int]:
        out, self.held = self.model.merge(self.held), b""
        return out


class StreamEncoder:
    """feed() and finish() return the tokens that became stable, as unsigned integers."""

    def __init__(self, model: Model):
        self.model, self.tail, self.run, self.stream = model, "", "", None

    def feed(self, text: str) -> array:
        out = array("I")
        buf = self.tail + text
        if self.model.marks:
            at = 0
            for m in self.model.marks.finditer(buf):
                self._segment(buf[at : m.start()], True, out)
                out.append(self.model.special[m[0]])
                at = m.end()
            buf = buf[at:] if at else buf
        self._segment(buf, False, out)
        return out

    def finish(self) -> array:
        out = array("I")
        self._segment(self.tail, True, out)
        return out

    def _segment(self, buf: str, last: bool, out: array) -> None:
        """Encodes what is stable of buf and keeps the rest; all of it if no more follows."""
        if self.stream:
            buf = self._go_on(buf, last, out)
            if self.stream:
                return
        pieces = SPLIT.findall(buf)
        self.tail = ""
        if not last:
            held, n = [], 0
            while pieces and n < self.model.hold:
                held.append(pieces.pop())
                n += len(held[-1])
            self.tail = "".join(reversed(held))
        out.extend(chain.from_iterable(map(self.model.known.__getitem__, pieces)))
        if len(self.tail) >= BLOCK and len(held) == 1:
            self.run = next(k for k in ("letter", "digit", "space", "other") if RUNS[k].fullmatch(self.tail[-1]))
            self.stream = ByteStream(self.model)
            self._go_on(self.tail, False, out, start=1)

    def _go_on(self, buf: str, last: bool, out: array, start: int = 0) -> str:
        """Feeds the pre-token that is still open; returns what follows it."""
        end = RUNS[self.run].match(buf, start).end()
        if not last and end > (safe := max(0, len(buf) - self.model.hold)):
            out.extend(self.stream.feed(buf[:safe].encode()))
            self.tail = buf[safe:]
            return ""
        if self.run == "space" and end < len(buf):
            end -= 1
        out.extend(self.stream.feed(buf[:end].encode()))
        out.extend(self.stream.finish())
        self.stream = None
        return buf[end:]


class StreamDecoder:
    """Token bytes to text; a character whose bytes are not all there yet waits, and bytes that
    are no UTF-8 become U+FFFD."""

    def __init__(self, model: Model):
        self.bytes_of, self.state = model.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encoded(model: Model, text: str) -> Iterator[array]:
    """The tokens of a text, block by block."""
    stream = StreamEncoder(model)
    for k in range(0, len(text), BLOCK):
        yield stream.feed(text[k : k + BLOCK])
    yield stream.finish()


def pieces(model: Model, text: str) -> list[str]:
    """A text's control strings and pre-tokens."""
    out, at = [], 0
    for m in model.marks.finditer(text) if model.marks else ():
        out += SPLIT.findall(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    return out + SPLIT.findall(text[at:] if at else text)


def encode(model: Model, text: str) -> list[int]:
    return [i for block in encoded(model, text) for i in block]


def encode_texts(docs: DataFrame, path: str | None = None, keep_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document its token count, digests of the ids and of the decoded text, and, unless
    keep_ids is false, the ids themselves. Columns named in keep pass through. One pass without a shuffle."""
    docs = texts(docs, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path or default_path())
        for batch in batches:
            rows = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
            for text in batch.column("text").to_pylist():
                ids_sha, text_sha, back, n, ids = hashlib.sha256(), hashlib.sha256(), StreamDecoder(model), 0, array("I")
                for block in encoded(model, text or ""):
                    ids_sha.update(block.tobytes())
                    text_sha.update(back.feed(block).encode())
                    n += len(block)
                    if keep_ids:
                        ids.extend(block)
                text_sha.update(back.finish().encode())
                rows["n_tokens"].append(n)
                rows["ids_sha256"].append(ids_sha.hexdigest())
                rows["decoded_sha256"].append(text_sha.hexdigest())
                rows["ids"].append(ids)
            cols = [batch.column("doc_id"), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols + [batch.column(c) for c in keep], names + [*keep])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return in_batches(docs, run, with_fields(schema, docs, keep))
