"""Edit-aware token counts.

A document's pre-tokens lie in the leaves of a tree whose nodes hold the sums of characters and
tokens below them. An edit finds its leaves by character position, re-encodes only the pre-tokens it
touches with the context that their boundaries depend on, until old and new boundaries meet again,
and renews the sums on the paths to the root. A leaf that outgrows ``LEAF`` pre-tokens twice over is
split. Control strings are one token each, as in ``bpe``, also where an edit makes or breaks one.

Null text counts as empty. An edit outside a text is moved to its end. A very long text is one tree
of its own; an edit within an unbroken run re-encodes the run. Rows repeat in the result as often as
in the input, an empty table gives an empty result, and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import in_batches, texts

#: Pre-tokens in a leaf.
LEAF = 64


class TokenTree:
    def __init__(self, model: bpe.Model, text: str):
        self.model = model
        #: Characters around a boundary that decide it.
        self.context = model.hold
        pieces = bpe.pieces(model, text)
        self.leaves = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self._plant([self._sums(leaf) for leaf in self.leaves])
        #: Pre-tokens encoded by edits so far.
        self.encoded = 0

    def _sums(self, leaf: list[str]) -> tuple[int, int]:
        known, special = self.model.known, self.model.special
        return sum(map(len, leaf)), sum(1 if p in special else len(known[p]) for p in leaf)

    def _plant(self, sums: list[tuple[int, int]]) -> None:
        """The tree over leaves of these sums."""
        self.width = 1 << (len(sums) - 1).bit_length()
        empty = [0] * (self.width - len(sums))
        self.chars = [0] * self.width + [c for c, _ in sums] + empty
        self.tokens = [0] * self.width + [t for _, t in sums] + empty
        for k in range(self.width - 1, 0, -1):
            self._join(k)

    def _join(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with the character at ``at`` and where the leaf begins."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if at >= begin + self.chars[k] and begin + self.chars[k] < self.chars[1]:
                begin += self.chars[k]
                k += 1
        return min(k - self.width, len(self.leaves) - 1), begin

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``at`` on."""
        at = min(at, self.length)
        end = min(self.length, at + removed)
        first, place = self.find(max(0, at - self.context))
        leaf = self.leaves[first]
        # before: pre-tokens of the first leaf that no edit from here on can change
        before = 0
        while before < len(leaf) and place + len(leaf[before]) <= at - self.context:
            place += len(leaf[before])
            before += 1
        old, last, reach = leaf[before:], first, place + sum(map(len, leaf[before:]))
        more, shift = 0, len(inserted) - (end - at)
        while True:
            while last + 1 < len(self.leaves) and (more > 0 or reach < end + self.context):
                last, more = last + 1, more - 1
                old = old + self.leaves[last]
                reach += self.chars[self.width + last]
            source = "".join(old)
            new = bpe.pieces(self.model, source[: at - place] + inserted + source[end - place :])
            used, rest = self._until_they_meet(old, new, place, end, shift, last + 1 == len(self.leaves))
            if used:
                break
            more = last - first + 1
        self.encoded += len(used)
        self._replace(first, last, leaf[:before] + used + rest)

    def _until_they_meet(self, old: list[str], new: list[str], place: int, end: int, shift: int, whole: bool) -> tuple[list[str], list[str]]:
        """The new pre-tokens up to where they end at an old boundary behind the edit, and the old
        ones from there on; nothing if more text is needed to tell."""
        spots, spot = {}, place
        for k, p in enumerate(old, 1):
            spot += len(p)
            if spot >= end:
                spots[spot + shift] = k
        limit, spot = spot + shift, place
        for k, p in enumerate(new, 1):
            spot += len(p)
            if spot in spots and (whole or limit - spot >= self.context):
                return new[:k], old[spots[spot] :]
        return (new or [""], []) if whole else ([], [])

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        pieces = [p for p in pieces if p]
        n = last - first + 1
        if len(pieces) > 2 * LEAF * n:
            cut = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
            sums = list(zip(self.chars[self.width :], self.tokens[self.width :]))[: len(self.leaves)]
            self.leaves[first : last + 1] = cut
            self._plant(sums[:first] + [self._sums(leaf) for leaf in cut] + sums[last + 1 :])
            return
        size = -(-len(pieces) // n)
        paths = set()
        for k in range(n):
            leaf = self.leaves[first + k] = pieces[k * size : (k + 1) * size] if size else []
            self.chars[self.width + first + k], self.tokens[self.width + first + k] = self._sums(leaf)
            paths.add((self.width + first + k) // 2)
        while paths - {0}:
            for k in paths:
                self._join(k)
            paths = {k // 2 for k in paths if k > 1}


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits of a text: one replaces, one inserts, one deletes, in turn and each at a
    place of the text as it then is."""
    n = len(text)
    return [(n // 2, 7, " re-encoded"), (n // 4, 0, "\n\nInserted line, it's 42!  "), (3 * n // 4, 16, "")]


def count_edited(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document its tokens, its tokens after the edits, the pre-tokens that these re-encoded, and
    the digest of the edited text. One pass without a shuffle."""
    names = ["doc_id", "n_tokens", "n_tokens_edited", "n_encoded", "edited_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path or bpe.default_path())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tree = TokenTree(model, text or "")
                n = tree.count
                for at, removed, inserted in sample_edits(text or ""):
                    tree.edit(at, removed, inserted)
                rows.append((doc, n, tree.count, tree.encoded, hashlib.sha256(tree.text().encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return in_batches(texts(docs), run, "doc_id long, n_tokens long, n_tokens_edited long, n_encoded long, edited_sha256 string")
