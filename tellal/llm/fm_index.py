"""A compressed full-text index over sequences of words, and matching statistics by backward search.

What is kept of a text of n words over an alphabet of 2^w: w bits a word with a count before every 64
(the wavelet matrix of its Burrows-Wheeler transform), a byte a word for common prefixes with the
minima of every 64 (a 64th more, and so on), a bit a word that marks groups, and a number a group.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max
#: The bits below each of a word's 64.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with counts before each 64 bits."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit.astype(np.uint8), bitorder="little")
        self.words = np.pad(packed, (0, 8 - len(packed) % 8)).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & BELOW[at & 63])


class WaveletMatrix:
    """Rank over symbols: one bit vector a level."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.n, self.width, self.levels, self.zeros = len(symbols), width, [], []
        letters = int(symbols.max(initial=0)) + 1
        for level in range(width - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        #: Where each symbol's occurrences begin on the last level.
        self.begin = self._down(np.arange(letters), np.zeros(letters, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.width):
            ones = self.levels[k].ones(at)
            at = np.where(symbol & 1 << self.width - 1 - k, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the symbol occurs before start and before end."""
        n = len(symbol)
        at = self._down(np.concatenate([symbol, symbol]), np.concatenate([start, end]))
        begin = self.begin[symbol]
        return at[:n] - begin, at[n:] - begin


class Minima:
    """The nearest smaller value before or after a place, by minima of 64, of 64 of these, and so on."""

    def __init__(self, values: np.ndarray):
        top = np.iinfo(values.dtype).max
        self.levels = []
        while True:
            values = np.pad(values, (0, -len(values) % 64), constant_values=top)
            self.levels.append(values)
            if len(values) == 64:
                break
            values = values.reshape(-1, 64).min(1)

    def smaller(self, at: np.ndarray, value: np.ndarray, back: bool) -> np.ndarray:
        """The last place up to ``at`` (else the first from there on) with less than ``value``; there is one."""
        place, level = at.copy(), np.zeros(len(at), np.int64)
        rising = np.arange(len(at))
        k = 0
        while len(rising):
            hit, where = self._in_block(k, place[rising] >> 6, value[rising], place[rising], back)
            found = rising[hit]
            place[found], level[found] = where[hit], k
            rising = rising[~hit]
            place[rising] = (place[rising] >> 6) + (-1 if back else 1)
            k += 1
        for k in range(k - 1, 0, -1):
            sinking = np.flatnonzero(level == k)
            _, place[sinking] = self._in_block(k - 1, place[sinking], value[sinking], None, back)
            level[sinking] = k - 1
        return place

    def _in_block(self, k: int, block: np.ndarray, value: np.ndarray, bound: np.ndarray | None, back: bool) -> tuple[np.ndarray, np.ndarray]:
        cell = (block << 6)[:, None] + np.arange(64)
        # a place beyond the last block has no value
        ok = self.levels[k][np.minimum(cell, len(self.levels[k]) - 1)] < value[:, None]
        if bound is not None:
            ok &= cell <= bound[:, None] if back else cell >= bound[:, None]
        pick = 63 - ok[:, ::-1].argmax(1) if back else ok.argmax(1)
        return ok.any(1), (block << 6) + pick


def sort_suffixes(ranks: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order by doubling; also the rank of each place by its first 1, 2, 4, ... symbols."""
    n, kept = len(ranks), [np.unique(ranks, return_inverse=True)[1].astype(np.int64)]
    depth = 1
    while depth <= longest and kept[-1].max() < n - 1:
        rank = kept[-1]
        following = np.zeros(n, np.int64)
        following[: max(0, n - depth)] = rank[depth:] + 1
        order = np.argsort(key := rank * (n + 1) + following)
        key = key[order]
        kept.append(np.empty(n, np.int64))
        kept[-1][order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        depth *= 2
    return np.argsort(kept[-1]), kept


def common_prefixes(order: np.ndarray, kept: list[np.ndarray]) -> np.ndarray:
    """How many symbols each suffix shares with the one before it in the order; 0 at both ends."""
    n = len(order)
    a, b, length = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(kept) - 1, -1, -1):
        x, y = a + length, b + length
        inside = np.maximum(x, y) < n
        same = inside & (kept[k][np.minimum(x, n - 1)] == kept[k][np.minimum(y, n - 1)])
        length += same.astype(np.int64) << k
    kind = np.uint8 if length.max(initial=0) < 255 else np.uint32
    return np.concatenate([[0], length, [0]]).astype(kind)


class ShardIndex:
    """FM-index over a shard's word sequences (numbers from 0), each with a number (its smallest
    document). Every sequence ends in a sentinel of its own, so no match runs over an end."""

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray, threshold: int):
        self.threshold = threshold
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = np.concatenate(sequences) + 1
        ranks = text + len(sequences)
        ranks[ends] = np.arange(len(sequences))
        order, kept = sort_suffixes(ranks, int(sizes.max()) + 1)
        prefixes = common_prefixes(order, kept)
        self.prefixes = Minima(prefixes)
        #: Suffixes that agree in the first ``threshold`` symbols are one group.
        start = prefixes[:-1] < threshold
        self.groups = Bits(start)
        self.least = np.minimum.reduceat(np.repeat(owner, sizes + 1)[order], np.flatnonzero(start))
        width = max(1, int(text.max()).bit_length())
        self.letters = int(text.max())
        self.matrix = WaveletMatrix(text[order - 1], width)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << width if width < 8 else 0))])

    def parents(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of intervals of suffixes that begin alike: the next larger such intervals, and in how many
        symbols these agree."""
        values = self.prefixes.levels[0]
        depth = np.maximum(values[lo], values[hi]).astype(np.int64)
        up = depth > 0
        outer_lo, outer_hi = np.zeros(len(lo), np.int64), np.full(len(lo), self.matrix.n, np.int64)
        outer_lo[up] = self.prefixes.smaller(lo[up], depth[up], True)
        outer_hi[up] = self.prefixes.smaller(hi[up], depth[up], False)
        return outer_lo, outer_hi, depth

    def stream(self, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Matching statistics: for every place of each sequence how long the longest match is that
        begins there, and, if it reaches ``threshold``, the least owner of a match of so many words.

        Sequences need not be in the index; a negative number is a word that the index has not. All
        move backwards together: a match that a word does not continue is shortened at its end, to
        the next larger interval of suffixes, until it does.
        """
        size = np.array([len(s) for s in sequences])
        offset = np.cumsum(size) - size
        flat = np.concatenate(sequences) + 1 if len(sequences) else np.zeros(0, np.int64)
        flat[flat > self.letters] = 0
        length, least = np.zeros(len(flat), np.int64), np.full(len(flat), NONE)
        at, stop = offset + size - 1, offset
        lo, hi, depth = np.zeros(len(size), np.int64), np.full(len(size), self.matrix.n, np.int64), np.zeros(len(size), np.int64)
        live = np.flatnonzero(size > 0)
        at, stop, lo, hi, depth = at[live], stop[live], lo[live], hi[live], depth[live]
        while len(at):
            symbol = flat[at]
            a, b = self.matrix.rank(symbol, lo, hi)
            a, b = self.first[symbol] + a, self.first[symbol] + b
            longer = (b > a) & (symbol > 0)
            lo, hi, depth = np.where(longer, a, lo), np.where(longer, b, hi), depth + longer
            enough = longer & (depth >= self.threshold)
            least[at[enough]] = self.least[self.groups.ones(lo[enough] + 1) - 1]
            length[at[longer]] = depth[longer]
            # where nothing continues the match: shorter, or on to the next word if there is none left
            on = longer | (depth == 0)
            short = np.flatnonzero(~on)
            if len(short):
                lo[short], hi[short], shared = self.parents(lo[short], hi[short])
                depth[short] = shared
            at = at - on
            live = at >= stop
            if not live.all():
                at, stop, lo, hi, depth = at[live], stop[live], lo[live], hi[live], depth[live]
        cuts = np.cumsum(size)[:-1]
        return np.split(length, cuts), np.split(least, cuts)
