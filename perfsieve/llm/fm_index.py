"""An FM-index over one bounded shard of symbols: suffix array, wavelet-matrix ranks, sampled places.

Symbols are whole numbers from 1; 0 separates runs and ends the text. Searches never cross a
separator. Everything is numpy over arrays of the shard's length.
"""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 16
LOCATE_ROWS = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes; separators differ from each other and sort first, by place."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()) - 1)
    after = np.concatenate([rank[1:], [-1]]) + 1
    key = rank * (int(rank.max()) + 2) + after
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    # Slots of suffixes that share their first `depth` symbols with a neighbour.
    alone = new & np.concatenate([new[1:], [True]])
    open_slots = np.flatnonzero(~alone)
    depth = 2
    while open_slots.size:
        places = order[open_slots]
        beyond = places + depth
        follow = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + follow
        by_key = np.argsort(key, kind="stable")
        places, key = places[by_key], key[by_key]
        order[open_slots] = places
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[places] = np.maximum.accumulate(np.where(new, open_slots, 0))
        alone = new & np.concatenate([new[1:], [True]])
        open_slots = open_slots[~alone]
        depth *= 2
    return order


class Bits:
    """A bit vector that counts the ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks of any symbol in a sequence, one bit vector per bit of the alphabet."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.n_bits = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        left = sequence
        for shift in reversed(range(self.n_bits)):
            bit = (left >> shift) & 1 == 1
            self.levels.append((Bits(bit), int(len(left) - bit.sum())))
            left = np.concatenate([left[~bit], left[bit]])
        # Where each symbol's rows begin after the last level.
        self.start = self._down(np.arange(1 << self.n_bits), np.zeros(1 << self.n_bits, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(i)
            i = np.where((symbols >> (self.n_bits - 1 - level)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._down(symbols, i) - self.start[symbols]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, how often it occurs before)."""
        symbols = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            bit, ones = bits.at(i), bits.ones(i)
            symbols = symbols * 2 + bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbols, i - self.start[symbols]


class FmIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, rate: int = SAMPLE_RATE):
        """``text`` holds symbols below ``n_symbols`` and ends with 0."""
        order = suffix_array(text)
        self.n = len(text)
        previous = text[order - 1]
        self.wavelet = Wavelet(previous.astype(np.int64), n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        self.first = np.cumsum(counts) - counts
        # The first symbol of every run is sampled too, so no walk meets a separator.
        sampled = (order % rate == 0) | (previous == 0)
        self.marks = Bits(sampled)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases: one per row, right-aligned, padded with 0 on the left."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for column in reversed(range(phrases.shape[1])):
            live = np.flatnonzero((phrases[:, column] > 0) & (low < high))
            if not live.size:
                break
            symbols = phrases[live, column].astype(np.int64)
            low[live] = self.first[symbols] + self.wavelet.rank(symbols, low[live])
            high[live] = self.first[symbols] + self.wavelet.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, walking back to the nearest sampled one."""
        found = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while live.size:
            here = self.marks.at(at)
            found[live[here]] = self.samples[self.marks.ones(at[here])] + steps
            live, at, steps = live[~here], at[~here], steps + 1
            if live.size:
                symbols, before = self.wavelet.access(at)
                at = self.first[symbols] + before
        return found

    def occurrences(self, phrases: np.ndarray):
        """Yields (phrase number, text position) arrays of bounded length for all occurrences."""
        low, high = self.search(phrases)
        counts = np.maximum(high - low, 0)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        for start in range(0, total, LOCATE_ROWS):
            number = np.arange(start, min(total, start + LOCATE_ROWS))
            phrase = np.searchsorted(ends, number, side="right")
            yield phrase, self.locate(low[phrase] + number - (ends[phrase] - counts[phrase]))
