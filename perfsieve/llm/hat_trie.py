"""Counting runs of words in bounded memory: a shallow trie of word ids over burstable hash containers.

Words get ids in order of appearance, and a run of ``size`` words is one whole number, the first word's
id highest. A container is a hash table of runs; it covers an interval of prefixes (a hybrid container)
or a single one (a pure container). One that grows beyond ``BURST`` entries bursts: it is cut between
two first words, or, once it holds one first word only, between two second words, and so on. When
all containers together hold ``MOST_ENTRIES`` entries, the largest subtrees are spilled as runs sorted by
their words, until half of the entries are gone. Ids live as long as the vocabulary stays below its
bounds; beyond them everything is spilled and ids begin anew.

Only runs whose two parts of ``size`` - 1 words may be frequent enter the trie: ``Known`` is a bit array of
bounded size over the hashes of the frequent ones. A chance hit lets a rare run in, nothing else.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BURST = 1 << 15
MOST_ENTRIES = 800_000
VOCABULARY_BYTES = 32_000_000
CHUNK = 1 << 16
BOUNDARY = b"\xff"


class Vocabulary(dict):
    """Word to id; unknown words get the next one. The boundary between pieces is 0."""

    def __init__(self) -> None:
        super().__init__()
        self.size = 0
        self.hashes = array("Q", [0])
        self[BOUNDARY] = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self[word] = found = len(self)
        return found


def run_hashes(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of each run of a language from the hashes of its words, one array per place."""
    out = np.full(len(hashes[0]), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for word in hashes:
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Known:
    """A bit per hash value, addressed by the hash's first ``bits`` bits."""

    bits: int
    words: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass
class Container:
    low: int
    counts: Counter = field(default_factory=Counter)


class Trie:
    """The containers of one language, in order of their lowest prefix."""

    def __init__(self, size: int, bits: int) -> None:
        self.size, self.bits = size, bits
        self.containers = [Container(0)]

    def __len__(self) -> int:
        return sum(len(c.counts) for c in self.containers)

    def add(self, codes: np.ndarray) -> None:
        codes = np.sort(codes)
        lows = np.array([c.low for c in self.containers[1:]], np.int64)
        edges = [0, *np.searchsorted(codes, lows).tolist(), len(codes)]
        full = False
        for container, start, end in zip(self.containers, edges[:-1], edges[1:], strict=True):
            if end > start:
                container.counts.update(codes[start:end].tolist())
                full |= len(container.counts) > BURST
        while full:
            parts = [self._burst(c) if len(c.counts) > BURST else [c] for c in self.containers]
            full = any(len(p) > 1 for p in parts)
            self.containers = [c for p in parts for c in p]

    def _burst(self, container: Container) -> list[Container]:
        keys = np.fromiter(container.counts, np.int64, len(container.counts))
        order = np.argsort(keys)
        counts = np.fromiter(container.counts.values(), np.int64, len(keys))[order].tolist()
        keys = keys[order]
        for depth in range(1, self.size + 1):
            shift = self.bits * (self.size - depth)
            prefixes = keys >> shift
            if prefixes[0] == prefixes[-1]:
                continue
            middle = prefixes[len(keys) // 2]
            if middle == prefixes[0]:
                middle = prefixes[np.searchsorted(prefixes, middle, "right")]
            cut = int(middle) << shift
            edge = int(np.searchsorted(keys, cut))
            listed = keys.tolist()
            low = Container(container.low, Counter(dict(zip(listed[:edge], counts[:edge], strict=True))))
            high = Container(cut, Counter(dict(zip(listed[edge:], counts[edge:], strict=True))))
            return [low, high]
        return [container]


class WordCounting:
    """Counts of single words by language: a trie of depth one is a hash container of words."""

    def __init__(self) -> None:
        self.counts: dict[str, Counter] = {}
        self.totals: Counter = Counter()

    def feed(self, lang: str, tokens: list[bytes], context: int = 0) -> Iterator[pa.RecordBatch]:
        self.counts.setdefault(lang, Counter()).update(tokens[context:])
        if sum(map(len, self.counts.values())) > MOST_ENTRIES:
            yield from self.spill()

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, counts in self.counts.items():
            del counts[BOUNDARY]
            words = pa.array(list(counts), pa.binary())
            n = pa.array(list(counts.values()), pa.int64())
            self.totals[lang] += sum(counts.values())
            order = pc.array_sort_indices(words)
            yield _batch(lang, words.take(order).cast(pa.string()), n.take(order))
        self.counts = {}

    def finish(self) -> Iterator[pa.RecordBatch]:
        """What is left, and each language's number of words under the empty phrase."""
        yield from self.spill()
        for lang, total in self.totals.items():
            yield _batch(lang, pa.array([""]), pa.array([total], pa.int64()))


SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _batch(lang: str, phrases: pa.Array, n: pa.Array) -> pa.RecordBatch:
    names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64)))
    return pa.RecordBatch.from_arrays([names, phrases, n], schema=SCHEMA)


class Counting:
    """Counts of the runs of ``size`` words (two or more) by language, spilled as sorted runs (lang, phrase, n)."""

    def __init__(self, size: int, known: Known | None = None) -> None:
        self.size, self.known = size, known
        self.bits = 63 // size
        self.tries: dict[str, Trie] = {}
        self.ids = Vocabulary()

    def feed(self, lang: str, tokens: list[bytes], context: int = 0) -> Iterator[pa.RecordBatch]:
        """Count the runs that end after the first ``context`` tokens; spilled runs are yielded."""
        step = min(CHUNK, 1 << (self.bits - 1))
        for at in range(context, len(tokens), step):
            start = max(0, at - self.size + 1)
            if len(self.ids) + step + self.size >= 1 << self.bits or self.ids.size > VOCABULARY_BYTES:
                yield from self.spill(0)
                self.ids = Vocabulary()
            self._count(lang, tokens[start : at + step], at - start)
            if sum(map(len, self.tries.values())) > MOST_ENTRIES:
                yield from self.spill(MOST_ENTRIES // 2)

    def _count(self, lang: str, tokens: list[bytes], context: int) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        inside = ids > 0
        places = len(ids) - self.size + 1
        if places <= 0:
            return
        code, whole = np.zeros(places, np.int64), np.ones(places, bool)
        for k in range(self.size):
            code |= ids[k : k + places] << self.bits * (self.size - 1 - k)
            whole &= inside[k : k + places]
        if self.known is not None:
            hashes = np.frombuffer(self.ids.hashes, np.uint64)[ids]
            frequent = self.known.holds(run_hashes(lang, [hashes[k : k + places + 1] for k in range(self.size - 1)]))
            whole &= frequent[:-1] & frequent[1:]
        first = max(0, context - self.size + 1)
        if lang not in self.tries:
            self.tries[lang] = Trie(self.size, self.bits)
        self.tries[lang].add(code[first:][whole[first:]])

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Largest subtrees first, until at most ``keep`` entries are left."""
        parts = [(len(c.counts), lang, n) for lang, trie in self.tries.items() for n, c in enumerate(trie.containers)]
        held = sum(size for size, _, _ in parts)
        words = pa.array(list(self.ids), pa.binary())
        for size, lang, n in sorted(parts, reverse=True):
            if held <= keep:
                break
            container = self.tries[lang].containers[n]
            if size:
                yield self._run(lang, container.counts, words)
            container.counts = Counter()
            held -= size
        if not keep:
            self.tries = {}

    def _run(self, lang: str, counts: Counter, words: pa.Array) -> pa.RecordBatch:
        keys = np.fromiter(counts.keys(), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        mask = (1 << self.bits) - 1
        places = [(keys >> self.bits * (self.size - 1 - k)) & mask for k in range(self.size)]
        # Word ids to ranks among the words of this run, then one sort of whole numbers.
        marked = np.zeros(len(words), bool)
        for place in places:
            marked[place] = True
        used = np.flatnonzero(marked)
        order = pc.array_sort_indices(words.take(pa.array(used))).to_numpy()
        rank = np.zeros(len(words), np.int64)
        rank[used[order]] = np.arange(len(used))
        ranked = np.zeros(len(keys), np.int64)
        for place in places:
            ranked = ranked << self.bits | rank[place]
        order = np.argsort(ranked, kind="stable")
        columns = [words.take(pa.array(place[order])) for place in places]
        phrase = pc.binary_join_element_wise(*columns, b" ").cast(pa.string())
        return _batch(lang, phrase, pa.array(n[order]))

    def finish(self) -> Iterator[pa.RecordBatch]:
        """What is left."""
        yield from self.spill(0)
