"""Benchmark decontamination with an FM-index per shard of training text.

A task turns the documents of an Arrow batch into symbols (words of no benchmark item are
separators), builds an FM-index over shards of bounded length, searches all benchmark windows
backwards at once, locates every occurrence through the sampled positions and merges them into
spans of words. Runs of benchmark words that are shorter than the shortest window are left out of
the index, as no window fits in. Nothing is shuffled: a document's hits stay in its row.

Windows are broadcast in blocks of ``block_bytes`` of item text; a benchmark larger than one block
takes one pass over the documents per block, and spans and items add up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfsieve.llm.common import as_bytes, fresh, table, tidy, words
from perfsieve.llm.fm_index import FmIndex

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_SYMBOLS = 1 << 21
# Documents searched and cut at a time, of those in an Arrow batch.
CLEAN_ROWS = 2000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The distinct windows of some benchmark items, as symbols, and the items each belongs to."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for start in range(max(1, len(symbols) - window + 1) if symbols else 0):
                owners.setdefault(tuple(symbols[start : start + window]), set()).update([item] if item is not None else [])
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), window), np.int32)
        for row, phrase in enumerate(owners):
            self.table[row, window - len(phrase) :] = phrase
        self.names = sorted({i for own in owners.values() for i in own})
        place = {name: n for n, name in enumerate(self.names)}
        self.item_of = np.array([place[i] for own in owners.values() for i in sorted(own)], np.int64)
        self.n_items = np.array([len(own) for own in owners.values()], np.int64)
        self.item_start = np.cumsum(self.n_items) - self.n_items


def _runs(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero symbols that hold at least ``least`` of them."""
    edge = np.diff(np.concatenate([[0], (symbols != 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept = ends - starts >= least
    return starts[kept], ends[kept]


def _shards(starts: np.ndarray, ends: np.ndarray, overlap: int, limit: int) -> Iterator[list[tuple[int, int]]]:
    """Runs dealt into shards of at most ``limit`` symbols; a longer run is cut with an overlap."""
    shard, size = [], 0
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        while True:
            stop = min(end, start + limit)
            if shard and size + stop - start > limit:
                yield shard
                shard, size = [], 0
            shard.append((start, stop))
            size += stop - start
            if stop == end:
                break
            start = stop - overlap
    if shard:
        yield shard


def find(texts: list[bytes | None], phrases: Phrases, limit: int = SHARD_SYMBOLS) -> list[tuple]:
    """Per text: (number of words, flat [start, end) word spans that are hit, item names)."""
    get, pieces, counts = phrases.vocabulary.get, [], []
    for text in texts:
        found = list(map(get, words(text), repeat(0)))
        counts.append(len(found))
        found.append(0)
        pieces.append(np.array(found, np.int32))
    symbols = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    del pieces
    begin = np.cumsum([0, *[c + 1 for c in counts]])
    cover = np.zeros(len(symbols) + 1, np.int32)
    seen: list[np.ndarray] = []
    if len(phrases.lengths) and len(symbols):
        longest, shortest = int(phrases.lengths.max()), int(phrases.lengths.min())
        runs = _runs(symbols, shortest)
        for shard in _shards(*runs, longest - 1, max(limit, 4 * longest)):
            zero = np.zeros(1, np.int32)
            text = np.concatenate([x for start, end in shard for x in (symbols[start:end], zero)])
            lengths = np.array([end - start + 1 for start, end in shard])
            at = np.cumsum(lengths) - lengths
            origin = np.array([start for start, _ in shard])
            index = FmIndex(text, len(phrases.vocabulary) + 1)
            for phrase, place in index.occurrences(phrases.table):
                run = np.searchsorted(at, place, side="right") - 1
                place = origin[run] + place - at[run]
                np.add.at(cover, place, 1)
                np.add.at(cover, place + phrases.lengths[phrase], -1)
                doc = np.searchsorted(begin, place, side="right") - 1
                seen.append(np.unique(doc * len(phrases.lengths) + phrase))
    hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    edge = np.diff(hit)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begin, starts, side="right") - 1
    out = [(n, [], []) for n in counts]
    for d, start, end in zip(doc.tolist(), (starts - begin[doc]).tolist(), (ends - begin[doc]).tolist(), strict=True):
        out[d][1].extend((start, end))
    if seen:
        pairs = np.unique(np.concatenate(seen))
        doc, phrase = np.divmod(pairs, len(phrases.lengths))
        n = phrases.n_items[phrase]
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.item_start[phrase], n)
        named = np.unique(np.repeat(doc, n) * max(1, len(phrases.names)) + phrases.item_of[slot])
        for d, item in zip(*np.divmod(named, max(1, len(phrases.names))), strict=True):
            out[d][2].append(phrases.names[item])
    return out


def _merge(one: list[int], other: list[int]) -> list[int]:
    """The union of two flat lists of spans."""
    merged: list[int] = []
    for start, end in sorted(zip(one[::2] + other[::2], one[1::2] + other[1::2], strict=True)):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = total // block_bytes + 1
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        yield Phrases([(r["item"], r["text"]) for r in rows], window)


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    out: str = "hits",
) -> DataFrame:
    """``docs`` with a column ``out``: n_words, spans (flat [start, end) word numbers), items (sorted).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, an
    item without words none. Windows that several items share count for each. Items without an id
    mark words but are not named. A null text has no words. Rows that repeat are each searched; an
    empty table of either kind gives no hits.
    """
    spark = docs.sparkSession
    first = True
    for phrases in _blocks(benchmark, item_col, item_text_col, window, block_bytes):
        marked = F.arrow_udf(_searcher(spark.sparkContext.broadcast(phrases)), FOUND, F.ArrowUDFType.SCALAR_ITER)
        found = marked.asNondeterministic()(F.col(text_col))
        if first:
            docs, first = docs.withColumn(out, found), False
            continue
        more = fresh(docs, "_more")
        both = F.arrow_udf(_join_hits, FOUND, F.ArrowUDFType.SCALAR).asNondeterministic()
        docs = docs.withColumn(more, found).withColumn(out, both(F.col(out), F.col(more))).drop(more)
    return docs


def _searcher(shared):
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = find(as_bytes(batch), shared.value)
            yield pa.array([{"n_words": n, "spans": s, "items": i} for n, s, i in found], _ARROW)

    return tidy(search)


def _join_hits(one: pa.Array, other: pa.Array) -> pa.Array:
    pairs = zip(one.to_pylist(), other.to_pylist(), strict=True)
    return pa.array(
        [
            {"n_words": a["n_words"], "spans": _merge(a["spans"], b["spans"]), "items": sorted({*a["items"], *b["items"]})}
            for a, b in pairs
        ],
        _ARROW,
    )


def cut(text: str, spans: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them; one space takes their place."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[last : places[start][0]])
        last = places[end - 1][1]
    return " ".join([*kept, text[last:]])


def _clean(texts: list[str | None], spans: list[list[int]], blocks: list[Phrases]) -> list[str | None]:
    """Cut the spans, and again where what is left meets to form a window."""
    texts = list(texts)
    todo = [i for i, s in enumerate(spans) if s]
    while todo:
        for i in todo:
            texts[i] = cut(texts[i], spans[i])
        left = [texts[i].encode() for i in todo]
        found: list[list[int]] = [[] for _ in todo]
        for block in blocks:
            found = [_merge(one, hit[1]) for one, hit in zip(found, find(left, block), strict=True)]
        spans = dict(zip(todo, found, strict=True))
        todo = [i for i in todo if spans[i]]
    return texts


def _cleaner(shared):
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for at in range(0, len(texts), CLEAN_ROWS):
                some = texts.slice(at, CLEAN_ROWS)
                raw = as_bytes(some)
                spans: list[list[int]] = [[] for _ in raw]
                for block in shared.value:
                    spans = [_merge(one, hit[1]) for one, hit in zip(spans, find(raw, block), strict=True)]
                del raw
                parts.append(pa.array(_clean(some.to_pylist(), spans, shared.value), pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return tidy(clean)


def remove_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of its text; other columns stay.

    A row whose text holds none is unchanged, a null text stays null; no row is dropped. Text that
    comes together through a cut is searched again, so the result holds no window.
    """
    blocks = list(_blocks(benchmark, item_col, item_text_col, window, block_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    # One function searches and cuts: two would hold two Python workers a task.
    cleaned = F.arrow_udf(_cleaner(shared), "string", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    narrow = docs.select(F.col(id_col), F.col(text_col))
    name = fresh(narrow, "_hits")
    marked = with_hits(narrow, benchmark, text_col, out=name, **options)
    hits = F.col(name)
    spans = hits["spans"]
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return marked.select(
        F.col(id_col),
        hits["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

QUERIES = {"op6_decontaminate": _query}
CHECKS = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS phrase FROM (
    SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(phrase) AS n FROM p),
g AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS phrase FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
), o AS (SELECT g.doc_id, g.s, g.n, p.item FROM g JOIN p ON g.phrase = p.phrase),
h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM o)
  GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
}
