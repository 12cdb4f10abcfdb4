"""Similarity join of documents on word n-grams: MinHash banding, then exact verification.

Documents with the same n-gram set are one class from the start (``copies`` of it). The sets'
MinHash signatures are cut into bands; band and row counts follow from the threshold and a target
recall. Sets are shuffled on band hashes, and only buckets with two sets or more go on. A pair
belongs to the first bucket it shares, so it is counted once however many buckets hold it. Sets of
buckets that own pairs meet as full n-gram sets; large buckets are cut into blocks, and every pair
of blocks is a task of bounded size. Such a task returns link counts per set and a spanning forest
of its links, never the pairs, so a group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm.common import (
    as_bytes,
    fresh,
    join_by_size,
    list_matrix,
    list_slices,
    one_chunk,
    runs,
    table,
    tidy,
    words,
)
from perfsieve.session import materialize

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999
MAX_HASHES = 128
# A task compares at most two blocks of about this many sets and n-grams.
BLOCK_SETS = 1024
BLOCK_GRAMS = 1 << 20
WORD_MEMO = 100_000
GRAMS_AT_ONCE = 1024
DENSE_SHARE = 0.1
PAIR_ROWS = 128
FEW_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(similarity: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which ``most`` hashes still find a pair at the threshold.

    A pair of similarity s meets in some band with probability 1 - (1 - s^rows)^bands.
    """
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity))), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def _scramble(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def forget_words() -> None:
    """Empty the word memory of this Python worker."""
    _WORDS.clear()


def gram_set(text: bytes | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct n-grams of a text as 64-bit numbers; a shorter text is one n-gram of all its words."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(n, len(found))
    total = np.full(len(found) - size + 1, np.uint64(size))
    for place in range(size):
        total = total * _ODD + hashed[place : len(found) - size + 1 + place]
    return np.unique(_scramble(total))


class Signer:
    """Band hashes of an n-gram set."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.addends = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.mixers = rng.integers(1, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        for start in range(0, len(grams), GRAMS_AT_ONCE):
            some = grams[start : start + GRAMS_AT_ONCE, None] * self.factors + self.addends
            np.minimum(least, some.min(axis=0), out=least)
        # The mixers differ by band, so equal numbers are equal bands and no bucket spans two.
        return _scramble((_scramble(least).reshape(self.bands, self.rows) * self.mixers).sum(axis=1))


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n", pa.int64()),
        ("digest", pa.string()),
        ("bands", pa.list_(pa.int64())),
    ]
)
SIGNED = "doc_id long, text_key long, n long, digest string, bands array<long>"


def _digest(grams: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else ""


def _sign(bands: int, rows: int, ngram: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            sizes, digests, signed = [], [], []
            for text in as_bytes(batch.column(2)):
                grams = gram_set(text, ngram)
                sizes.append(len(grams))
                digests.append(_digest(grams))
                signed.append(signer.bands_of(grams).view(np.int64) if len(grams) else np.zeros(bands, np.int64))
            flat = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            ends = np.arange(0, len(flat) + 1, bands, dtype=np.int32)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED)
        forget_words()

    return tidy(sign)


def _grams(ngram: int):
    schema = pa.schema([("digest", pa.string()), ("grams", pa.list_(pa.int64()))])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [gram_set(t, ngram) for t in as_bytes(batch.slice(at, 256).column(0))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_digest, sets), pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema
                )
        forget_words()

    return tidy(grams)


def _owned(bands: np.ndarray, sizes: np.ndarray, band: int, similarity: float, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one, two) of a bucket of ``band`` that share no earlier band and whose sizes allow the similarity.

    Rows of side 0 pair with rows of side 1; rows of side 2 each with those after them. Rows of the
    pair matrix are taken a few at a time.
    """
    ones, twos = [], []
    for start in range(0, len(sizes), PAIR_ROWS):
        own = slice(start, start + PAIR_ROWS)
        mine = np.minimum(sizes[own, None], sizes) >= similarity * np.maximum(sizes[own, None], sizes)
        after = np.arange(len(sizes)) > np.arange(len(sizes))[own, None]
        mine &= (side[own, None] < side) | ((side[own, None] == 2) & (side == 2) & after)
        for earlier in range(band):
            mine &= bands[own, earlier, None] != bands[:, earlier]
        one, two = np.nonzero(mine)
        ones.append((one + start).astype(np.int32))
        twos.append(two.astype(np.int32))
    return np.concatenate(ones), np.concatenate(twos)


MEMBER = "bucket long, band int, digest string, copies long, n long, bands array<long>"
_MEMBER_COLUMNS = ["bucket", "band", "digest", "copies", "n", "bands"]


def _owners(n_bands: int, similarity: float):
    """Sets of a small bucket that own a pair there."""

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "bucket"):
            band = group.column("band")[0].as_py()
            bands = list_matrix(one_chunk(group.column("bands")), n_bands)
            sizes = group.column("n").to_numpy()
            owning = np.unique(np.concatenate(_owned(bands, sizes, band, similarity, np.full(len(sizes), 2))))
            if owning.size:
                yield from group.take(pa.array(owning)).to_batches()

    return tidy(owners)


def _incidence(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as numbers of those n-grams that occur twice or more among them."""
    flat = np.concatenate(sets)
    names, number, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    ends = np.cumsum([len(s) for s in sets])
    return [place[part][shared[part]] for part in np.split(number, ends[:-1])], int(shared.sum())


def _overlaps(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many n-grams each pair (one[i], two[i]) has in common; ``one`` is sorted."""
    found, width = _incidence(sets)
    if len(one) > 10_000 and len(one) > DENSE_SHARE * len(sets) ** 2 / 2:
        total = np.zeros((len(sets), len(sets)), np.float32)
        rows = np.repeat(np.arange(len(sets)), [len(f) for f in found])
        columns = np.concatenate(found)
        for start in range(0, width, 2048):
            here = (columns >= start) & (columns < start + 2048)
            part = np.zeros((len(sets), 2048), np.float32)
            part[rows[here], columns[here] - start] = 1
            total += part @ part.T
        return total[one, two].astype(np.int64)
    marks = np.zeros(width, bool)
    out = np.empty(len(one), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(one)) + 1).tolist(), len(one)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        own = found[one[start]]
        marks[own] = True
        for i in range(start, end):
            out[i] = np.count_nonzero(marks[found[two[i]]])
        marks[own] = False
    return out


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> list[int]:
    """The smallest member of each node's component."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


FOUND = "digest string, links long, other string"
_FOUND = pa.schema([("digest", pa.string()), ("links", pa.int64()), ("other", pa.string())])


def _verify(n_bands: int, similarity: float):
    """Links of the sets of one task: per set the number of linked documents and one edge of a spanning forest."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "task"):
            bands = list_matrix(one_chunk(group.column("bands")), n_bands)
            sizes = group.column("n").to_numpy()
            copies = group.column("copies").to_numpy()
            side = group.column("side").to_numpy()
            one, two = _owned(bands, sizes, group.column("band")[0].as_py(), similarity, side)
            if not one.size:
                continue
            sets = list_slices(one_chunk(group.column("grams")))
            common = _overlaps(sets, one, two)
            linked = common >= similarity * (sizes[one] + sizes[two] - common) - 1e-9
            one, two = one[linked], two[linked]
            links = np.bincount(one, copies[two], len(side)) + np.bincount(two, copies[one], len(side))
            names = group.column("digest").to_pylist()
            rows = [(names[i], int(links[i]), names[r] if r != i else None) for i, r in enumerate(_roots(len(side), one, two)) if links[i]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND, strict=True)], schema=_FOUND)

    return tidy(verify)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of every node's component, by large-star and small-star turns.

    ``edges`` has text columns a, b. Every turn writes its edges to the shared folder; a hub's
    neighbours stay apart (join_by_size). Nodes without an edge do not appear.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    state = None
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        both = materialize(now.union(now.select("b", "a")), "edges-both")
        least = materialize(
            both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")), "edges-least"
        )
        stars = join_by_size(both.withColumnRenamed("a", "u"), least, "u", "size", F.xxhash64("b"))
        large = materialize(
            stars.where("b > u").select(F.col("b").alias("a"), F.least("u", "m").alias("b")).distinct(), "edges-large"
        )
        least = materialize(
            large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")), "edges-least"
        )
        stars = join_by_size(large.withColumnRenamed("a", "u"), least, "u", "size", F.xxhash64("b"))
        small = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        now = materialize(small.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        state = tuple(seen)


def _label(docs: DataFrame, id_col: str, text_col: str, ngram: int, similarity: float, recall: float) -> DataFrame:
    """(doc_id, text_key, class, class_id, n_links) per row; class_id is null where a class has no id at all."""
    n_bands, rows = banding(similarity, recall)
    # text_key tells rows apart that repeat an id.
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    signed = materialize(keyed.mapInArrow(_sign(n_bands, rows, ngram), SIGNED), "signed")
    sets = materialize(
        signed.where("n > 0")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "n", "bands")).alias("r"), F.min("doc_id").alias("first_id"))
        .select("digest", "copies", "first_id", "r.doc_id", "r.text_key", "r.n", "r.bands"),
        "gram-sets",
    )
    placed = sets.select("digest", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = materialize(
        placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("grams")).where("size > 1"), "buckets"
    )
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_SETS, F.col("grams") / BLOCK_GRAMS)).cast("int")
    # Sets alone in their bucket leave here.
    joined = join_by_size(placed, buckets, "bucket", "size", F.xxhash64("digest")).where(F.col("size").isNotNull())
    members = joined.select("digest", "band", "bucket", blocks.alias("blocks")).join(
        sets.select("digest", "copies", "n", "bands"), "digest"
    )
    members = materialize(members.select(*_MEMBER_COLUMNS, "blocks"), "members")
    owners = members.where("blocks = 1").select(*_MEMBER_COLUMNS).repartition("bucket").sortWithinPartitions("bucket")
    small = owners.mapInArrow(_owners(n_bands, similarity), MEMBER).select(
        *_MEMBER_COLUMNS, F.col("bucket").alias("task"), F.lit(2).alias("side")
    )
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    large = members.where("blocks > 1").select(
        "*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    large = large.select(
        *_MEMBER_COLUMNS,
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    tasks = materialize(small.union(large).select(*_MEMBER_COLUMNS, "task", "side"), "tasks")
    wanted = tasks.select("digest").distinct().join(sets.select("digest", "doc_id", "text_key"), "digest")
    wanted = materialize(wanted.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")), "wanted")
    same = keyed["doc_id"].eqNullSafe(wanted["w_id"]) & (keyed["text_key"] == wanted["w_key"])
    needed = wanted if wanted.count() > FEW_IDS else F.broadcast(wanted)
    texts = keyed.join(needed, same, "left_semi").select("text")
    grams = texts.mapInArrow(_grams(ngram), "digest string, grams array<long>").dropDuplicates(["digest"])
    compared = tasks.join(grams, "digest").repartition("task").sortWithinPartitions("task")
    found = materialize(compared.mapInArrow(_verify(n_bands, similarity), FOUND), "links")
    labels = components(found.where("other IS NOT NULL").select(F.col("digest").alias("a"), F.col("other").alias("b")))
    links = found.groupBy(F.col("digest").alias("d1")).agg(F.sum("links").alias("links"))
    marked = (
        sets.select("digest", "copies", "first_id")
        .join(links, F.col("digest") == F.col("d1"), "left")
        .join(labels.withColumnRenamed("node", "d2"), F.col("digest") == F.col("d2"), "left")
        .select("digest", "copies", "first_id", "links", F.coalesce("label", "digest").alias("label"))
    )
    marked = materialize(marked, "marked-sets")
    firsts = materialize(
        marked.groupBy(F.col("label").alias("class")).agg(F.min("first_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "classes"
    )
    classed = join_by_size(marked.withColumnRenamed("label", "class"), firsts, "class", "size", F.xxhash64("digest"))
    by_set = materialize(
        classed.select("digest", "copies", "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labelled-sets"
    )
    whole = join_by_size(signed.select("doc_id", "text_key", "n", "digest"), by_set, "digest", "copies", F.xxhash64("doc_id", "text_key"))
    none = F.col("n") == 0
    return whole.select(
        "doc_id",
        "text_key",
        "class",
        F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(none, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links.

    ``n_links`` counts the other rows whose word n-gram set has at least the similarity (copies
    included); ``class_id`` is the smallest id among all that links connect, the row's own id
    without any. Null and wordless texts have no n-grams and no links. A text of fewer words than
    n is one n-gram. Rows that repeat id and text count as rows; null ids are never a class id
    unless a whole class has none. An empty table gives an empty result; other columns are not read.
    """
    found = _label(docs, id_col, text_col, ngram, similarity, recall)
    return found.select(F.col("doc_id").alias(id_col), "class_id", "n_links")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every class of similar documents: that of its smallest id, whole and unchanged.

    Rows that repeat an id and its text are left once. A class without any id keeps its rows.
    """
    found = _label(
        docs, id_col, text_col, options.get("ngram", NGRAM), options.get("similarity", SIMILARITY), options.get("recall", RECALL)
    )
    found = materialize(found, "near-labels")
    linked = found.where("n_links > 0 AND class_id IS NOT NULL")
    best = linked.where("doc_id = class_id").groupBy("class").agg(F.min("class_id").alias("k_id"), F.min("text_key").alias("k_key"))
    keep = materialize(best.select("k_id", "k_key"), "near-kept")
    gone = linked.select("doc_id", "text_key").distinct().join(
        keep, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")), "left_anti"
    )
    gone = materialize(gone.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")), "near-dropped")
    key = fresh(docs, "_text_key")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    few = gone if gone.count() > FEW_IDS else F.broadcast(gone)
    left = rows.join(few, rows[id_col].cast("long").eqNullSafe(gone["g_id"]) & (rows[key] == gone["g_key"]), "left_anti")
    repeated = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates([id_col, key])
    return left.drop(key)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard": _query}
CHECKS: dict[str, str] = {}
