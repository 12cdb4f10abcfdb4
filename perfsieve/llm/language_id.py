"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to ``ORDER`` bytes, with the counts of the bytes that
followed them in its training texts. A byte costs -log2(c / (T + D)) bits in the longest context that
has seen it (c its count there, T all counts, D different bytes: escape method C); every longer known
context that has not seen it first costs its escape, -log2(D / (T + D)). Below the empty context all
256 bytes are alike. Statistics are frozen after the fit, so a text's code length in a language is an
exact sum over its bytes, wherever it is cut; the language of the shortest code wins, ties go to the
smaller name. ``score`` is the winner's share of the probabilities 2^-length over all languages.

With frozen statistics a byte's cost depends on itself and the ``ORDER`` bytes before it. The trees of all
languages share one table of contexts (with the sum of the escapes along their suffixes) and one of
(context, byte) pairs (with the cost there less the context's own sum), so a byte costs two look-ups
whatever the number of languages, and each different run of bytes in a slice of text is looked up once.

The fit reads a bounded sample: per language at most ``SAMPLE_ROWS`` documents, in order of a hash of their
id and while fewer than ``SAMPLE_BYTES`` bytes are taken, whole texts, repeated ids once; the ``MOST_LANGUAGES``
languages with the most rows. Rare pairs are left out of the trees (a count limit in powers of two) until
the tables fit ``MODEL_BYTES``. Ids and sources are never inputs of a prediction.

Null texts and texts without a letter are `und` with score 0, as is every text when nothing could be
learned. Empty tables give no rows; repeated rows and ids are predicted one by one; null ids are not held
out. Texts of any length are read in slices. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfsieve.llm.common import as_bytes, table, tidy
from perfsieve.session import materialize

ORDER = 4
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 4_000_000
MOST_LANGUAGES = 256
MODEL_BYTES = 32_000_000
SLICE = 1 << 20
UNKNOWN = "und"
# Stands before the first byte of a text; no UTF-8 text holds it.
START = b"\xff"
_LETTER = regex.compile(r"\p{L}")


# --- runs of bytes ----------------------------------------------------------------------------
def pieces(texts: Iterable[bytes], order: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(text number, bytes before, bytes): every text in slices, none empty."""
    for i, text in enumerate(texts):
        for at in range(0, len(text), SLICE):
            before = text[max(0, at - order) : at]
            yield i, START * (order - len(before)) + before, text[at : at + SLICE]


def slices(texts: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, where each one's bytes begin, codes): about ``SLICE`` bytes at a time.

    A code is a byte and the ``order`` bytes before it as one number, the last byte lowest.
    """
    held: list[tuple[int, bytes, bytes]] = []
    size = 0
    for piece in pieces(texts, order):
        held.append(piece)
        size += len(piece[2])
        if size >= SLICE:
            yield _codes(held, order)
            held, size = [], 0
    if held:
        yield _codes(held, order)


def _codes(held: list[tuple[int, bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(part for _, before, text in held for part in (before, text)), np.uint8)
    lengths = np.array([len(text) for _, _, text in held])
    starts = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum()) + np.repeat(order * np.arange(1, len(held) + 1), lengths)
    codes = np.zeros(len(places), np.uint64)
    for back in range(order + 1):
        codes |= data[places - back].astype(np.uint64) << np.uint64(8 * back)
    return np.array([i for i, _, _ in held]), starts, codes


def _mask(length: int) -> np.uint64:
    return np.uint64((1 << 8 * length) - 1)


# --- the model --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Level:
    """Known runs of one length (sorted codes) and their bits per language."""

    codes: np.ndarray
    bits: np.ndarray


@dataclass(frozen=True)
class Model:
    """``contexts[k]``: known contexts of k bytes with their summed escapes; ``pairs[k]``: (context of k
    bytes, byte) with the cost there less the context's summed escapes; ``unseen``: a byte no tree knows."""

    languages: list[str]
    order: int
    contexts: list[Level]
    pairs: list[Level]
    unseen: np.ndarray

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Cost in bits of every code, one column per language."""
        out = np.zeros((len(codes), len(self.languages)))
        _add_longest(out, codes >> np.uint64(8), self.contexts, 0)
        rest = _add_longest(out, codes, self.pairs, 1)
        out[rest] += self.unseen
        return out


def _add_longest(out: np.ndarray, codes: np.ndarray, levels: list[Level], shortest: int) -> np.ndarray:
    """Add the bits of each code's longest known suffix; the codes without any are returned."""
    rest = np.arange(len(codes))
    for length in range(len(levels) - 1, -1, -1):
        level = levels[length]
        if not len(level.codes):
            continue
        wanted = codes[rest] & _mask(length + shortest)
        at = np.minimum(np.searchsorted(level.codes, wanted), len(level.codes) - 1)
        hit = level.codes[at] == wanted
        out[rest[hit]] += level.bits[at[hit]]
        rest = rest[~hit]
    return rest


def build(counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """The model of counted runs: ``counts[k]`` holds (language number, code, count) of runs of k + 1 bytes.

    Every run's suffixes must be counted too.
    """
    n = len(languages)
    contexts, pairs = [], []
    below_sums: np.ndarray | None = None
    shorter: Level | None = None
    unseen = np.zeros(n)
    for k, (language, code, count) in enumerate(counts):
        known = np.unique(code)
        parents = np.unique(known >> np.uint64(8))
        table_ = np.zeros((len(known), n))
        table_[np.searchsorted(known, code), language] = count
        parent = np.searchsorted(parents, known >> np.uint64(8))
        total = np.zeros((len(parents), n))
        different = np.zeros((len(parents), n))
        np.add.at(total, parent, table_)
        np.add.at(different, parent, table_ > 0)
        used = total > 0
        escape = np.where(used, np.log2(np.where(used, total + different, 1)) - np.log2(np.where(used, different, 1)), 0.0)
        if k == 0:
            sums = np.zeros_like(escape)
            unseen = (escape[0] if len(escape) else 0.0) + np.full(n, 8.0)
            lower = np.full((len(known), n), 8.0)
        else:
            at = np.searchsorted(contexts[-1].codes, parents & _mask(k - 1))
            sums = escape + contexts[-1].bits[at]
            lower = below_sums[np.searchsorted(shorter.codes, known & _mask(k))]
        seen = table_ > 0
        own = np.log2((total + different)[parent].clip(min=1)) - np.log2(np.where(seen, table_, 1))
        cost = np.where(seen, own, escape[parent] + lower)
        contexts.append(Level(parents, sums))
        pairs.append(Level(known, cost - sums[parent]))
        below_sums, shorter = cost, pairs[-1]
    return Model(languages, len(counts) - 1, contexts, pairs, unseen)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of every text, one column per language."""
    out = np.zeros((len(texts), len(model.languages)))
    for rows, starts, codes in slices(texts, model.order):
        different, place = np.unique(codes, return_inverse=True)
        bits = model.bits(different)
        for language in range(bits.shape[1]):
            np.add.at(out[:, language], rows, np.add.reduceat(bits[place, language], starts))
    return out


# --- fit --------------------------------------------------------------------------------------
def sample(docs: DataFrame, lang: str, text: str, key: str) -> DataFrame:
    """(lang, text): the bounded sample the trees are fit on."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"),
    )
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    # Narrow rows only: the sampled ids of a language are ranked in two steps, then the texts are fetched.
    ids = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("size")).join(F.broadcast(common.select("lang")), "lang")
    parted = Window.partitionBy("lang", F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h")
    first = ids.withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= SAMPLE_ROWS)
    whole = Window.partitionBy("lang").orderBy("h")  # at most 64 * SAMPLE_ROWS rows a language
    before = F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = first.withColumn("place", F.row_number().over(whole)).withColumn("before", before)
    chosen = ranked.where((F.col("place") <= SAMPLE_ROWS) & (F.col("before") < SAMPLE_BYTES)).select("lang", "h")
    found = rows.join(F.broadcast(materialize(chosen, "sample-ids")), ["lang", "h"])
    return found.groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")


def run_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, k, code, n): how often runs of k + 1 bytes occur in the texts of a language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for name in dict.fromkeys(names):
                mine = [t for n, t in zip(names, texts, strict=True) if n == name]
                for _, _, codes in slices(mine, order):
                    for k in range(order + 1):
                        code, n = np.unique(codes & _mask(k + 1), return_counts=True)
                        columns = [[name] * len(code), pa.array(np.full(len(code), k, np.int32)), code.astype(np.int64), n]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "k", "code", "n"])

    counted = rows.select("lang", "text").mapInArrow(tidy(work), "lang string, k int, code bigint, n bigint")
    return counted.groupBy("lang", "k", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", order: int = ORDER) -> Model | None:
    """The model of the labelled rows of ``docs``; None when there are none."""
    counts = materialize(run_counts(sample(docs, lang, text, key), order), "runs")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # at most MOST_LANGUAGES
    if not languages:
        return None
    room = MODEL_BYTES // (16 * len(languages))
    classes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("rows")).collect()
    by_class = {r["c"]: r["rows"] for r in classes}
    least = 0
    while sum(rows for c, rows in by_class.items() if c >= least) > room:
        least += 1
    # At most MODEL_BYTES of pairs come back.
    found = counts.where(F.col("n") >= 1 << least).toArrow()
    number = {name: i for i, name in enumerate(languages)}
    language = np.array([number[name] for name in found.column("lang").to_pylist()], np.int64)
    k, code, n = (found.column(c).to_numpy() for c in ("k", "code", "n"))
    return build([(language[k == i], code[k == i].astype(np.uint64), n[k == i]) for i in range(order + 1)], languages)


# --- prediction -------------------------------------------------------------------------------
def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    spark = docs.sparkSession
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = keep.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = [t if t and _LETTER.search(t.decode("utf-8", "replace")) else b"" for t in as_bytes(batch.column(place))]
            bits = code_lengths(fitted, texts)
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
            named = [fitted.languages[b] if t else UNKNOWN for b, t in zip(best, texts, strict=True)]
            known = np.array([bool(t) for t in texts], bool)
            columns = [*batch.columns, pa.array(named, pa.string()), pa.array(np.where(known, share, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(tidy(work), f"{_ddl(rows)}, lang_pred string, score double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def held_out(key: str = "doc_id") -> Column:
    """Every fourth document, by a checksum of its id, is kept from the fit."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).drop("text")


QUERIES = {"op13_language_id": op13_language_id}
CHECKS: dict[str, str] = {}
