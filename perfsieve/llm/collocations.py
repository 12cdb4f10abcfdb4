"""Collocations: phrases whose words stand together more often than their parts suggest, by language.

Texts are lower-cased (A-Z), cut into pieces at marks and line ends and into words at spaces and tabs.
Every task counts the runs of words of its texts in a trie of word ids over burstable hash containers
(``hat_trie``), which spills whole subtrees as sorted runs. Spark deals the runs by prefix (language,
first two words, and a sixteenth of what follows, so that no prefix fills a task) and merges equal
phrases there. Runs are counted by length, 1 to ``longest`` words, a pass each: only phrases with
``least`` occurrences are written on, and a longer run is counted only if both its parts may be
such phrases, since it cannot occur more often than they do. Tasks ask a bit array over hashes of the
phrases (at most 2^``MOST_BITS`` bits); its chance hits cost time, never a result.

A candidate's score is that of its weakest cut, floor(1,000,000 a a / (l r)); products have 37 digits,
counts 14 (a larger count raises an error). Candidates inside a longer candidate with at least half of
their own count are dropped. The first ``most`` of each language are ranked among the best of 64 parts.

Null texts have no words, a null language is `und`. Empty tables and texts without phrases give no
rows; repeated rows count each time; ids are not read; extra columns are ignored. Texts are read in slices,
so that one of any length takes bounded memory (a single word is held whole).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfsieve.llm import hat_trie
from perfsieve.llm.common import as_bytes, table, tidy
from perfsieve.session import materialize
from perfsieve.skew import join_unique

LONGEST = 3
LEAST = 10
MOST = 2000
SLICE = 1 << 20
PREFIXES = 1 << 16
# Bits a frequent phrase, and at most: 64 MB.
BITS_EACH = 32
MOST_BITS = 29
SPREAD = 16
# A-Z become a-z, tabs spaces, marks and line ends the boundary.
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256)
)
_EDGE = re.compile(b"[ \xff]")


def token_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, and boundaries between its pieces, a slice at a time."""
    clean = text.translate(_CLEAN)
    at = 0
    while at < len(clean):
        edge = _EDGE.search(clean, at + SLICE) if at + SLICE < len(clean) else None
        end = edge.start() if edge else len(clean)
        yield clean[at:end].replace(hat_trie.BOUNDARY, b" \xff ").split()
        at = end


def phrase_counts(docs: DataFrame, size: int, known: Broadcast | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n): phrases of ``size`` words, all whose parts ``known`` holds; the empty phrase has the number of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = hat_trie.Counting(size, known.value if known else None) if size > 1 else hat_trie.WordCounting()
        held: dict[str, list[bytes]] = {}
        n_held = 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                tokens = held.setdefault(name, [])
                context, before = 0, len(tokens)
                cut = False
                for part in token_slices(body or b""):
                    tokens.extend(part)
                    if len(tokens) > hat_trie.CHUNK:
                        yield from counting.feed(name, tokens, context)
                        cut, context = True, min(len(tokens), size - 1)
                        n_held -= before
                        before = 0
                        tokens[:] = tokens[len(tokens) - context :]
                if cut:
                    yield from counting.feed(name, tokens, context)
                    tokens.clear()
                tokens.append(hat_trie.BOUNDARY)
                n_held += len(tokens) - before
                if n_held > hat_trie.CHUNK:
                    for other, waiting in held.items():
                        yield from counting.feed(other, waiting)
                    held, n_held = {}, 0
        for other, waiting in held.items():
            yield from counting.feed(other, waiting)
        yield from counting.finish()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), text)
    runs = rows.mapInArrow(tidy(work), "lang string, phrase string, n bigint")
    rest = [F.substring_index("phrase", " ", 2), F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))] if size > 2 else [F.col("phrase")]
    prefix = F.pmod(F.xxhash64("lang", *rest), F.lit(PREFIXES)).cast("int")
    dealt = runs.withColumn("prefix", prefix).repartition("prefix")
    return dealt.groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def known_phrases(phrases: DataFrame) -> hat_trie.Known:
    """A bit array that holds all of ``phrases`` (lang, phrase), whose phrases have equally many words."""
    n = phrases.count()
    bits = min(MOST_BITS, max(6, (n * BITS_EACH - 1).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            split = [phrase.split(b" ") for phrase in as_bytes(batch.column(1))]
            for name in dict.fromkeys(names):
                mine = [split[i] for i in np.flatnonzero(names == name)]
                words = np.array([[xxhash.xxh3_64_intdigest(w) for w in phrase] for phrase in mine], np.uint64)
                slot = hat_trie.run_hashes(name, list(words.T)) >> np.uint64(64 - bits)
                place = (slot >> np.uint64(6)).astype(np.int64)
                value = (np.uint64(1) << (slot & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(value)], names=["place", "value"])

    set_bits = phrases.select("lang", "phrase").mapInArrow(tidy(work), "place bigint, value bigint")
    found = set_bits.groupBy("place").agg(F.bit_or("value").alias("value")).toArrow()  # at most 2^(MOST_BITS - 6) rows
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("place").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return hat_trie.Known(bits, words)


def frequent_phrases(docs: DataFrame, longest: int, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of the phrases with ``least`` occurrences, (lang, n) of all words)."""
    context = docs.sparkSession.sparkContext
    first = materialize(phrase_counts(docs, 1, None, text, lang).where((F.col("n") >= least) | (F.col("phrase") == "")), "words")
    levels = [first.where("phrase <> ''")]
    for size in range(2, longest + 1):
        known = context.broadcast(known_phrases(levels[-1]))
        counted = phrase_counts(docs, size, known, text, lang).where((F.col("n") >= least) & (F.col("phrase") != ""))
        levels.append(materialize(counted, "phrases"))
        known.unpersist()
    sized = [level.withColumn("words", F.lit(i)) for i, level in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, sized), first.where("phrase = ''").select("lang", "n")


def _sub(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counted: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, words, l, r, score) of every candidate."""
    found = counted.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = found.select("lang", "phrase", "words", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit("l").alias("side"), _sub(F.col("_w"), F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), _sub(F.col("_w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
    )
    wanted = cuts.select("lang", "phrase", "words", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "words", "a", "k", "s.*")
    parts = counted.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    met = join_unique(materialize(wanted, "cuts"), parts, ["lang", "part"], "inner")
    columns = [
        F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, longest) for side in "lr"
    ]
    wide = met.groupBy("lang", "phrase", "words", "a").agg(*columns)

    def cut(k: int) -> Column:
        score = F.expr(
            f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0)))"
            f" div (cast(l{k} as decimal(14,0)) * cast(r{k} as decimal(14,0)))"
        )
        fields = F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        return F.when(F.col(f"l{k}").isNotNull(), fields)

    lowest = F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, longest)])))
    return wide.select("lang", "phrase", "words", "a", lowest.alias("c")).select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def without_covered(candidates: DataFrame, longest: int) -> DataFrame:
    """``candidates`` without those that mostly occur inside one longer candidate."""
    if longest < 3:
        return candidates
    words = F.split("phrase", " ")
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = F.flatten(
        F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: _sub(words, i, size)))
    )
    longer = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(covers, ["lang", "phrase"], "left")
    return kept.where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * 50)).drop("_longer")


def best_of_each(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best rows of each language with their rank; no task gets more than 64 times that many of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = Window.partitionBy("lang", "_part").orderBy(*order)
    first = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(parted))
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = first.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(whole))
    return ranked.where(F.col("rank") <= most).drop("_part")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, as the module's text says."""
    counted, totals = frequent_phrases(docs, longest, least, text, lang)
    candidates = materialize(scored(counted, longest), "scored")
    ranked = best_of_each(without_covered(candidates, longest), most)
    found = join_unique(ranked, totals, ["lang"], "inner")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op12_collocations": op12_collocations}
CHECKS = {
    "op12_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
g AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM w),
p AS (SELECT lang, 1 AS words, w[i] AS phrase FROM g
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM g WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM g WHERE i + 2 <= len(w)),
f AS (SELECT lang, words, phrase, count(*) AS a FROM p GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) v(k) WHERE k < words),
s AS (SELECT k.lang, k.words, k.phrase, k.a, k.k, x.a AS l, y.a AS r,
    (1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.longer IS NULL OR 100 * m.longer < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n,
    CAST(score AS BIGINT) AS score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000"""
}
