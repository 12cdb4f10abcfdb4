"""Mixing sources to target weights: temperature, then budgeted block permutations.

Weights are the token shares raised to an exponent and normalised. The exponent comes from a
bisection over [0, 1] (1 keeps the natural shares, 0 makes all sources equal) towards a target
entropy or a limit on how often a source may be repeated. Every source then gets its weight's share
of the token budget: whole passes over all its documents, and for the rest a prefix of a keyed
permutation of its blocks, cut to the token inside one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from perfsieve.llm.common import fresh, join_by_size, table
from perfsieve.session import materialize

SEED = "mix-1"
DOCS_PER_BLOCK = 1000
MAX_BLOCKS = 65_536
# Bits of a document's place inside its source; times MAX_BLOCKS it stays below 2^63.
PLACE_BITS = 44
# Exponents are found to 2^-32 and then rounded up to this many digits.
DIGITS = 9
FEW_SOURCES = 100_000
FEW_ROWS = 1_000_000


@dataclass(frozen=True)
class Target:
    """What the weights must meet; exactly one of the two limits is set.

    ``max_repeats``: no source is used more often than this on average; the flattest such weights
    are taken. ``min_entropy``: share of the greatest possible entropy (log of the number of
    sources); the weights nearest the natural shares that reach it are taken. ``budget_share`` is
    the budget as a share of all tokens; None takes the least budget with which every document is
    used at least once.
    """

    max_repeats: float | None = None
    min_entropy: float | None = None
    budget_share: float | None = 1.0


def word_tokens(text: Column) -> Column:
    """The token measure used here: pieces between spaces, plus one for the end of the document."""
    safe = F.coalesce(text, F.lit(""))
    return (F.octet_length(safe) - F.octet_length(F.replace(safe, F.lit(" "))) + 2).cast("long")


def _hash_number(bits: int, *parts: Column) -> Column:
    """The first bits (a multiple of four) of a SHA-256 over parts joined by '|', as a number."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, bits // 4), 16, 10).cast("long")


def _at(sources: DataFrame, exponents: list[float]) -> dict[float, tuple]:
    """Per exponent: sum of p^a, sum of p^a ln p, least and greatest p^(a-1), number of sources."""
    grid = F.explode(F.array(*[F.lit(e) for e in exponents])).alias("a")
    power = F.pow("p", F.col("a"))
    ratio = F.pow("p", F.col("a") - 1)
    found = (
        sources.select("p", grid)
        .groupBy("a")
        .agg(
            F.sum(power).alias("z"),
            F.sum(power * F.log("p")).alias("s"),
            F.min(ratio).alias("low"),
            F.max(ratio).alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return {r["a"]: tuple(r)[1:] for r in found.collect()}


def _meets(target: Target, facts: tuple, a: float) -> bool:
    z, s, low, high, n = facts
    if target.min_entropy is not None:
        return math.log(z) - a * s / z >= target.min_entropy * math.log(n) - 1e-12
    used = high / low if target.budget_share is None else target.budget_share * high / z
    return used <= target.max_repeats + 1e-12


def find_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for per-source shares ``p``, by bisection, four halvings in each job.

    Repeats fall and entropy falls as the exponent grows. So a repeat limit asks for the least
    exponent that meets it, an entropy for the greatest. A limit that cannot be met raises.
    """
    if (target.max_repeats is None) == (target.min_entropy is None):
        raise ValueError("set max_repeats or min_entropy")
    least = target.min_entropy is None
    ends = _at(sources, [0.0, 1.0])
    best, other = (0.0, 1.0) if least else (1.0, 0.0)
    if _meets(target, ends[best], best):
        return best
    if not _meets(target, ends[other], other):
        raise ValueError("no exponent between 0 and 1 meets the target")
    bad, good = best, other
    for _ in range(8):
        grid = [bad + (good - bad) * i / 16 for i in range(1, 16)]
        facts = _at(sources, grid)
        met = next((i for i, a in enumerate(grid) if _meets(target, facts[a], a)), len(grid))
        points = [bad, *grid, good]
        bad, good = points[met], points[met + 1]
    step = 10.0**-DIGITS
    return min(1.0, round(round(good, DIGITS) + (step if least else -step), DIGITS))


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, source, n_tokens, block, place, weight, copies.

    ``copies`` is how often the document is used; ``block`` and ``place`` give its block and its
    place in the source's keyed order. A null source is a source of its own, null texts are empty
    (two tokens: an empty piece and the end). Rows without an id are placed by their text. Rows that repeat id, source and text share one place; they are ordered
    by length and used alike or not, up to the budget. An empty table gives an empty result; other
    columns are not read. The table of sources is broadcast up to 100,000 sources, joined beyond.
    """
    named = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    no_id = F.concat(F.lit("null"), F.xxhash64(text_col).cast("string"))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            named.alias("key"),
            word_tokens(F.col(text_col)).alias("n_tokens"),
            F.xxhash64(text_col).alias("text_hash"),
            _hash_number(PLACE_BITS, F.coalesce(F.col(id_col).cast("string"), no_id)).alias("place"),
        ),
        "mix-rows",
    )
    totals = materialize(
        rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources"
    )
    whole, n_sources = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    exponent, z, low = 1.0, 1.0, 1.0
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(whole or 1)))
    if n_sources:
        exponent = find_exponent(shares, target)
        z, _, low, _, _ = _at(shares, [exponent])[exponent]
    budget = float(whole or 0) * (z / low if target.budget_share is None else target.budget_share)
    weight = F.pow("p", F.lit(exponent)) / F.lit(z)
    quota = F.round(weight * F.lit(budget)).cast("long")
    quotas = shares.select(
        "key",
        "docs",
        weight.alias("weight"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / DOCS_PER_BLOCK)).cast("long").alias("n_blocks"),
        F.round((quota - F.pmod(quota, F.col("tokens"))) / F.col("tokens")).cast("long").alias("passes"),
        F.pmod(quota, F.col("tokens")).alias("rest"),
    )
    if n_sources <= FEW_SOURCES:
        placed = rows.join(F.broadcast(quotas), "key")
    else:
        placed = join_by_size(rows, materialize(quotas, "mix-quotas"), "key", "docs", F.col("place"))
    placed = placed.withColumn("block", F.shiftright(F.col("place") * F.col("n_blocks"), PLACE_BITS))
    inside = Window.partitionBy("key", "block").orderBy("place", "id", "n_tokens")
    ordered = placed.withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = placed.groupBy("key", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    # Blocks of one source: 65,536 rows at most, whatever the number of its documents.
    turn = Window.partitionBy("key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("turn", _hash_number(PLACE_BITS, F.col("key"), F.col("block"))).select(
        "key", "block", F.coalesce(F.sum("block_tokens").over(turn), F.lit(0)).alias("before")
    )
    both = ordered.join(before, ["key", "block"])
    extra = (F.col("before") + F.col("upto") <= F.col("rest")).cast("long")
    return both.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "n_tokens",
        "block",
        "place",
        F.round("weight", 6).alias("weight"),
        (F.col("passes") + extra).alias("copies"),
        *(["text_hash"] if keep_text_hash else []),
    )


def repeat_rows(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, whole and unchanged, each as often as ``mix`` says.

    Rows meet their count by id, a hash of their text and source; equal rows get the same count,
    the mean of theirs rounded down where the budget ended between them.
    """
    counts = mix(docs, target, id_col, text_col, source_col, keep_text_hash=True)
    m_id, m_source, m_hash, m_copies = (fresh(docs, f"_mixed_{c}") for c in ("id", "source", "hash", "copies"))
    counts = counts.groupBy(F.col(id_col).alias(m_id), F.col(source_col).alias(m_source), F.col("text_hash").alias(m_hash)).agg(
        F.floor(F.avg("copies")).cast("int").alias(m_copies)
    )
    counts = materialize(counts, "mix-counts")
    # The usual row is used once and needs no partner; only the others are looked up.
    few = counts.where(F.col(m_copies) != 1)
    if few.count() <= FEW_ROWS:
        few = F.broadcast(few)
    key = fresh(docs, "_text_hash")
    rows = docs.withColumn(key, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(m_id)) & F.col(source_col).eqNullSafe(F.col(m_source)) & (F.col(key) == F.col(m_hash))
    n = F.coalesce(F.col(m_copies), F.lit(1))
    often = rows.join(few, same, "left").where(n > 0).withColumn(fresh(docs, "_times"), F.explode(F.sequence(F.lit(1), n)))
    return often.select(*[F.col(f"`{c}`") for c in docs.columns])


# The registered query: sources flattened until one would be read 1.25 times, within today's token count.
QUERY_TARGET = Target(max_repeats=1.25)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), QUERY_TARGET)


QUERIES = {"op10_mix_sources": _query}
CHECKS = {
    "op10_mix_sources": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS key,
    CAST(strlen(coalesce(text, '')) - strlen(replace(coalesce(text, ''), ' ', '')) + 2 AS BIGINT) AS n_tokens,
    CAST('0x' || substr(sha256('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 11) AS BIGINT) AS place
  FROM documents
), t AS (SELECT key, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM d GROUP BY key),
s AS (SELECT *, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM t) AS p FROM t),
halving AS (
  SELECT 0 AS step, 0e0 AS bad, 1e0 AS good,
    (SELECT max(pow(p, -1e0)) / count(*) FROM s) <= 1.25 + 1e-12 AS flat
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN bad ELSE mid END, CASE WHEN ok THEN mid ELSE good END, flat FROM (
    SELECT step, bad, good, flat, (bad + good) / 2 AS mid,
      (SELECT max(pow(p, (bad + good) / 2 - 1)) / sum(pow(p, (bad + good) / 2)) FROM s) <= 1.25 + 1e-12 AS ok
    FROM halving WHERE step < 32)
), e AS (
  SELECT CASE WHEN flat THEN 0e0 ELSE least(1e0, round(round(good, 9) + 1e-9, 9)) END AS a FROM halving WHERE step = 32
), w AS (
  SELECT key, tokens, docs, pow(p, a) / (SELECT sum(pow(p, (SELECT a FROM e))) FROM s) AS weight FROM s, e
), q AS (
  SELECT key, tokens, weight, least({MAX_BLOCKS}, CAST(ceil(docs / {DOCS_PER_BLOCK}.0) AS BIGINT)) AS n_blocks,
    CAST(round(weight * (SELECT CAST(sum(tokens) AS DOUBLE) FROM t)) AS BIGINT) AS quota FROM w
), b AS (
  SELECT d.*, q.weight, q.quota // q.tokens AS passes, q.quota % q.tokens AS rest, (d.place * q.n_blocks) >> {PLACE_BITS} AS block
  FROM d JOIN q ON d.key = q.key
), o AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY key, block ORDER BY place, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM b
), k AS (
  SELECT key, block, coalesce(sum(block_tokens) OVER (PARTITION BY key ORDER BY turn, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT key, block, sum(n_tokens) AS block_tokens,
      CAST('0x' || substr(sha256('{SEED}|' || key || '|' || block), 1, 11) AS BIGINT) AS turn FROM b GROUP BY key, block)
)
SELECT o.doc_id, o.source, o.n_tokens, o.block, o.place, round(o.weight, 6) AS weight,
  CAST(o.passes + CASE WHEN k.before + o.upto <= o.rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o JOIN k ON o.key = k.key AND o.block = k.block
"""
}
