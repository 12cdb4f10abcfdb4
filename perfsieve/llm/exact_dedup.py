"""Exact duplicates, found by combining rows in three steps that each compare whole texts.

1. Every map task merges its own equal texts (the partial aggregate on digest and text).
2. Groups are merged per (digest, salt): rows of a text that half the corpus repeats arrive in
   ``salts`` tasks, as one row per map task at most.
3. The winners of the salts are combined per digest.

The text is a grouping key in every step, so a digest only places rows and never decides that two
texts are equal. Afterwards rows find their group by digest alone; where two texts share a digest
(never seen with SHA-256, possible with a weaker one) they find it by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm.common import join_by_size, table
from perfsieve.session import materialize

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def label_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = 16,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The smallest non-null id of a group is kept; a group without any id
    has a null keep_id and kept is false. Rows that repeat both id and text are all marked alike
    (``survivors`` leaves one of them). An empty table gives an empty result; other columns of
    ``docs`` are not read. ``digest`` must give non-null text.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = salted.groupBy("digest", "text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    winners = materialize(groups.select("digest", "keep_id", "group_size"), "exact-groups")
    shared = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if shared.isEmpty():
        narrow = rows.select("id", "digest", sha256(F.col("text")).alias("text_sha256"))
        placed = join_by_size(narrow, winners, "digest", "group_size", F.xxhash64("id"))
    else:
        placed = rows.join(groups, ["digest", "text"]).withColumn("text_sha256", sha256(F.col("text")))
    return placed.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept ids, once each, with the digest of their text."""
    return label_copies(docs, id_col, text_col).where("kept").select(id_col, "text_sha256").dropDuplicates()


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": _query}
CHECKS = {
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
}
