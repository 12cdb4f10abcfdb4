"""A training-data pipeline over ``documents``: five stages, each on all that the one before it kept.

Every stage is written as Parquet and read again before the next begins, so a lost executor or a
failed stage never repeats an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm import decontaminate, mixing, ngram_join, token_orc, toxicity
from perfsieve.llm.common import table
from perfsieve.session import materialize

# No source is read more than 1.25 times as often as another, and every document at least once.
MIX_TARGET = mixing.Target(max_repeats=1.25, budget_share=None)

# Python workers go from stage to stage, so this one must leave them room.
TOKEN_MEMO = 50_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_class(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for; copies are equal rows."""
    return mixing.repeat_rows(docs, MIX_TARGET)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_orc.tokenised(docs, memo=TOKEN_MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]
# Fitting, similarity and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
