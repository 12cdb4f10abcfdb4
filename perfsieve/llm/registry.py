"""The queries of this subpackage and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "token_orc",
    "chat_tree",
    "exact_dedup",
    "toxicity",
    "warc_archive",
    "decontaminate",
    "licenses",
    "pseudonyms",
    "ngram_join",
    "mixing",
    "whitening",
    "language_id",
    "collocations",
]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= importlib.import_module(f"perfsieve.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"perfsieve.llm.{name}").CHECKS
    return found
