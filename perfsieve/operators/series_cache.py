"""Window features kept between runs, by series file.

A row of the cache belongs to one (series, push) and to the state its files had: a fingerprint of their
paths, times and sizes. A run asks for its own (series, push) rows, takes those whose files have not
changed, reads only the series that lack one, and appends what it computed. Rows of older states match
nothing any more; ``compact`` drops them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.operators import series
from perfsieve.session import materialize, setting
from perfsieve.skew import join_unique
from perfsieve.sources import files as sources
from perfsieve.sources import series as source
from perfsieve.sources.series import SERIES_KEYS

STATE = [*SERIES_KEYS, "state"]
ROW = [*STATE, "anchor"]
# So many changed files are read by name; with more of them the whole folder is read and filtered.
NAMED_FILES = 10_000


def cache_folder(cache_root: str, file_order: bool) -> str:
    """One folder for each rule and set of windows."""
    rule = json.dumps({"file_order": file_order, "scales": C.WINDOW_SCALES, "metrics": C.WINDOW_METRICS, "version": 1})
    return f"{cache_root.rstrip('/')}/windows-{hashlib.sha256(rule.encode()).hexdigest()[:16]}"


def _known(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of earlier runs; equal rows of runs at the same time count once."""
    if not sources.exists(spark, f"{folder}/_SUCCESS"):
        return None
    return spark.read.parquet(folder).dropDuplicates(ROW)


def _points(spark: SparkSession, root: str, wanted: DataFrame, file_order: bool) -> DataFrame:
    """Cleaned points of the ``wanted`` series (distinct keys), from their files only."""
    paths = source.series_paths(spark, root).join(wanted, SERIES_KEYS, "left_semi").select("path")
    most = setting(spark, "namedFiles", NAMED_FILES)
    named = [r["path"] for r in paths.limit(most + 1).collect()]
    if len(named) <= most:
        raw = source.scan_series(spark, [source.as_literal(p) for p in named])
    else:
        # One row a series against its points; semi-joined keys are few beside them.
        raw = join_unique(source.scan_series(spark, root), wanted, SERIES_KEYS, "inner")
    return source.clean_points(raw, need_push=not file_order)


def window_features(spark: SparkSession, root: str, cache_root: str, pairs: DataFrame, file_order: bool = False) -> DataFrame:
    """``series.window_features`` of the series files below ``root``, computing only what is new or changed."""
    states = materialize(source.series_states(spark, root), "series-states")
    resolved = series.resolve_series(materialize(pairs, "pairs"), states.select(*SERIES_KEYS)).where(F.col("folder").isNotNull())
    resolved = materialize(resolved.withColumn("anchor", F.col("anchor").cast("double")), "resolved-pairs")
    asked = resolved.where(F.col("anchor").isNotNull()).select(*SERIES_KEYS, "anchor").distinct()
    asked = materialize(asked.join(states, SERIES_KEYS), "asked-windows")
    folder = cache_folder(cache_root, file_order)
    known = _known(spark, folder)
    missing = asked if known is None else asked.join(known.select(*ROW), ROW, "left_anti")
    missing = materialize(missing, "missing-windows")
    if not missing.isEmpty():
        points = materialize(_points(spark, root, missing.select(*SERIES_KEYS).distinct(), file_order), "points")
        found = series.anchor_features(points, missing, file_order)
        # A push before the first point has a row too, without a position, so that no run asks again.
        missing.join(found, [*SERIES_KEYS, "anchor"], "left").write.mode("append").parquet(folder)
        known = _known(spark, folder)
    if known is None:
        return series.without_windows(resolved)
    current = known.join(states, STATE, "left_semi").drop("state")
    return join_unique(resolved, current, [*SERIES_KEYS, "anchor"])


def compact(spark: SparkSession, root: str, cache_root: str, file_order: bool = False) -> None:
    """Write the cache anew with the rows of the files' present states only."""
    folder = cache_folder(cache_root, file_order)
    known = _known(spark, folder)
    if known is not None:
        kept = materialize(known.join(source.series_states(spark, root), STATE, "left_semi"), "kept-windows")
        kept.write.mode("overwrite").parquet(folder)
