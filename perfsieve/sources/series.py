"""Metric series: one CSV file per signature, kept in folders, read as one long table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.constants import SERIES_FILE_SUFFIX
from perfsieve.session import materialize
from perfsieve.skew import join_unique
from perfsieve.sources.files import as_null, file_listing

# .../<folder>/<signature>_timeseries_data.csv, the file possibly being a folder Spark wrote.
_PATH = rf"(?:^|/)(?:folder=)?([^/]+)/(?:file=)?([^/]+){SERIES_FILE_SUFFIX.replace('.', '[.]')}(?:/part-[^/]*)?$"
POINT_COLUMNS = ["push_id", "revision", "value", "seq"]
SERIES_KEYS = ["folder", "signature_id"]


def _keys_from(path):
    return (
        F.regexp_extract(path, _PATH, 1).alias("folder"),
        F.regexp_extract(path, _PATH, 2).try_cast("bigint").alias("signature_id"),
    )


def series_paths(spark: SparkSession, root: str, pattern: str = f"*{SERIES_FILE_SUFFIX}") -> DataFrame:
    """folder, signature_id, path, modificationTime, length of every series file; no content is read."""
    listed = file_listing(spark, root, pattern)
    keyed = listed.select(*_keys_from(F.col("path")), "path", "modificationTime", "length")
    return keyed.where(F.col("signature_id").isNotNull())


def series_files(spark: SparkSession, root: str, pattern: str = f"*{SERIES_FILE_SUFFIX}") -> DataFrame:
    """folder, signature_id of every series file; names that are not an integer id are skipped."""
    return series_paths(spark, root, pattern).select(*SERIES_KEYS).distinct()


def series_states(spark: SparkSession, root: str, pattern: str = f"*{SERIES_FILE_SUFFIX}") -> DataFrame:
    """folder, signature_id, state: a fingerprint that changes with any file of the series."""
    mark = F.xxhash64("path", "modificationTime", "length")
    files = series_paths(spark, root, pattern).groupBy(*SERIES_KEYS)
    state = F.concat_ws("-", F.count(F.lit(1)), F.sum("length"), F.hex(F.bit_xor(mark)))
    return files.agg(state.alias("state"))


def as_literal(path: str) -> str:
    """A path whose characters are not taken for a glob."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _named_columns(spark: SparkSession, root: str | list[str], pattern: str) -> DataFrame:
    """(path, names) of every file whose first line names a value column, in that line's order."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    lines = reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    named = lines.where((F.col("at") == 0) & F.col("value").rlike(r'(^|,)\s*"?value"?\s*(,|$)'))
    # Points hold numbers and hashes; a line that names the value column can only be a header.
    headers = named.groupBy("path").agg(F.min("value").alias("header"))
    # A comma inside quotes belongs to a name.
    parts = F.split("header", ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return headers.select("path", F.transform(parts, lambda n: F.trim(F.regexp_replace(n, '^\\s*"|"\\s*$', ""))).alias("names"))


def _place(name: str) -> Column:
    """Where ``names`` has a name first, counted from 0; null without it."""
    return (F.nullif(F.array_position("names", name), F.lit(0)) - 1).cast("int")


def _raw_fields(spark: SparkSession, root: str | list[str], pattern: str, width: int) -> DataFrame:
    """(path, file keys, fields, read order) of every line after the first of each file."""
    fields = [f"_field_{i}" for i in range(width)]
    raw = (
        spark.read.schema(", ".join(f"{n} string" for n in fields))
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .csv(root)
    )
    path = F.col("_metadata.file_path")
    return raw.select(
        path.alias("path"), *_keys_from(path), F.array(*fields).alias("_fields"), F.monotonically_increasing_id().alias("_read")
    )


def scan_series(spark: SparkSession, root: str | list[str], pattern: str = f"*{SERIES_FILE_SUFFIX}") -> DataFrame:
    """All points of all files (below a folder, or listed) as text: folder, signature_id, push_id, revision, value, seq.

    Columns are found by the header of each file, in whatever order it names them; a file whose first
    line names no value column has no points. One pass finds the headers and one reads the points,
    however many different headers there are: the fields of a line are taken by their file's places.
    """
    places = {c: _place(c) for c in POINT_COLUMNS}
    headers = _named_columns(spark, root, pattern).select("path", F.size("names").alias("_width"), *[p.alias(f"_at_{c}") for c, p in places.items()])
    headers = materialize(headers, "series-headers")
    at = [f"_at_{c}" for c in POINT_COLUMNS]
    # One row whatever the number of files: how wide the widest is, and whether all agree.
    spans = [how(c).alias(f"{c}{mark}") for c in at for how, mark in [(F.min, ""), (F.max, "_max"), (F.count, "_n")]]
    seen = headers.agg(F.max("_width").alias("width"), F.count(F.lit(1)).alias("n"), *spans).first()
    raw = _raw_fields(spark, root, pattern, seen["width"] or 1)
    alike = all(seen[c] == seen[f"{c}_max"] and seen[f"{c}_n"] in (0, seen["n"]) for c in at)
    if alike and seen["n"] == file_listing(spark, root, pattern).count():
        # Every file has its columns at the same places.
        placed = raw.withColumns({c: F.lit(seen[c]).cast("int") for c in at})
    else:
        placed = join_unique(raw, headers.drop("_width"), ["path"], "inner")
    field = {c: F.get("_fields", F.col(f"_at_{c}")) for c in POINT_COLUMNS}
    # Files without a seq column keep the order of their lines.
    order = F.when(F.col("_at_seq").isNull(), F.col("_read")).otherwise(field["seq"].try_cast("bigint"))
    values = [as_null(field[c]).alias(c) for c in ["push_id", "revision", "value"]]
    return placed.where(F.col("signature_id").isNotNull()).select(*SERIES_KEYS, *values, order.alias("seq"))


def clean_points(points: DataFrame, need_push: bool = False) -> DataFrame:
    """Numeric push_id and value; rows without a value, and if asked without a push, are dropped."""
    typed = points.withColumns(
        {"value": F.col("value").try_cast("double"), "push_id": F.col("push_id").try_cast("double")}
    )
    kept = typed.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.where(F.col("push_id").isNotNull() & ~F.isnan("push_id")) if need_push else kept


def catalog_report(files: DataFrame) -> DataFrame:
    """Per folder: number of series; per whole: unique signatures, and those in several folders."""
    per_folder = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    per_signature = files.groupBy("signature_id").agg(F.count(F.lit(1)).alias("folders"))
    totals = per_signature.agg(
        F.count(F.lit(1)).alias("unique_signatures"),
        F.count(F.when(F.col("folders") > 1, F.lit(1))).alias("signatures_in_several_folders"),
    )
    rows = totals.selectExpr(
        "stack(2, 'unique_signatures', unique_signatures,"
        " 'signatures_in_several_folders', signatures_in_several_folders) AS (item, n)"
    )
    return per_folder.select(F.concat(F.lit("folder:"), "folder").alias("item"), "n").unionByName(rows)


def write_series(points: DataFrame, root: str) -> None:
    """Series files in the readable layout; a large series spans several part files."""
    named = points.withColumn("file", F.concat(F.col("signature_id").cast("string"), F.lit(SERIES_FILE_SUFFIX)))
    columns = ["folder", "file", "push_id", "revision", "value", "seq"]
    placed = named.select(*columns).repartitionByRange("folder", "file", "seq")
    placed.write.mode("overwrite").option("header", "true").partitionBy("folder", "file").csv(root)
