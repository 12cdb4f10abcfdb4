"""Queries on sources, the alert summary and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.operators import summary
from perfsieve.plans import proxies as P
from perfsieve.plans.registry import comparable, query, sql_round
from perfsieve.session import work_folder
from perfsieve.sources import files, series

ID = C.SUMMARY_ID
TIMES = {"push_timestamp", "alert_summary_creation_timestamp"}
TRUTHS = {
    "single_alert_is_regression",
    "single_alert_manually_created",
    "single_alert_series_signature_lower_is_better",
    "single_alert_series_signature_has_subtests",
}


def sql_plain(column: str, expression: str | None = None) -> str:
    """Check-side form of one alert column in the types of ``comparable``."""
    e = expression or column
    if column in TIMES:
        return f"epoch_us({e})"
    if column in TRUTHS:
        return f"CAST(CAST({e} AS INTEGER) AS BIGINT)"
    if column in C.NUMERIC_COLUMNS + C.NOTEBOOK_EXTRA_NUMERIC:
        return sql_round(e)
    return e


# --- sources -------------------------------------------------------------------------------
SCANNED = [
    ID,
    C.BUG_NUMBER,
    "seq",
    C.SIGNATURE_ID,
    *TIMES,
    C.REPOSITORY,
    C.ANCHOR_REVISION,
    C.ANCHOR_PUSH,
    C.NOTES,
    "alert_summary_related_alerts",
    *C.NUMERIC_COLUMNS,
    *sorted(TRUTHS),
    "single_alert_backfill_record_context",
    "single_alert_series_signature_machine_platform",
]
_EMPTY_IS_NULL = {"alert_summary_related_alerts"}


@query(
    "scan_alerts",
    "SELECT "
    + ", ".join((f"nullif({c}, '')" if c in _EMPTY_IS_NULL else sql_plain(c)) + f" AS {c}" for c in SCANNED)
    + f" FROM ({P.alerts_sql(SCANNED)})",
)
def scan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "alerts") + "/alerts_data.csv"
    writer = P.alerts(spark, sf_dir, SCANNED).write.option("header", "true").option("escape", '"')
    # A file with line breaks inside quotes is one task's anyway, packed or not.
    writer = writer.option("compression", "gzip")
    writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return comparable(files.read_alerts(spark, path))


@query("scan_series", f"SELECT folder, signature_id, push_id, revision, {sql_round('value')} AS value FROM ({P.series_sql()})")
def scan_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "timeseries-data")
    series.write_series(P.series(spark, sf_dir), root)
    points = series.clean_points(series.scan_series(spark, root, "*.csv"))
    plain = points.withColumn("push_id", F.col("push_id").cast("bigint")).drop("seq")
    return comparable(plain)


DIRTY_SERIES = {
    **P.SERIES_COLUMNS,
    "push_id": "CASE WHEN event_id % 19 = 0 THEN 'n/a' ELSE CAST(event_id AS STRING) END",
    "value": "CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 29 = 0 THEN NULL ELSE CAST(value AS STRING) END",
}
DIRTY_SERIES_SQL = f"SELECT {P.listing(DIRTY_SERIES)} FROM events"


def dirty_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in DIRTY_SERIES.items()])


@query(
    "series_clean",
    f"""SELECT folder, signature_id, seq, TRY_CAST(push_id AS DOUBLE) AS push_id, revision,
        {sql_round('TRY_CAST(value AS DOUBLE)')} AS value
        FROM ({DIRTY_SERIES_SQL}) WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL""",
)
def series_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(series.clean_points(dirty_series(spark, sf_dir)))


CATALOG_SQL = f"""
WITH f AS (SELECT DISTINCT folder, signature_id FROM ({P.series_sql()})),
     s AS (SELECT signature_id, count(*) AS folders FROM f GROUP BY signature_id)
SELECT 'folder:' || folder AS item, count(*) AS n FROM f GROUP BY folder
UNION ALL SELECT 'unique_signatures', count(*) FROM s
UNION ALL SELECT 'signatures_in_several_folders', count(*) FROM s WHERE folders > 1
"""


@query("series_catalog", CATALOG_SQL)
def series_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = P.series(spark, sf_dir).select(*series.SERIES_KEYS).distinct()
    return comparable(series.catalog_report(listed))


@query(
    "feature_cache_roundtrip",
    f"SELECT folder, signature_id, count(*) AS n, {sql_round('avg(value)')} AS mean_value FROM ({P.series_sql()}) GROUP BY ALL",
)
def feature_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "derived-features")
    parameters = {"version": files.input_version(spark, sf_dir, "events.parquet"), "columns": ["n", "mean_value"]}

    def build() -> DataFrame:
        points = P.series(spark, sf_dir)
        return points.groupBy(*series.SERIES_KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))

    files.cached(spark, root, "series-stats", parameters, build)
    return comparable(files.cached(spark, root, "series-stats", parameters, build))


# --- parts of the summary ------------------------------------------------------------------
FIRSTS = ["alert_summary_push_id", "alert_summary_notes", C.BUG_NUMBER, "single_alert_prev_value"]


@query(
    "agg_first_non_null",
    f"SELECT {ID}, "
    + ", ".join(f"{sql_plain(c, f'arg_min({c}, seq) FILTER ({c} IS NOT NULL)')} AS {c}" for c in FIRSTS)
    + f" FROM ({P.alerts_sql([ID, 'seq', *FIRSTS])}) GROUP BY {ID}",
)
def agg_first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.alerts(spark, sf_dir, [ID, "seq", *FIRSTS])
    return comparable(rows.groupBy(ID).agg(*[summary.first_non_null(c, "seq").alias(c) for c in FIRSTS]))


def sql_stats(c: str) -> str:
    return ", ".join(
        f"{sql_round(f'{f}({c})')} AS {c}__{n}"
        for n, f in [("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_samp")]
    )


def sql_p90(c: str) -> str:
    return f"{sql_round(f'quantile_cont(CAST({c} AS DOUBLE), 0.9)')} AS {c}__p90"


@query(
    "agg_numeric_stats",
    f"SELECT {ID}, {', '.join(sql_stats(c) for c in C.NUMERIC_COLUMNS)} "
    f"FROM ({P.alerts_sql([ID, *C.NUMERIC_COLUMNS])}) GROUP BY {ID}",
)
def agg_numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.alerts(spark, sf_dir, [ID, *C.NUMERIC_COLUMNS])
    return comparable(rows.groupBy(ID).agg(*summary.numeric_stats(C.NUMERIC_COLUMNS)))


@query(
    "agg_p90",
    f"SELECT {ID}, {', '.join(sql_p90(c) for c in C.NUMERIC_COLUMNS)} "
    f"FROM ({P.alerts_sql([ID, *C.NUMERIC_COLUMNS])}) GROUP BY {ID}",
)
def agg_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(summary.percentile_90(P.alerts(spark, sf_dir, [ID, *C.NUMERIC_COLUMNS]), ID, C.NUMERIC_COLUMNS))


def sql_profiles(columns: list[str], source: str, key: str = ID) -> str:
    """CTEs ``m0, m1, ..`` with the mode (first seen on ties) and distinct count of each column."""
    return ", ".join(
        f"""m{i} AS (SELECT {key}, arg_min(v, rn) AS mode_value, count(*) AS n_values FROM (
            SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first_seen) AS rn FROM (
            SELECT {key}, {c} AS v, count(*) AS n, min(seq) AS first_seen FROM {source}
            WHERE {c} IS NOT NULL GROUP BY {key}, {c})) GROUP BY {key})"""
        for i, c in enumerate(columns)
    )


def sql_profile_query(columns: list[str], mode: bool, nunique: bool) -> str:
    outputs, joins = [], []
    for i, c in enumerate(columns):
        if mode:
            outputs.append(f"{sql_plain(c, f'm{i}.mode_value')} AS {c}__mode")
        if nunique:
            outputs.append(f"coalesce(m{i}.n_values, 0) AS {c}__nunique")
        joins.append(f"LEFT JOIN m{i} ON ids.{ID} = m{i}.{ID}")
    return (
        f"WITH a AS ({P.alerts_sql([ID, 'seq', *columns])}), ids AS (SELECT DISTINCT {ID} FROM a), "
        f"{sql_profiles(columns, 'a')} SELECT ids.{ID}, {', '.join(outputs)} FROM ids {' '.join(joins)}"
    )


PROFILED = C.CATEGORY_COLUMNS[:4] + ["single_alert_series_signature_suite", "single_alert_series_signature_test"]


def _profile(spark: SparkSession, sf_dir: str, modes: list[str], counts: list[str]) -> DataFrame:
    columns = modes or counts
    return summary.category_profile(P.alerts(spark, sf_dir, [ID, "seq", *columns]), [ID], "seq", modes, counts)


# Columns of the two profile queries hold a value in every summary, so no summary lacks its row.
@query("agg_mode", sql_profile_query(PROFILED, True, False))
def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_profile(spark, sf_dir, PROFILED, []))


@query("agg_nunique", sql_profile_query([*PROFILED, C.SIGNATURE_ID], False, True))
def agg_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_profile(spark, sf_dir, [], [*PROFILED, C.SIGNATURE_ID]))


@query(
    "agg_label",
    f"""SELECT {ID}, CAST(CAST(bool_or({C.BUG_NUMBER} IS NOT NULL) AS INTEGER) AS BIGINT) AS bug_created,
        arg_min({C.BUG_NUMBER}, seq) FILTER ({C.BUG_NUMBER} IS NOT NULL) AS bug_id
        FROM ({P.alerts_sql([ID, 'seq', C.BUG_NUMBER])}) GROUP BY {ID}""",
)
def agg_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.alerts(spark, sf_dir, [ID, "seq", C.BUG_NUMBER]).groupBy(ID)
    return comparable(
        rows.agg(
            F.bool_or(F.col(C.BUG_NUMBER).isNotNull()).alias(C.LABEL),
            summary.first_non_null(C.BUG_NUMBER, "seq").alias(C.BUG_ID),
        )
    )


@query("signature_lists", f"SELECT DISTINCT {ID}, {C.SIGNATURE_ID} FROM ({P.alerts_sql([ID, C.SIGNATURE_ID])})")
def signature_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(summary.signature_list(P.alerts(spark, sf_dir, [ID, C.SIGNATURE_ID])))


def alert_summary_sql() -> str:
    """The summary table with raw types, for checks that build on it."""
    profiled = [*C.CATEGORY_COLUMNS, C.SIGNATURE_ID]
    firsts = ", ".join(f"arg_min({c}, seq) FILTER ({c} IS NOT NULL) AS {c}" for c in C.SUMMARY_COLUMNS)
    numbers = ", ".join(
        f"avg({c}) AS {c}__mean, max({c}) AS {c}__max, min({c}) AS {c}__min, stddev_samp({c}) AS {c}__std, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.9) AS {c}__p90"
        for c in C.NUMERIC_COLUMNS
    )
    outputs, joins = [], []
    for i, c in enumerate(profiled):
        if c != C.SIGNATURE_ID:
            outputs.append(f"m{i}.mode_value AS {c}__mode")
        outputs.append(f"coalesce(m{i}.n_values, 0) AS {c}__nunique")
        joins.append(f"LEFT JOIN m{i} ON base.{ID} = m{i}.{ID}")
    return f"""
    WITH a AS ({P.alerts_sql()}), base AS (
        SELECT {ID}, {firsts}, {numbers}, count(*) AS n_single_alerts,
            bool_or({C.BUG_NUMBER} IS NOT NULL) AS bug_created,
            arg_min({C.BUG_NUMBER}, seq) FILTER ({C.BUG_NUMBER} IS NOT NULL) AS bug_id
        FROM a GROUP BY {ID}), {sql_profiles(profiled, 'a')}
    SELECT base.*, {', '.join(outputs)},
        (isodow(push_timestamp) - 1) AS push_dow, hour(push_timestamp) AS push_hour,
        CASE WHEN isodow(push_timestamp) >= 6 THEN 1 ELSE 0 END AS push_is_weekend,
        coalesce(length(alert_summary_notes), 0) AS notes_len_chars,
        coalesce(len(regexp_extract_all(alert_summary_notes, '\\S+')), 0) AS notes_len_words
    FROM base {' '.join(joins)}
    """


def _summary_outputs() -> str:
    out = [ID]
    for c in C.SUMMARY_COLUMNS:
        out.append(f"{sql_plain(c)} AS {c}")
    for c in C.NUMERIC_COLUMNS:
        out += [f"{sql_round(f'{c}__{s}')} AS {c}__{s}" for s in ["mean", "max", "min", "std", "p90"]]
    for c in C.CATEGORY_COLUMNS:
        out += [f"{sql_plain(c, f'{c}__mode')} AS {c}__mode", f"{c}__nunique"]
    out += [f"{C.SIGNATURE_ID}__nunique", "n_single_alerts", "CAST(CAST(bug_created AS INTEGER) AS BIGINT) AS bug_created"]
    out += ["bug_id", "CAST(push_dow AS BIGINT) AS push_dow", "CAST(push_hour AS BIGINT) AS push_hour"]
    out += ["CAST(push_is_weekend AS BIGINT) AS push_is_weekend"]
    out += ["CAST(notes_len_chars AS BIGINT) AS notes_len_chars", "CAST(notes_len_words AS BIGINT) AS notes_len_words"]
    return ", ".join(out)


@query("alert_summary", f"SELECT {_summary_outputs()} FROM ({alert_summary_sql()})")
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(summary.aggregate_alerts(P.alerts(spark, sf_dir)))
