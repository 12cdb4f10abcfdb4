"""Stand-ins for the alert, bug, series and note tables, derived row by row from the given tables.

Each column is one SQL expression that Spark and DuckDB read alike, so that a query and its check
start from the same rows while their operators differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perfsieve.session import spread


def choose(index: str, values: list[str | None]) -> str:
    """CASE that picks one of the texts by a non-negative integer expression."""
    arms = []
    for i, v in enumerate(values):
        shown = "CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'"
        arms.append(f"WHEN ({index}) % {len(values)} = {i} THEN {shown}")
    return "CASE " + " ".join(arms) + " END"


PLATFORMS = [
    "linux1804-64-shippable-qr",
    "android-hw-a51-11-0-aarch64-shippable",
    "fenix-armv7",
    "windows10-32",
    "macosx1015-64",
    "osx-10-10",
    "Darwin-x86_64",
    "solaris-x86",
    "linux-armhf 64",
    "freebsd",
    None,
]
RELATED = ["|123|456|", "123", " |5| ", "||", "12|ab|7", "12| 13", "1||2", "", None, "123.0"]
OPTIONS = [
    "e10s,stylo",
    "taskcluster-projects/foo/bar,e10s",
    "Fission, WebRender",
    "",
    None,
    "stylo,taskcluster-projects/x",
    "cold,,live",
]
TAGS = ["Infra, Improvement", "infra", "a,,a", "", None, "regression-backedout,early-beta-or-earlier"]
FRAMEWORKS = ["talos", "browsertime", "awsy", "android-perf"]
REPOSITORIES = ["autoland", "central", "beta", "mobile-autoland", "mobile-android"]
# Folder of the series files, by event type.
FOLDERS = {
    "click": "autoland1",
    "view": "autoland2",
    "error": "central",
    "purchase": "mobile-android",
    "signup": "beta",
}
FOLDER = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in FOLDERS.items()) + " END"

CONTEXT = (
    "CASE WHEN l_suppkey % 9 = 7 THEN NULL WHEN l_suppkey % 9 = 8 THEN '[{\"value\": 1' ELSE "
    "'[{\"value\": ' || CAST(l_suppkey AS STRING) || ', \"push_timestamp\": \"2024-01-02\"}, "
    "{\"value\": ' || CAST(l_suppkey % 7 AS STRING) || ', \"push_timestamp\": \"2024-01-01\"}, "
    "{\"value\": ' || CAST(l_suppkey % 9 + 3 AS STRING) || ', \"push_timestamp\": \"2024-01-03\"}]' END"
)

ALERT_COLUMNS = {
    "alert_summary_id": "l_orderkey",
    "alert_summary_bug_number": "CASE WHEN l_returnflag = 'R' AND l_quantity >= 40 THEN l_orderkey END",
    "seq": "CAST(l_linenumber AS BIGINT) * 100000000000000000 + l_partkey * 1000000 + l_suppkey",
    "signature_id": "CASE WHEN l_linenumber = 7 THEN l_suppkey + 1000000 ELSE l_suppkey END",
    "push_timestamp": "o_orderdate",
    "alert_summary_creation_timestamp": "l_shipdate",
    "alert_summary_repository": choose("o_custkey", REPOSITORIES),
    "alert_summary_revision": "CAST(o_orderkey % 100 AS STRING)",
    "alert_summary_push_id": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey END",
    "alert_summary_prev_push_id": "o_orderkey - 1",
    "alert_summary_prev_push_revision": "CAST((o_orderkey - 1) % 100 AS STRING)",
    "alert_summary_framework": choose("o_custkey", FRAMEWORKS),
    "alert_summary_related_alerts": choose("o_custkey", RELATED),
    "alert_summary_triage_due_date": "CAST(o_orderkey % 28 + 1 AS STRING)",
    "alert_summary_notes": (
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '  ' "
        "ELSE 'Backout  of bug ' || CAST(o_custkey AS STRING) || ' see "
        "https://bugzilla.example.org/show_bug.cgi?id=' || CAST(o_orderkey AS STRING) || ' on ' || o_orderpriority END"
    ),
    "alert_summary_performance_tags": choose("o_custkey", TAGS),
    "single_alert_amount_abs": "l_extendedprice",
    "single_alert_amount_pct": "l_discount * 100",
    "single_alert_prev_value": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END",
    "single_alert_new_value": "l_tax",
    "single_alert_t_value": "l_quantity / 2",
    "single_alert_is_regression": "l_returnflag = 'R'",
    "single_alert_manually_created": "l_linestatus = 'F'",
    "single_alert_noise_profile": "l_returnflag",
    "single_alert_backfill_record_status": "CASE WHEN l_linestatus = 'O' THEN 'done' END",
    "single_alert_backfill_record_context": CONTEXT,
    "single_alert_backfill_record_total_backfills_failed": "'(' || CAST(l_linenumber AS STRING) || ',)'",
    "single_alert_backfill_record_total_backfills_successful": "CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE '1,00' || CAST(l_linenumber AS STRING) END",
    "single_alert_series_signature_suite": "'suite' || CAST(l_partkey % 7 AS STRING)",
    "single_alert_series_signature_test": "'test' || CAST(l_partkey % 41 AS STRING)",
    "single_alert_series_signature_machine_platform": choose("l_suppkey", PLATFORMS),
    "single_alert_series_signature_measurement_unit": choose("l_suppkey", ["ms", "bytes", "score"]),
    "single_alert_series_signature_lower_is_better": "l_suppkey % 3 = 0",
    "single_alert_series_signature_extra_options": choose("l_partkey", OPTIONS),
    "single_alert_classifier": choose("l_partkey", ["sheriff1", None, "sheriff2"]),
    "single_alert_series_signature_has_subtests": "l_partkey % 2 = 0",
}
BUG_COLUMNS = {
    "id": "o_orderkey",
    "priority": (
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'p1 ' WHEN o_orderpriority = '2-HIGH' THEN 'P2' "
        "WHEN o_orderpriority = '3-MEDIUM' THEN 'Critical' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'P3' END"
    ),
}
SERIES_COLUMNS = {
    "folder": FOLDER,
    "signature_id": "user_id",
    "push_id": "event_id",
    "seq": "event_id",
    "revision": "substr(props, 7, length(props) - 7)",
    "value": "value",
}
NOTE_COLUMNS = {
    "doc_id": "doc_id",
    "notes": (
        "CASE WHEN doc_id % 11 = 0 THEN text || ' Bug #' || CAST(doc_id + 100000 AS STRING) || ', build 20240101 ok 999' "
        "WHEN doc_id % 11 = 1 THEN 'See https://bugzilla.example.org/show_bug.cgi?id=' || CAST(doc_id AS STRING) || ' and ' || text "
        "WHEN doc_id % 11 = 2 THEN '  ' WHEN doc_id % 11 = 3 THEN NULL "
        "WHEN doc_id % 11 = 4 THEN 'bug' || CAST(doc_id AS STRING) || ' 1234 5678 x90123 ' || text ELSE text END"
    ),
}
# A score with ties for the labelled documents, and its 0/1 label.
SCORE_COLUMNS = {
    "doc_id": "l.doc_id",
    "label": "l.quality",
    "score": "CAST((d.n_chars * 7 + l.doc_id * 13) % 101 AS DOUBLE) / 100",
}


def listing(columns: dict[str, str], names: list[str] | None = None) -> str:
    return ", ".join(f"{columns[n]} AS {n}" for n in (names or columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    lines, orders = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.selectExpr(*[f"{ALERT_COLUMNS[n]} AS {n}" for n in (names or ALERT_COLUMNS)])


def alerts_sql(names: list[str] | None = None) -> str:
    return f"SELECT {listing(ALERT_COLUMNS, names)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in BUG_COLUMNS.items()])


def bugs_sql() -> str:
    return f"SELECT {listing(BUG_COLUMNS)} FROM orders"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in SERIES_COLUMNS.items()])


def series_sql() -> str:
    return f"SELECT {listing(SERIES_COLUMNS)} FROM events"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).selectExpr(*[f"{e} AS {n}" for n, e in NOTE_COLUMNS.items()])


def notes_sql() -> str:
    return f"SELECT {listing(NOTE_COLUMNS)} FROM documents"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = table(spark, sf_dir, "labels").alias("l"), table(spark, sf_dir, "documents").alias("d")
    joined = labels.join(documents.select("doc_id", "n_chars").alias("d"), "doc_id")
    return joined.selectExpr("doc_id", "quality AS label", SCORE_COLUMNS["score"].replace("l.", "").replace("d.", "") + " AS score")


def scores_sql() -> str:
    return f"SELECT {listing(SCORE_COLUMNS)} FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, for expensive row-wise work."""
    return spread(table(spark, sf_dir, "lineitem"))
