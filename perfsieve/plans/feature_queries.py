"""Queries on scalar features, column selection and joins to the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.functions import numeric
from perfsieve.operators import enrich, selection, serialize, summary
from perfsieve.plans import proxies as P
from perfsieve.plans.registry import comparable, query, sql_round
from perfsieve.plans.summary_queries import TRUTHS, alert_summary_sql, sql_plain
from perfsieve.session import materialize

ID = C.SUMMARY_ID
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = ", ".join("CAST(l_linenumber AS BIGINT) AS l_linenumber" if c == "l_linenumber" else c for c in LINE)

# --- scalar features -----------------------------------------------------------------------
DIRTY = C.DIRTY_NUMBER_COLUMNS


@query(
    "clean_numeric",
    f"SELECT {ID}, seq, "
    + ", ".join(
        f"{sql_round(f'''coalesce(TRY_CAST(regexp_replace({c}, '[(),]', '', 'g') AS DOUBLE), 0)''')} AS {c}" for c in DIRTY
    )
    + f" FROM ({P.alerts_sql([ID, 'seq', *DIRTY])})",
)
def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(summary.clean_dirty_numbers(P.alerts(spark, sf_dir, [ID, "seq", *DIRTY])))


@query(
    "calendar_features",
    """SELECT event_id, isodow(ts) - 1 AS push_dow, hour(ts) AS push_hour,
        CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS push_is_weekend FROM events""",
)
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events").select("event_id", "ts")
    return comparable(summary.add_calendar(events, "ts").drop("ts"))


@query(
    "cyclical_hour",
    f"""SELECT event_id, CAST(CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
        {sql_round('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {sql_round('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos
        FROM events""",
)
def cyclical_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events").select("event_id", "ts")
    return comparable(enrich.add_clock_features(events, "ts").drop("ts"))


SEVERITY = {**P.BUG_COLUMNS, "label": "CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END"}


@query(
    "severity_weight",
    f"""SELECT id, CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE
        CASE upper(trim(priority)) WHEN 'P1' THEN 10.0 WHEN 'P2' THEN 5.0 WHEN 'P3' THEN 2.0
        WHEN 'CRITICAL' THEN 10.0 WHEN 'MAJOR' THEN 5.0 ELSE 1.0 END::DOUBLE END AS sample_weight
        FROM (SELECT {P.listing(SEVERITY)} FROM orders)""",
)
def severity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = P.table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in SEVERITY.items()])
    weight = numeric.severity_weight(F.col("label"), F.col("priority"))
    return comparable(orders.select("id", weight.alias(C.WEIGHT)))


@query(
    "signed_log_z",
    f"""WITH g AS (SELECT user_id, event_type, max(value) AS v, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n
        FROM events GROUP BY ALL), z AS (SELECT *, (v - m) / (s + 1e-4) AS raw FROM g)
        SELECT user_id, event_type, {sql_round('CASE WHEN n < 2 THEN 0 ELSE sign(raw) * ln(1 + abs(raw)) END', 5)} AS z FROM z""",
)
def signed_log_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = P.table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    stats = groups.agg(
        F.max("value").alias("v"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n")
    )
    z = numeric.signed_log_z(F.col("v"), F.col("m"), F.col("s"), F.col("n"))
    return comparable(stats.select("user_id", "event_type", z.alias("z")), 5)


RELATED_SQL = P.choose("o_custkey", P.RELATED)


@query(
    "related_count",
    f"""SELECT o_orderkey, coalesce(len(list_filter(string_split(trim(trim(t), '|'), '|'),
        lambda p: regexp_matches(p, '^[0-9]+$'))), 0) AS n_related_alerts
        FROM (SELECT o_orderkey, {RELATED_SQL} AS t FROM orders)""",
)
def related_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = P.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{RELATED_SQL} AS t")
    return comparable(texts.select("o_orderkey", numeric.related_count(F.col("t")).alias("n_related_alerts")))


# Worked out by hand for the eleven platform texts.
PLATFORM_SQL = f"""
SELECT p_partkey, coalesce(os, 'unknown') AS platform_os, coalesce(arch, 'unknown') AS platform_arch
FROM (SELECT p_partkey, {P.choose('p_partkey', P.PLATFORMS)} AS t FROM part)
LEFT JOIN (VALUES
    ('linux1804-64-shippable-qr', 'linux', 'x64'),
    ('android-hw-a51-11-0-aarch64-shippable', 'android', 'aarch64'),
    ('fenix-armv7', 'android', 'arm'),
    ('windows10-32', 'windows', 'x86'),
    ('macosx1015-64', 'mac', 'x64'),
    ('osx-10-10', 'mac', 'unknown'),
    ('Darwin-x86_64', 'windows', 'x64'),
    ('solaris-x86', 'solaris', 'x86'),
    ('linux-armhf 64', 'linux', 'arm'),
    ('freebsd', 'freebsd', 'unknown')) known(name, os, arch) ON t = name
"""


@query("platform_parse", PLATFORM_SQL)
def platform_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = P.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{P.choose('p_partkey', P.PLATFORMS)} AS t")
    parsed = {"platform_os": numeric.platform_os(F.col("t")), "platform_arch": numeric.platform_arch(F.col("t"))}
    return comparable(texts.withColumns(parsed).drop("t"))


# The context text of a line holds, in time order, the values a, b, c below.
BACKFILL_SQL = f"""
WITH v AS (SELECT *, CAST(l_suppkey % 7 AS DOUBLE) AS a, CAST(l_suppkey AS DOUBLE) AS b,
        CAST(l_suppkey % 9 + 3 AS DOUBLE) AS c, l_suppkey % 9 < 7 AS ok FROM lineitem),
    m AS (SELECT *, (a + b + c) / 3 AS mean FROM v),
    s AS (SELECT *, sqrt(((a - mean) ** 2 + (b - mean) ** 2 + (c - mean) ** 2) / 3) AS std FROM m),
    r AS (SELECT *, (l_tax - mean) / (std + 1e-4) AS raw FROM s)
SELECT {LINE_SQL},
    CASE WHEN ok THEN {sql_round('mean')} ELSE -1 END AS rcd_ctxt_mean,
    CASE WHEN ok THEN {sql_round('std')} ELSE -1 END AS rcd_ctxt_std,
    CASE WHEN ok AND std >= 1e-9 THEN {sql_round('(c - a) / 2')} ELSE 0 END AS rcd_ctxt_slope,
    CAST(CASE WHEN ok THEN 3 ELSE 0 END AS BIGINT) AS rcd_ctxt_count,
    CASE WHEN ok THEN {sql_round('sign(raw) * ln(1 + abs(raw))', 5)} ELSE 0 END AS rcd_ctxt_zscore
FROM r
"""


@query("backfill_stats", BACKFILL_SQL)
def backfill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.lines(spark, sf_dir).selectExpr(*LINE, "l_tax", f"{P.CONTEXT} AS context")
    stats = enrich.add_backfill_features(lines, "context", "l_tax").drop("l_tax", "context")
    return comparable(stats.withColumn("rcd_ctxt_zscore", F.round("rcd_ctxt_zscore", 5)))


# --- bins ----------------------------------------------------------------------------------
BINNED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SHARES = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"


def _edges(c: str, table: str = "lineitem") -> str:
    return (
        f"(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {_SHARES}))) FROM {table})"
    )


@query(
    "quantile_edges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(i AS BIGINT) AS i, {sql_round('edges[i]')} AS edge "
        f"FROM (SELECT edges, unnest(range(1, len(edges) + 1)) AS i FROM (SELECT {_edges(c)} AS edges))"
        for c in BINNED
    ),
)
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = serialize.fit_bin_edges(P.lines(spark, sf_dir), BINNED)
    rows = [(c, i + 1, e) for c, found in edges.items() for i, e in enumerate(found)]
    return comparable(spark.createDataFrame(rows, "feature string, i bigint, edge double"))


def _bins_sql(render) -> str:
    edges = ", ".join(f"{_edges(c)} AS e_{c}" for c in BINNED)
    out = ", ".join(f"{render(c)} AS {c}_bin" for c in BINNED)
    return f"WITH edges AS (SELECT {edges}) SELECT {LINE_SQL}, {out} FROM lineitem CROSS JOIN edges"


def _left_bin(c: str) -> str:
    below = f"len(list_filter(e_{c}, lambda e: e < {c}))"
    return f"CAST(greatest(0, least(len(e_{c}) - 2, {below} - 1)) AS BIGINT)"


def _token(c: str) -> str:
    upto = f"len(list_filter(e_{c}, lambda e: e <= {c}))"
    b = f"greatest(0, least(len(e_{c}) - 2, {upto} - 1))"
    return f"'{c}=q' || CAST(CAST(round_even({b} * 9.0 / greatest(1, len(e_{c}) - 2), 0) AS BIGINT) AS STRING)"


@query("quantile_bin", _bins_sql(_left_bin))
def quantile_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.lines(spark, sf_dir)
    edges = serialize.fit_bin_edges(lines, BINNED)
    return comparable(lines.select(*LINE, *[serialize.bin_of(edges, c).alias(f"{c}_bin") for c in BINNED]))


@query("quantile_token", _bins_sql(_token))
def quantile_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.lines(spark, sf_dir)
    edges = serialize.fit_bin_edges(lines, BINNED)
    return comparable(lines.select(*LINE, *[serialize.scaled_bin_token(edges, c).alias(f"{c}_bin") for c in BINNED]))


# --- column selection ----------------------------------------------------------------------
WANTED = ["o_orderkey", "o_missing", "o_totalprice", "o_orderpriority", "o_also_missing"]


@query("tolerant_project", f"SELECT o_orderkey, {sql_round('o_totalprice')} AS o_totalprice, o_orderpriority FROM orders")
def tolerant_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(selection.tolerant_project(P.table(spark, sf_dir, "orders"), WANTED))


BLIND_FEATURES = """
alert_summary_repository alert_summary_framework alert_summary_related_alerts alert_summary_performance_tags
n_single_alerts push_dow push_hour push_is_weekend signature_id__nunique
single_alert_is_regression__mode single_alert_is_regression__nunique
single_alert_manually_created__mode single_alert_manually_created__nunique
single_alert_noise_profile__mode single_alert_noise_profile__nunique
single_alert_backfill_record_status__mode single_alert_backfill_record_status__nunique
single_alert_backfill_record_context__mode single_alert_backfill_record_context__nunique
single_alert_series_signature_suite__mode single_alert_series_signature_suite__nunique
single_alert_series_signature_test__mode single_alert_series_signature_test__nunique
single_alert_series_signature_machine_platform__mode single_alert_series_signature_machine_platform__nunique
single_alert_series_signature_measurement_unit__mode single_alert_series_signature_measurement_unit__nunique
single_alert_series_signature_lower_is_better__mode single_alert_series_signature_lower_is_better__nunique
single_alert_series_signature_extra_options__mode single_alert_series_signature_extra_options__nunique
single_alert_series_signature_has_subtests__mode single_alert_series_signature_has_subtests__nunique
""".split()
MAGNITUDE_FEATURES = [
    f"single_alert_{n}__{s}"
    for n in ["amount_abs", "amount_pct", "prev_value", "new_value"]
    for s in ["mean", "max", "min", "std", "p90"]
]


def _feature_sql(names: list[str], fill: bool = False) -> str:
    def shown(c: str) -> str:
        base = c.removesuffix("__mode")
        if c.endswith("__mode") and base in TRUTHS:
            return sql_plain(base, c)
        if c in MAGNITUDE_FEATURES:
            return sql_round(c)
        if c in ("push_dow", "push_hour", "push_is_weekend"):
            return f"CAST({c} AS BIGINT)"
        if fill and (c.endswith("__mode") or c.startswith("alert_summary")):
            return f"coalesce({c}, 'MISSING')"
        return c

    return f"SELECT {ID}, {', '.join(f'{shown(c)} AS {c}' for c in names)} FROM ({alert_summary_sql()})"


@query("feature_select_static", _feature_sql(BLIND_FEATURES + MAGNITUDE_FEATURES))
def feature_select_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary.aggregate_alerts(P.alerts(spark, sf_dir))
    return comparable(table.select(ID, *selection.feature_names(table.columns)))


@query("feature_select_blind", _feature_sql(BLIND_FEATURES))
def feature_select_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary.aggregate_alerts(P.alerts(spark, sf_dir))
    return comparable(table.select(ID, *selection.feature_names(table.columns, blind=True)))


@query("categorical_fill", _feature_sql(BLIND_FEATURES, fill=True))
def categorical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary.aggregate_alerts(P.alerts(spark, sf_dir))
    names = selection.feature_names(table.columns, blind=True)
    return comparable(selection.fill_categories(table.select(ID, *names), names))


CARDINALITIES = {
    "few": "l_returnflag || l_linestatus",
    "below_limit": "CAST(l_partkey % 499 AS STRING)",
    "at_limit": "CAST(l_partkey % 500 AS STRING)",
    "above_limit": "CAST(l_partkey % 501 AS STRING)",
    "many": "CAST(l_orderkey AS STRING)",
}


@query(
    "cardinality_filter",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST(CASE WHEN count(DISTINCT {e}) > 500 THEN 0 ELSE 1 END AS BIGINT) AS kept FROM lineitem"
        for n, e in CARDINALITIES.items()
    ),
)
def cardinality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = P.lines(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in CARDINALITIES.items()])
    kept = selection.without_high_cardinality(columns, columns.columns)
    rows = [(c, int(c in kept)) for c in columns.columns]
    return spark.createDataFrame(rows, "feature string, kept bigint")


# --- joins ---------------------------------------------------------------------------------
BUG_SUMMARY = [ID, "seq", C.BUG_NUMBER]


def _label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = P.alerts(spark, sf_dir, BUG_SUMMARY).groupBy(ID).agg(
        F.bool_or(F.col(C.BUG_NUMBER).isNotNull()).alias(C.LABEL),
        summary.first_non_null(C.BUG_NUMBER, "seq").alias(C.BUG_ID),
    )
    return materialize(labels, "labels")


@query(
    "join_bug_priority",
    f"""WITH s AS (SELECT {ID}, bool_or({C.BUG_NUMBER} IS NOT NULL) AS bug_created, max({C.BUG_NUMBER}) AS bug_id
            FROM ({P.alerts_sql(BUG_SUMMARY)}) GROUP BY {ID}), b AS ({P.bugs_sql()})
        SELECT {ID}, CAST(CAST(bug_created AS INTEGER) AS BIGINT) AS bug_created, bug_id,
            coalesce(priority, '--') AS priority FROM s LEFT JOIN b ON s.bug_id = b.id""",
)
def join_bug_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(enrich.join_priority(_label_table(spark, sf_dir), P.bugs(spark, sf_dir)))


@query(
    "value_counts",
    f"""WITH s AS (SELECT {ID}, bool_or({C.BUG_NUMBER} IS NOT NULL) AS bug_created, max({C.BUG_NUMBER}) AS bug_id
            FROM ({P.alerts_sql(BUG_SUMMARY)}) GROUP BY {ID}), b AS ({P.bugs_sql()})
        SELECT sample_weight, count(*) AS n FROM (SELECT CASE WHEN NOT bug_created THEN 1.0::DOUBLE ELSE
            CASE upper(trim(priority)) WHEN 'P1' THEN 10.0 WHEN 'P2' THEN 5.0 WHEN 'P3' THEN 2.0 WHEN 'CRITICAL' THEN 10.0
            ELSE 1.0 END::DOUBLE END AS sample_weight FROM s LEFT JOIN b ON s.bug_id = b.id) GROUP BY sample_weight""",
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = enrich.add_sample_weight(_label_table(spark, sf_dir), P.bugs(spark, sf_dir))
    counts = weighted.groupBy(C.WEIGHT).agg(F.count(F.lit(1)).alias("n"))
    return comparable(counts.orderBy(F.desc("n"), C.WEIGHT))


# --- label lists ---------------------------------------------------------------------------
NAME_WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()


@query(
    "onehot_tags",
    "SELECT p_partkey, "
    + ", ".join(
        f"CAST(CAST(list_contains(string_split(p_name, ' '), '{w}') AS INTEGER) AS BIGINT) AS tag_{w}" for w in NAME_WORDS
    )
    + " FROM part",
)
def onehot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = P.table(spark, sf_dir, "part").selectExpr("p_partkey", "initcap(replace(p_name, ' ', ', ')) AS tags")
    return comparable(enrich.add_label_columns(named, "tags", "tag_"))


OPTION_SQL = P.choose("p_partkey", P.OPTIONS)
_OPTION_FLAGS = {"cold": [6], "e10s": [0, 1], "fission": [2], "live": [6], "stylo": [0, 5], "taskcluster": [1, 5], "webrender": [2]}


@query(
    "onehot_options",
    "SELECT p_partkey, "
    + ", ".join(
        f"CAST(CASE WHEN p_partkey % 7 IN ({', '.join(map(str, at))}) THEN 1 ELSE 0 END AS BIGINT) AS opt_{o}"
        for o, at in _OPTION_FLAGS.items()
    )
    + " FROM part",
)
def onehot_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = P.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{OPTION_SQL} AS options")
    return comparable(enrich.add_label_columns(texts, "options", "opt_", options=True))
