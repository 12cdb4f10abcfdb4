"""Queries on metric series around an alert's push."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.operators import series as S
from perfsieve.plans import proxies as P
from perfsieve.plans.registry import comparable, query, sql_round
from perfsieve.plans.summary_queries import DIRTY_SERIES, DIRTY_SERIES_SQL, dirty_series
from perfsieve.session import materialize
from perfsieve.sources import series as source

ID, SIG = C.SUMMARY_ID, C.SIGNATURE_ID
KEYS = source.SERIES_KEYS
CONTEXT = [ID, "seq", SIG, C.REPOSITORY, C.FRAMEWORK, C.ANCHOR_PUSH, C.ANCHOR_REVISION]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(summary, signature) pairs with the summary's place and push."""
    alerts = P.alerts(spark, sf_dir, CONTEXT)
    context = [C.REPOSITORY, C.FRAMEWORK, C.ANCHOR_PUSH, C.ANCHOR_REVISION]
    summary = alerts.groupBy(ID).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in context])
    return S.summary_pairs(alerts, summary)


def files(points: DataFrame) -> DataFrame:
    return points.select(*KEYS).distinct()


def resolved_sql(series_sql: str, android: bool) -> str:
    """``resolved``: pairs with anchor, revision and the folder of their series."""
    android_rule = "WHEN contains(place, 'android') AND contains(folder, 'android') THEN 2" if android else ""
    return f"""
    a AS ({P.alerts_sql(CONTEXT)}),
    pairs AS (SELECT DISTINCT {ID}, {SIG}, lower({C.REPOSITORY}) || ' ' || lower({C.FRAMEWORK}) AS place,
        CASE WHEN {C.ANCHOR_PUSH} <> 0 THEN {C.ANCHOR_PUSH} END AS anchor, {C.ANCHOR_REVISION} AS anchor_revision FROM a),
    files AS (SELECT DISTINCT folder, {SIG} FROM ({series_sql})),
    resolved AS (SELECT {ID}, {SIG}, anchor, anchor_revision, arg_min(folder, CAST(rank AS STRING) || folder) AS folder FROM (
        SELECT pairs.*, folder, CASE WHEN contains(place, lower(folder)) THEN 0
            WHEN contains(place, 'autoland') AND starts_with(folder, 'autoland') THEN 1 {android_rule} ELSE 3 END AS rank
        FROM pairs LEFT JOIN files USING ({SIG})) GROUP BY ALL)
    """


@query(
    "resolve_series",
    f"WITH {resolved_sql(P.series_sql(), True)} SELECT {ID}, {SIG}, folder FROM resolved",
)
def resolve_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = S.resolve_series(pairs(spark, sf_dir), files(P.series(spark, sf_dir)), android_rule=True)
    return comparable(resolved.select(ID, SIG, "folder"))


# Points without a usable push or value are dropped before positions are counted.
POINTS_SQL = f"""
    points AS (SELECT *, row_number() OVER (PARTITION BY folder, {SIG} ORDER BY push_id, seq) AS rn FROM (
        SELECT folder, {SIG}, seq, revision, TRY_CAST(push_id AS DOUBLE) AS push_id, TRY_CAST(value AS DOUBLE) AS value
        FROM ({DIRTY_SERIES_SQL})) WHERE value IS NOT NULL AND push_id IS NOT NULL)
"""
ANCHORS_SQL = f"anchors AS (SELECT DISTINCT folder, {SIG}, CAST(anchor AS DOUBLE) AS anchor FROM resolved WHERE folder IS NOT NULL AND anchor IS NOT NULL)"
ASOF_SQL = f"""
    latest AS (SELECT x.folder, x.{SIG}, x.anchor, p.rn AS idx FROM anchors x
        ASOF JOIN (SELECT folder, {SIG}, push_id, max(rn) AS rn FROM points GROUP BY ALL) p
        ON x.folder = p.folder AND x.{SIG} = p.{SIG} AND x.anchor >= p.push_id)
"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.clean_points(dirty_series(spark, sf_dir), need_push=True)


def _with_series(spark: SparkSession, sf_dir: str, android: bool) -> tuple[DataFrame, DataFrame]:
    listed = files(P.series(spark, sf_dir))
    resolved = S.resolve_series(pairs(spark, sf_dir), listed, android_rule=android)
    return clean(spark, sf_dir), materialize(resolved.where(F.col("folder").isNotNull()), "resolved-pairs")


@query(
    "series_clean_sorted",
    f"WITH {POINTS_SQL} SELECT folder, {SIG}, rn, push_id, revision, {sql_round('value')} AS value FROM points",
)
def series_clean_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = clean(spark, sf_dir)
    placed = S.positions(points, points.select(*KEYS, F.lit(None).cast("double").alias("anchor")))
    kept = placed.where(F.col("rn").isNotNull())
    return comparable(kept.select(*KEYS, "rn", "push_id", "revision", "value"))


@query("asof_anchor", f"WITH {resolved_sql(P.series_sql(), False)}, {POINTS_SQL}, {ANCHORS_SQL}, {ASOF_SQL} SELECT * FROM latest")
def asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, resolved = _with_series(spark, sf_dir, False)
    return comparable(S.anchor_positions(S.positions(points, resolved)))


SHUFFLED = {**P.SERIES_COLUMNS, "seq": "event_id + CASE WHEN event_id % 4 < 2 THEN 6 ELSE -6 END"}


@query(
    "asof_anchor_file_order",
    f"""WITH {resolved_sql(P.series_sql(), False)}, {ANCHORS_SQL},
        f AS (SELECT *, row_number() OVER (PARTITION BY folder, {SIG} ORDER BY seq) AS rn FROM (SELECT {P.listing(SHUFFLED)} FROM events))
        SELECT x.folder, x.{SIG}, x.anchor, max(f.rn) AS idx FROM anchors x JOIN f
        ON x.folder = f.folder AND x.{SIG} = f.{SIG} AND f.push_id <= x.anchor GROUP BY ALL""",
)
def asof_anchor_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, resolved = _with_series(spark, sf_dir, False)
    points = P.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in SHUFFLED.items()])
    return comparable(S.anchor_positions(S.positions(source.clean_points(points), resolved, file_order=True)))


EXACT_SQL = f"""
    exact_or_asof AS (SELECT a.folder, a.{SIG}, a.anchor, coalesce(e.idx, a.idx) AS idx FROM latest a LEFT JOIN (
        SELECT folder, {SIG}, push_id, min(rn) AS idx FROM points GROUP BY ALL) e
        ON a.folder = e.folder AND a.{SIG} = e.{SIG} AND a.anchor = e.push_id)
"""


@query(
    "exact_or_asof_anchor",
    f"WITH {resolved_sql(P.series_sql(), True)}, {POINTS_SQL}, {ANCHORS_SQL}, {ASOF_SQL}, {EXACT_SQL} SELECT * FROM exact_or_asof",
)
def exact_or_asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, resolved = _with_series(spark, sf_dir, True)
    return comparable(S.anchor_positions(S.positions(points, resolved, rule="exact")))


INDEXED_SQL = f"""
    indexed AS (SELECT r.{ID}, r.{SIG}, r.folder, r.anchor, r.anchor_revision, coalesce(x.idx, v.idx) AS idx FROM resolved r
        LEFT JOIN exact_or_asof x ON r.folder = x.folder AND r.{SIG} = x.{SIG} AND r.anchor = x.anchor
        LEFT JOIN (SELECT folder, {SIG}, revision, min(rn) AS idx FROM points GROUP BY ALL) v
        ON r.folder = v.folder AND r.{SIG} = v.{SIG} AND r.anchor_revision = v.revision)
"""


@query(
    "revision_fallback_anchor",
    f"""WITH {resolved_sql(P.series_sql(), True)}, {POINTS_SQL}, {ANCHORS_SQL}, {ASOF_SQL}, {EXACT_SQL}, {INDEXED_SQL}
        SELECT {ID}, {SIG}, folder, idx FROM indexed WHERE folder IS NOT NULL""",
)
def revision_fallback_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, resolved = _with_series(spark, sf_dir, True)
    placed = materialize(S.positions(points, resolved, rule="exact"), "positions")
    indexed = S.revision_fallback(S.index_pairs(resolved, placed), placed)
    return comparable(indexed.select(ID, SIG, "folder", "idx"))


def _sides(scale: str, n_pre: int, n_post: int) -> str:
    pre = f"FILTER (p.rn BETWEEN x.idx - {n_pre} AND x.idx - 1)"
    post = f"FILTER (p.rn BETWEEN x.idx + 1 AND x.idx + {n_post})"
    out = []
    for side, f in [("a", pre), ("b", post)]:
        out += [
            f"count(p.value) {f} AS n_{side}_{scale}",
            f"avg(p.value) {f} AS mean_{side}_{scale}",
            f"stddev_samp(p.value) {f} AS std_{side}_{scale}",
            f"quantile_cont(p.value, 0.5) {f} AS med_{side}_{scale}",
            f"quantile_cont(p.value, 0.9) {f} AS p90_{side}_{scale}",
            f"regr_slope(p.value, p.rn) {f} AS slope_{side}_{scale}",
        ]
    return ", ".join(out)


def _metrics(s: str, wrap) -> str:
    enough = f"n_a_{s} >= 2 AND n_b_{s} >= 2"
    moved = f"(mean_b_{s} - mean_a_{s})"
    exprs = {
        "delta": f"{moved} / greatest(abs(mean_a_{s}), 1e-9)",
        "z": f"CASE WHEN std_a_{s} > 0 THEN {moved} / std_a_{s} WHEN abs({moved}) > 1e-9 THEN 100 ELSE 0 END",
        "slope": f"slope_b_{s} - slope_a_{s}",
        "std_ratio": f"std_b_{s} / greatest(std_a_{s}, 1e-9)",
        "median_shift": f"(med_b_{s} - med_a_{s}) / greatest(abs(med_a_{s}), 1e-9)",
        "p90_delta": f"(p90_b_{s} - p90_a_{s}) / greatest(abs(p90_a_{s}), 1e-9)",
    }
    return ", ".join(f"{wrap(f'CASE WHEN {enough} THEN {e} END')} AS ts_{m}_{s}" for m, e in exprs.items())


def features_sql(wrap=lambda e: e, points: str = POINTS_SQL, latest: str = ASOF_SQL) -> str:
    """``feats``: multi-scale features of every resolved pair, from scratch over the points."""
    return f"""
    {resolved_sql(P.series_sql(), False)}, {points}, {ANCHORS_SQL}, {latest},
    stats AS (SELECT x.folder, x.{SIG}, x.anchor, x.idx, {', '.join(_sides(s, a, b) for a, b, s in C.WINDOW_SCALES)}
        FROM latest x JOIN points p ON x.folder = p.folder AND x.{SIG} = p.{SIG} AND p.rn BETWEEN x.idx - 50 AND x.idx + 20
        GROUP BY x.folder, x.{SIG}, x.anchor, x.idx),
    feats AS (SELECT r.{ID}, r.{SIG}, r.folder, idx, {', '.join(_metrics(s, wrap) for _, _, s in C.WINDOW_SCALES)}
        FROM resolved r LEFT JOIN stats s ON r.folder = s.folder AND r.{SIG} = s.{SIG} AND r.anchor = s.anchor
        WHERE r.folder IS NOT NULL)
    """


NAMES = [f"ts_{m}_{s}" for _, _, s in C.WINDOW_SCALES for m in C.WINDOW_METRICS]


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_features(pairs(spark, sf_dir), clean(spark, sf_dir), files(P.series(spark, sf_dir)))


@query("ts_window_features", f"WITH {features_sql(sql_round)} SELECT {ID}, {SIG}, folder, idx, {', '.join(NAMES)} FROM feats")
def ts_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(multi(spark, sf_dir).select(ID, SIG, "folder", "idx", *NAMES))


# Points without a push keep their place in the file; the last one with a push at or below the anchor counts.
DIRTY_SHUFFLED = {**DIRTY_SERIES, "seq": SHUFFLED["seq"]}
FILE_POINTS_SQL = f"""
    points AS (SELECT *, row_number() OVER (PARTITION BY folder, {SIG} ORDER BY seq) AS rn FROM (
        SELECT folder, {SIG}, seq, TRY_CAST(push_id AS DOUBLE) AS push_id, TRY_CAST(value AS DOUBLE) AS value
        FROM (SELECT {P.listing(DIRTY_SHUFFLED)} FROM events)) WHERE value IS NOT NULL)
"""
FILE_LATEST_SQL = f"""
    latest AS (SELECT x.folder, x.{SIG}, x.anchor, max(p.rn) AS idx FROM anchors x JOIN points p
        ON x.folder = p.folder AND x.{SIG} = p.{SIG} AND p.push_id <= x.anchor GROUP BY ALL)
"""


@query(
    "ts_window_features_file_order",
    f"WITH {features_sql(sql_round, FILE_POINTS_SQL, FILE_LATEST_SQL)} SELECT {ID}, {SIG}, folder, idx, {', '.join(NAMES)} FROM feats",
)
def ts_window_features_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = P.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in DIRTY_SHUFFLED.items()])
    points, listed = source.clean_points(raw), files(P.series(spark, sf_dir))
    found = S.window_features(pairs(spark, sf_dir), points, listed, file_order=True)
    return comparable(found.select(ID, SIG, "folder", "idx", *NAMES))


@query(
    "agg_slope",
    f"SELECT folder, {SIG}, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE {sql_round('regr_slope(value, rn)')} END AS slope "
    f"FROM (WITH {POINTS_SQL} SELECT * FROM points) GROUP BY folder, {SIG}",
)
def agg_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = clean(spark, sf_dir)
    placed = S.positions(points, points.select(*KEYS, F.lit(None).cast("double").alias("anchor")))
    slope = F.when(F.count("rn") < 2, F.lit(0.0)).otherwise(F.regr_slope("value", "rn"))
    groups = S.placed_points(placed).groupBy(*KEYS)
    return comparable(groups.agg(F.count("rn").alias("n"), slope.alias("slope")))


def rollup_sql(wrap) -> str:
    out = []
    for c in NAMES:
        out += [f"{wrap(f'avg({c})')} AS {c}__mean_over_sigs", f"{wrap(f'max({c})')} AS {c}__max_over_sigs"]
        if "p90" in c:
            out.append(f"{wrap(f'min({c})')} AS {c}__min_over_sigs")
    return f"SELECT {ID}, count(*) AS ts_sig_used, {', '.join(out)} FROM feats GROUP BY {ID}"


@query("ts_rollup", f"WITH {features_sql()} {rollup_sql(sql_round)}")
def ts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(S.rollup(multi(spark, sf_dir)))


@query(
    "join_ts_features",
    f"""WITH {features_sql()}, u AS ({rollup_sql(sql_round)}),
        ids AS (SELECT {ID}, count(*) AS n_single_alerts FROM ({P.alerts_sql([ID])}) GROUP BY {ID})
        SELECT ids.{ID}, n_single_alerts, coalesce(ts_sig_used, 0) AS ts_sig_used, ts_delta_long__mean_over_sigs, ts_p90_delta_short__min_over_sigs
        FROM ids LEFT JOIN u ON ids.{ID} = u.{ID}""",
)
def join_ts_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.alerts(spark, sf_dir, [ID]).groupBy(ID).agg(F.count(F.lit(1)).alias("n_single_alerts"))
    joined = S.join_features(counts, S.rollup(multi(spark, sf_dir)))
    wanted = ["n_single_alerts", "ts_sig_used", "ts_delta_long__mean_over_sigs", "ts_p90_delta_short__min_over_sigs"]
    return comparable(joined.select(ID, *wanted))


SINGLE_SQL = f"""
    {resolved_sql(P.series_sql(), True)}, {POINTS_SQL}, {ANCHORS_SQL}, {ASOF_SQL}, {EXACT_SQL}, {INDEXED_SQL},
    sizes AS (SELECT folder, {SIG}, count(*) AS ts_n_total FROM points GROUP BY ALL),
    stats AS (SELECT x.{ID}, x.{SIG}, {_sides('s', 20, 10)}
        FROM indexed x JOIN points p ON x.folder = p.folder AND x.{SIG} = p.{SIG} AND p.rn BETWEEN x.idx - 20 AND x.idx + 10
        GROUP BY x.{ID}, x.{SIG}),
    single AS (SELECT i.{ID}, i.{SIG}, i.folder, ts_n_total,
        CASE WHEN i.idx IS NOT NULL THEN n_a_s END AS ts_n_pre, CASE WHEN i.idx IS NOT NULL THEN n_b_s END AS ts_n_post,
        (mean_b_s - mean_a_s) / greatest(abs(mean_a_s), 1e-9) AS ts_delta_mean_rel,
        mean_b_s - mean_a_s AS ts_delta_mean,
        CASE WHEN std_a_s > 0 THEN (mean_b_s - mean_a_s) / std_a_s END AS ts_z_pre_post,
        std_b_s - std_a_s AS ts_delta_std,
        CASE WHEN n_a_s >= 2 AND n_b_s >= 2 THEN slope_b_s - slope_a_s END AS ts_slope_change
        FROM indexed i LEFT JOIN stats s ON i.{ID} = s.{ID} AND i.{SIG} = s.{SIG}
        LEFT JOIN sizes z ON i.folder = z.folder AND i.{SIG} = z.{SIG})
"""
SINGLE_NAMES = C.SINGLE_SCALE_ROLLUP


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_features_single(pairs(spark, sf_dir), clean(spark, sf_dir), files(P.series(spark, sf_dir)))


@query(
    "ts_window_features_single",
    f"""WITH {SINGLE_SQL} SELECT {ID}, {SIG}, folder, ts_n_total, ts_n_pre, ts_n_post,
        {', '.join(f'{sql_round(c)} AS {c}' for c in SINGLE_NAMES if not c.startswith('ts_n_'))} FROM single""",
)
def ts_window_features_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(single(spark, sf_dir).select(ID, SIG, "folder", "ts_n_total", *SINGLE_NAMES))


@query(
    "ts_rollup_single",
    f"""WITH {SINGLE_SQL} SELECT {ID}, count(ts_n_total) AS ts_sig_used, count(*) - count(ts_n_total) AS ts_sig_missing,
        {', '.join(f"{sql_round(f'avg({c})')} AS {c}__mean_over_sigs, {sql_round(f'max({c})')} AS {c}__max_over_sigs" for c in SINGLE_NAMES)}
        FROM single GROUP BY {ID}""",
)
def ts_rollup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(S.rollup_single(single(spark, sf_dir)))


@query(
    "ts_coverage",
    f"""WITH {resolved_sql(P.series_sql(), False)}, u AS (SELECT {ID}, count(folder) AS v FROM resolved GROUP BY {ID})
        SELECT count(*) AS count, {sql_round('avg(v)')} AS mean, {sql_round('stddev_samp(v)')} AS std, CAST(min(v) AS DOUBLE) AS min,
        CAST(max(v) AS DOUBLE) AS max, {sql_round('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)')} AS share_above_zero,
        {sql_round('quantile_cont(CAST(v AS DOUBLE), 0.25)')} AS q25, {sql_round('quantile_cont(CAST(v AS DOUBLE), 0.5)')} AS q50,
        {sql_round('quantile_cont(CAST(v AS DOUBLE), 0.75)')} AS q75 FROM u""",
)
def ts_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = S.resolve_series(pairs(spark, sf_dir), files(P.series(spark, sf_dir)))
    used = resolved.groupBy(ID).agg(F.count("folder").alias("ts_sig_used"))
    return comparable(S.coverage(materialize(used, "coverage")))
