"""Statistics of a metric series around the push an alert fired at.

Flow: (summary, signature) pairs find their series; each distinct (series, push) finds its position by
one ordered pass over points and anchors together; positions and points meet in short overlapping
blocks of a series, which hold the windows whole; the statistics are computed once per position and
joined back to the pairs.

Positions count from 1. A series larger than one task should hold is cut into cells along its order,
and counts are carried across cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.functions import arrays, numeric
from perfsieve.operators.summary import signature_list
from perfsieve.ordering import MAX_BUCKETS, cut_values, exact_quantiles, merge_rows, with_bucket
from perfsieve.session import materialize
from perfsieve.skew import heavy_keys, join_unique, split_heavy
from perfsieve.sources.series import SERIES_KEYS

BLOCK = 512
_BEFORE, _POINT, _AFTER = 0, 1, 2
_CELL_STRIDE = 2 * MAX_BUCKETS


# --- which series -------------------------------------------------------------------------
def resolve_series(pairs: DataFrame, files: DataFrame, android_rule: bool = False) -> DataFrame:
    """Add ``folder``: where the pair's signature has its series, null when nowhere.

    Folders named in the repository or framework text come first, then autoland folders for an
    autoland text, then (optional rule) android folders for an android text, then any other; within
    a class the alphabetically first wins.
    """
    # One row per signature, holding its few folders.
    known = files.groupBy(C.SIGNATURE_ID).agg(F.sort_array(F.collect_set("folder")).alias("_folders"))
    joined = join_unique(pairs, known, [C.SIGNATURE_ID])

    def shown(c: str) -> Column:
        return F.coalesce(F.lower(F.col(c)), F.lit("nan")) if c in pairs.columns else F.lit("")

    place = F.concat_ws(" ", shown(C.REPOSITORY), shown(C.FRAMEWORK))

    def ranked(f: Column) -> Column:
        rank = F.when(place.contains(F.lower(f)), 0).when(
            place.contains("autoland") & f.startswith("autoland"), 1
        )
        if android_rule:
            rank = rank.when(place.contains("android") & f.contains("android"), 2)
        return F.struct(rank.otherwise(3).alias("rank"), f.alias("folder"))

    best = F.array_min(F.transform("_folders", ranked))
    return joined.withColumn("folder", best["folder"]).drop("_folders")


# --- where in the series ------------------------------------------------------------------
def _running(rows: DataFrame, major: str, value: str, how: str, out: str) -> DataFrame:
    """Running sum or max of ``value`` per series in (major, kind, seq) order, balanced for any series."""
    combine = {"sum": F.sum, "max": F.max}[how]
    order = [major, "_kind", "seq"]
    heavy = heavy_keys(rows, SERIES_KEYS)
    if heavy is None:
        upto = Window.partitionBy(*SERIES_KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(out, combine(value).over(upto))
    hot, cold = split_heavy(rows, SERIES_KEYS, heavy)
    celled = _with_cells(hot, major).unionByName(cold.withColumn("_cell", F.lit(0).cast("bigint")))
    cells = [*SERIES_KEYS, "_cell"]
    upto = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = celled.groupBy(*cells).agg(combine(value).alias("_total"))
    earlier = Window.partitionBy(*SERIES_KEYS).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*cells, combine("_total").over(earlier).alias("_carried"))
    joined = celled.join(carried, cells)
    inside = combine(value).over(upto)
    if how == "sum":
        whole = F.coalesce(inside, F.lit(0)) + F.coalesce("_carried", F.lit(0))
    else:
        whole = F.greatest(inside, F.col("_carried"))
    return joined.withColumn(out, whole).drop("_cell", "_carried")


def _with_cells(hot: DataFrame, major: str) -> DataFrame:
    """Cell numbers that follow (major, kind, seq) order and hold few rows each.

    Cuts are taken over all heavy series together, so a cell holds at most a bucket's share of them.
    A value of ``major`` that spans several cuts gets a bucket of its own, divided again by seq.
    """
    cuts = cut_values(hot, major)
    repeated = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    edges = sorted(set(cuts) | {math.nextafter(v, math.inf) for v in repeated})
    placed = with_bucket(hot, major, edges)
    if not repeated:
        return placed.withColumn("_cell", F.col("_bucket").cast("bigint") * _CELL_STRIDE).drop("_bucket")
    alone = [float(edges.index(v) + 1) for v in repeated]
    tied = placed.where(F.col("_bucket").isin(alone) & (F.col("_kind") == _POINT))
    placed = with_bucket(placed, "seq", cut_values(tied, "seq"), "_sub")
    part = (
        F.when(F.col("_kind") == _BEFORE, 0)
        .when(F.col("_kind") == _POINT, F.col("_sub") + 1)
        .otherwise(_CELL_STRIDE - 1)
    )
    inner = F.when(F.col("_bucket").isin(alone), part).otherwise(0)
    cell = F.col("_bucket").cast("bigint") * _CELL_STRIDE + inner.cast("bigint")
    return placed.withColumn("_cell", cell).drop("_bucket", "_sub")


def _marks(anchors: DataFrame, kinds: list[int]) -> DataFrame:
    """Distinct (series, push) anchors as rows that sort just before or after their push's points."""
    distinct = anchors.select(*SERIES_KEYS, F.col("anchor").cast("double").alias("push_id"))
    distinct = distinct.where(F.col("push_id").isNotNull()).distinct()
    kinds_column = F.explode(F.array(*[F.lit(k) for k in kinds]))
    none = {"value": "double", "revision": "string", "seq": "bigint"}
    return distinct.select(
        *SERIES_KEYS, "push_id", kinds_column.alias("_kind"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]
    )


def _point_rows(points: DataFrame) -> DataFrame:
    revision = F.col("revision") if "revision" in points.columns else F.lit(None)
    return points.select(
        *SERIES_KEYS,
        F.col("push_id").cast("double").alias("push_id"),
        F.lit(_POINT).alias("_kind"),
        "value",
        revision.cast("string").alias("revision"),
        "seq",
    )


def positions(points: DataFrame, anchors: DataFrame, rule: str = "asof", file_order: bool = False) -> DataFrame:
    """Points and anchors of all series in one table: ``_kind``, ``rn`` for points, ``idx`` for anchors.

    ``idx`` is the position of the last point with push_id <= anchor, 0 when there is none. Rule
    ``exact`` prefers the first point with push_id = anchor. Positions follow (push_id, seq), or seq
    alone with ``file_order``, where points without a push_id keep their place but never match.
    """
    kinds = [_AFTER] if rule == "asof" else [_BEFORE, _AFTER]
    rows = _point_rows(points)
    if file_order:
        placed = _running(rows.withColumn("_one", F.lit(1)), "seq", "_one", "sum", "rn")
        marks = _marks(anchors, [_AFTER]).withColumns({"_one": F.lit(0), "rn": F.lit(None).cast("bigint")})
        matched = _running(placed.where(F.col("push_id").isNotNull()).unionByName(marks), "push_id", "rn", "max", "_upto")
        lost = placed.where(F.col("push_id").isNull()).withColumn("_upto", F.lit(None).cast("bigint"))
        both = matched.unionByName(lost)
        return both.withColumn("idx", F.when(F.col("_kind") == _AFTER, F.coalesce("_upto", F.lit(0)))).drop("_one", "_upto")
    rows = rows.where(F.col("push_id").isNotNull()).unionByName(_marks(anchors, kinds))
    rows = rows.withColumn("_one", (F.col("_kind") == _POINT).cast("int"))
    counted = _running(rows, "push_id", "_one", "sum", "_upto").drop("_one")
    counted = counted.withColumn("rn", F.when(F.col("_kind") == _POINT, F.col("_upto")))
    if rule == "asof":
        return counted.withColumn("idx", F.when(F.col("_kind") == _AFTER, F.col("_upto"))).drop("_upto")
    points_out = counted.where(F.col("_kind") == _POINT).withColumn("idx", F.lit(None).cast("bigint")).drop("_upto")
    by_anchor = counted.where(F.col("_kind") != _POINT).groupBy(*SERIES_KEYS, "push_id").agg(
        F.max(F.when(F.col("_kind") == _BEFORE, F.col("_upto"))).alias("_less"),
        F.max(F.when(F.col("_kind") == _AFTER, F.col("_upto"))).alias("_upto"),
    )
    exact = F.when(F.col("_upto") > F.col("_less"), F.col("_less") + 1).otherwise(F.col("_upto"))
    marks_out = by_anchor.select(
        *SERIES_KEYS,
        "push_id",
        F.lit(_AFTER).alias("_kind"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("revision"),
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(None).cast("bigint").alias("rn"),
        exact.alias("idx"),
    )
    return points_out.unionByName(marks_out)


def anchor_positions(placed: DataFrame) -> DataFrame:
    """(series, anchor, idx) of the anchors that found a point; one row per series and anchor."""
    found = placed.where((F.col("_kind") == _AFTER) & (F.col("idx") >= 1))
    return found.select(*SERIES_KEYS, F.col("push_id").alias("anchor"), "idx")


def placed_points(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("_kind") == _POINT).select(*SERIES_KEYS, "rn", "value", "revision")


def index_pairs(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Add ``idx`` to pairs carrying series keys and ``anchor``; null without a position."""
    keyed = pairs.withColumn("anchor", F.col("anchor").cast("double"))
    return join_unique(keyed, anchor_positions(placed), [*SERIES_KEYS, "anchor"])


def revision_fallback(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Where ``idx`` is null, the first position whose revision equals the pair's ``anchor_revision``."""
    firsts = (
        placed_points(placed)
        .where(F.col("revision").isNotNull())
        .groupBy(*SERIES_KEYS, F.col("revision").alias("anchor_revision"))
        .agg(F.min("rn").alias("_rev_idx"))
    )
    open_pairs = pairs.where(F.col("idx").isNull())
    joined = join_unique(open_pairs, firsts, [*SERIES_KEYS, "anchor_revision"])
    return pairs.where(F.col("idx").isNotNull()).unionByName(joined.withColumn("idx", F.col("_rev_idx")).drop("_rev_idx"))


# --- windows ------------------------------------------------------------------------------
def window_arrays(rows: DataFrame, n_pre: int, n_post: int) -> DataFrame:
    """(series, idx, pre, post) for every distinct position asked for; the position itself is in neither.

    Each block of positions gathers its own points and those up to a window's reach outside, at most
    BLOCK + n_pre + n_post of them.
    """
    is_point = F.col("_kind") == _POINT
    first = F.when(is_point, F.greatest(F.lit(0), F.floor((F.col("rn") - n_post - 1) / BLOCK))).otherwise(
        F.floor((F.col("idx") - 1) / BLOCK)
    )
    last = F.when(is_point, F.floor((F.col("rn") + n_pre - 1) / BLOCK)).otherwise(first)
    useful = rows.where(is_point | (F.col("idx") >= 1))
    spread = useful.select(*SERIES_KEYS, "_kind", "rn", "idx", "value", F.explode(F.sequence(first, last)).alias("_block"))
    blocks = spread.groupBy(*SERIES_KEYS, "_block").agg(
        F.sort_array(F.collect_list(F.when(is_point, F.struct("rn", "value")))).alias("_points"),
        F.collect_set(F.when(~is_point, F.col("idx"))).alias("_wanted"),
    )
    asked = blocks.where(F.size("_wanted") > 0).select(
        *SERIES_KEYS,
        F.get("_points", F.lit(0))["rn"].alias("_start"),
        F.transform("_points", lambda p: p["value"]).alias("_values"),
        F.explode("_wanted").alias("idx"),
    )
    before = F.col("idx") - F.col("_start")
    pre = F.slice("_values", F.greatest(F.lit(1), before - n_pre + 1).cast("int"), F.least(before, F.lit(n_pre)).cast("int"))
    post = F.slice("_values", (before + 2).cast("int"), n_post)
    return asked.select(*SERIES_KEYS, "idx", pre.alias("pre"), post.alias("post"))


def _side_stats(values: str, out: str, df: DataFrame) -> DataFrame:
    """Add ``<out>_mean/_std/_median/_p90/_slope`` of an array column."""
    df = df.withColumns({f"{out}_mean": arrays.mean(F.col(values)), f"{out}_sorted": F.sort_array(values)})
    return df.withColumns(
        {
            f"{out}_std": arrays.std_sample(F.col(values), F.col(f"{out}_mean")),
            f"{out}_median": arrays.quantile(F.col(f"{out}_sorted"), 0.5),
            f"{out}_p90": arrays.quantile(F.col(f"{out}_sorted"), 0.9),
            f"{out}_slope": arrays.slope(F.col(values)),
        }
    ).drop(f"{out}_sorted")


def multi_scale_features(windows: DataFrame, scales=None) -> DataFrame:
    """``ts_<metric>_<scale>`` from ``pre`` and ``post``; null unless both sides have two points."""
    out = [*SERIES_KEYS, "idx"]
    df = windows
    for n_pre, n_post, name in scales or C.WINDOW_SCALES:
        start = F.greatest(F.lit(1), F.size("pre") - n_pre + 1)
        df = df.withColumns({f"a_{name}": F.slice("pre", start, n_pre), f"b_{name}": F.slice("post", 1, n_post)})
        df = _side_stats(f"b_{name}", f"post_{name}", _side_stats(f"a_{name}", f"pre_{name}", df))

        def pre(stat: str) -> Column:
            return F.col(f"pre_{name}_{stat}")

        def post(stat: str) -> Column:
            return F.col(f"post_{name}_{stat}")

        enough = (F.size(f"a_{name}") >= 2) & (F.size(f"b_{name}") >= 2)
        moved = post("mean") - pre("mean")
        z = F.when(pre("std") > 0, F.try_divide(moved, pre("std"))).otherwise(
            F.when(F.abs(moved) > 1e-9, F.lit(100.0)).otherwise(F.lit(0.0))
        )
        metrics = {
            "delta": numeric.relative_change(pre("mean"), post("mean")),
            "z": z,
            "slope": post("slope") - pre("slope"),
            "std_ratio": post("std") / F.greatest(pre("std"), F.lit(1e-9)),
            "median_shift": numeric.relative_change(pre("median"), post("median")),
            "p90_delta": numeric.relative_change(pre("p90"), post("p90")),
        }
        df = df.withColumns({f"ts_{m}_{name}": F.when(enough, metrics[m]) for m in C.WINDOW_METRICS})
        out += [f"ts_{m}_{name}" for m in C.WINDOW_METRICS]
    return df.select(*out)


def single_scale_features(windows: DataFrame) -> DataFrame:
    """The older flow's statistics of one window size; counts always, the rest with a point per side."""
    df = _side_stats("post", "post", _side_stats("pre", "pre", windows))
    n_pre, n_post = F.size("pre"), F.size("post")
    both = (n_pre >= 1) & (n_post >= 1)
    moved = F.col("post_mean") - F.col("pre_mean")
    pairs = (n_pre >= 2) & (n_post >= 2)
    return df.select(
        *SERIES_KEYS,
        "idx",
        n_pre.alias("ts_n_pre"),
        n_post.alias("ts_n_post"),
        F.when(both, numeric.relative_change(F.col("pre_mean"), F.col("post_mean"))).alias("ts_delta_mean_rel"),
        F.when(both, moved).alias("ts_delta_mean"),
        F.when(both & (n_pre >= 2) & (F.col("pre_std") > 0), F.try_divide(moved, F.col("pre_std"))).alias("ts_z_pre_post"),
        F.when(pairs, F.col("post_std") - F.col("pre_std")).alias("ts_delta_std"),
        F.when(pairs, F.col("post_slope") - F.col("pre_slope")).alias("ts_slope_change"),
    )


# --- features per pair and per summary ------------------------------------------------------
def summary_pairs(alerts: DataFrame, summary: DataFrame) -> DataFrame:
    """(summary, signature) pairs with what resolution and anchoring need from the summary."""
    context = [c for c in [C.REPOSITORY, C.FRAMEWORK, C.ANCHOR_PUSH, C.ANCHOR_REVISION] if c in summary.columns]
    known = summary.select(C.SUMMARY_ID, *context).where(F.col(C.SUMMARY_ID).isNotNull())
    pairs = join_unique(signature_list(alerts), known, [C.SUMMARY_ID])
    renamed = {C.ANCHOR_PUSH: "anchor", C.ANCHOR_REVISION: "anchor_revision"}
    out = pairs.withColumnsRenamed({k: v for k, v in renamed.items() if k in context})
    # A push id of 0 means no push.
    if "anchor" in out.columns:
        return out.withColumn("anchor", F.when(F.col("anchor").try_cast("double") != 0, F.col("anchor").try_cast("double")))
    return out.withColumn("anchor", F.lit(None).cast("double"))


def anchor_features(points: DataFrame, anchors: DataFrame, file_order: bool = False) -> DataFrame:
    """(series, anchor, idx, multi-scale features) of every distinct anchor that found a point."""
    placed = materialize(positions(points, anchors, file_order=file_order), "positions")
    reach_pre, reach_post = max(s[0] for s in C.WINDOW_SCALES), max(s[1] for s in C.WINDOW_SCALES)
    features = multi_scale_features(window_arrays(placed, reach_pre, reach_post))
    return join_unique(anchor_positions(placed), features, [*SERIES_KEYS, "idx"])


def window_features(pairs: DataFrame, points: DataFrame, files: DataFrame, file_order: bool = False) -> DataFrame:
    """Multi-scale features of every (summary, signature) pair that has a series."""
    resolved = resolve_series(materialize(pairs, "pairs"), files).where(F.col("folder").isNotNull())
    resolved = materialize(resolved, "resolved-pairs")
    return join_unique(resolved, anchor_features(points, resolved, file_order), [*SERIES_KEYS, "anchor"])


def without_windows(resolved: DataFrame) -> DataFrame:
    """Pairs of which none has a push to look for."""
    names = [f"ts_{m}_{s}" for _, _, s in C.WINDOW_SCALES for m in C.WINDOW_METRICS]
    return resolved.withColumns({"idx": F.lit(None).cast("bigint"), **{c: F.lit(None).cast("double") for c in names}})


def window_features_single(pairs: DataFrame, points: DataFrame, files: DataFrame) -> DataFrame:
    """Single-scale features of every pair; ``ts_n_total`` is null where there is no usable series."""
    resolved = materialize(resolve_series(materialize(pairs, "pairs"), files, android_rule=True), "resolved-pairs")
    with_series = resolved.where(F.col("folder").isNotNull())
    placed = materialize(positions(points, with_series, rule="exact"), "positions")
    indexed = index_pairs(with_series, placed)
    if "anchor_revision" in indexed.columns:
        indexed = revision_fallback(materialize(indexed, "indexed-pairs"), placed)
    indexed = materialize(indexed, "indexed-pairs")
    targets = indexed.where(F.col("idx").isNotNull()).select(*SERIES_KEYS, "idx").distinct()
    rows = placed_points(placed).select(
        *SERIES_KEYS, F.lit(_POINT).alias("_kind"), "rn", F.lit(None).cast("bigint").alias("idx"), "value"
    )
    asked = targets.select(
        *SERIES_KEYS,
        F.lit(_AFTER).alias("_kind"),
        F.lit(None).cast("bigint").alias("rn"),
        "idx",
        F.lit(None).cast("double").alias("value"),
    )
    features = single_scale_features(window_arrays(rows.unionByName(asked), *C.SINGLE_SCALE))
    sizes = placed_points(placed).groupBy(*SERIES_KEYS).agg(F.count(F.lit(1)).alias("ts_n_total"))
    whole = materialize(join_unique(indexed, features, [*SERIES_KEYS, "idx"]), "window-features")
    whole = join_unique(whole, sizes, SERIES_KEYS)
    return whole.unionByName(resolved.where(F.col("folder").isNull()), allowMissingColumns=True)


def rollup(features: DataFrame, key: str = C.SUMMARY_ID) -> DataFrame:
    """Mean and max over a summary's series, also min for p90 changes; ``ts_sig_used`` counts series."""
    names = [f"ts_{m}_{s}" for _, _, s in C.WINDOW_SCALES for m in C.WINDOW_METRICS]
    aggregates = []
    for c in names:
        aggregates += [F.avg(c).alias(f"{c}__mean_over_sigs"), F.max(c).alias(f"{c}__max_over_sigs")]
        if "p90" in c:
            aggregates.append(F.min(c).alias(f"{c}__min_over_sigs"))
    return features.groupBy(key).agg(F.count(F.lit(1)).alias("ts_sig_used"), *aggregates)


def rollup_single(features: DataFrame, key: str = C.SUMMARY_ID) -> DataFrame:
    """The older flow's roll-up; ``ts_sig_missing`` counts signatures without a usable series."""
    usable = F.col("ts_n_total").isNotNull()
    aggregates = []
    for c in C.SINGLE_SCALE_ROLLUP:
        aggregates += [F.avg(c).alias(f"{c}__mean_over_sigs"), F.max(c).cast("double").alias(f"{c}__max_over_sigs")]
    return features.groupBy(key).agg(
        F.count(F.when(usable, F.lit(1))).alias("ts_sig_used"),
        F.count(F.when(~usable, F.lit(1))).alias("ts_sig_missing"),
        *aggregates,
    )


def join_features(summary: DataFrame, rolled: DataFrame, key: str = C.SUMMARY_ID) -> DataFrame:
    """Attach the roll-up to the summary table; a summary without any signature has used none."""
    counts = [c for c in ["ts_sig_used", "ts_sig_missing"] if c in rolled.columns]
    joined = summary.join(rolled, key, "left")  # one row per key on both sides
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def coverage(summary: DataFrame, column: str = "ts_sig_used") -> DataFrame:
    """count, mean, std, min, quartiles, max of a count column and the share of rows above zero."""
    rows = summary.select(F.lit(0).alias("_g"), F.coalesce(F.col(column), F.lit(0)).alias("v"))
    basic = rows.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").cast("double").alias("min"),
        F.max("v").cast("double").alias("max"),
        F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("share_above_zero"),
    )
    quartiles = exact_quantiles(rows, ["_g"], "v", [0.25, 0.5, 0.75])
    return merge_rows(basic, quartiles.select(*[F.col("quantiles")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])]))
