"""One row per alert summary out of one row per alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.functions import arrays, numeric, text
from perfsieve.ordering import exact_quantiles
from perfsieve.skew import heavy_keys, split_heavy


def present(df: DataFrame, candidates: list[str]) -> list[str]:
    """The candidates that exist, in candidate order."""
    have = set(df.columns)
    return [c for c in candidates if c in have]


def first_non_null(column: str, order: str) -> Column:
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def clean_dirty_numbers(alerts: DataFrame) -> DataFrame:
    """Text like ``(1,`` in the two backfill totals becomes a number, 0 when unreadable."""
    cleaned = {c: numeric.clean_number(F.col(c)) for c in present(alerts, C.DIRTY_NUMBER_COLUMNS)}
    return alerts.withColumns(cleaned) if cleaned else alerts


def numeric_stats(columns: list[str]) -> list[Column]:
    out = []
    for c in columns:
        out += [
            F.avg(c).alias(f"{c}__mean"),
            F.max(c).alias(f"{c}__max"),
            F.min(c).alias(f"{c}__min"),
            F.stddev_samp(c).alias(f"{c}__std"),
        ]
    return out


def category_profile(
    df: DataFrame, keys: list[str], order: str, modes: list[str], counts: list[str]
) -> DataFrame:
    """Most frequent value (``__mode``) and distinct count (``__nunique``) of several columns per key.

    Values are counted per (key, column, value) first, so no task ever holds all values of a key.
    Equal counts are settled by the value seen first in row order.
    """
    columns = list(dict.fromkeys(modes + counts))
    types = dict(df.dtypes)
    # explode, unlike unpivot, keeps the partitioning of its input.
    cells = F.array(
        *[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    )
    values = df.select(*keys, order, F.explode(cells).alias("_c")).where(F.col("_c.v").isNotNull())
    counted = values.groupBy(*keys, F.col("_c.k").alias("_k"), F.col("_c.v").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    best = counted.groupBy(*keys, "_k").agg(
        F.min_by("_v", F.struct(-F.col("_n"), F.col("_first"))).alias("mode"), F.count(F.lit(1)).alias("nunique")
    )
    # One entry per column at most, turned back into columns.
    entries = F.collect_list(F.struct("_k", F.struct("mode", "nunique")))
    profiles = best.groupBy(*keys).agg(F.map_from_entries(entries).alias("_profiles"))
    wanted = []
    for i, c in enumerate(columns):
        profile = F.col("_profiles")[F.lit(i)]
        if c in modes:
            wanted.append(profile["mode"].cast(types[c]).alias(f"{c}__mode"))
        if c in counts:
            wanted.append(F.coalesce(profile["nunique"], F.lit(0)).alias(f"{c}__nunique"))
    return profiles.select(*keys, *wanted)


def grouped_p90(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Interpolated 90th percentile for ordinary keys: a key's values meet in one short list."""
    return df.groupBy(*keys).agg(*[_list_p90(c) for c in columns])


def _list_p90(c: str) -> Column:
    return arrays.quantile(F.sort_array(F.collect_list(F.col(c).cast("double"))), 0.9).alias(f"{c}__p90")


def heavy_p90(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The same for heavy keys (non-null columns), whose values must not meet in one task."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)])
    values = doubles.unpivot(keys, [str(i) for i in range(len(columns))], "_k", "_value")
    found = exact_quantiles(values, [*keys, "_k"], "_value", [0.9])
    per_key = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_k") == str(i), F.col("quantiles")[0])).alias(f"{c}__p90") for i, c in enumerate(columns)]
    )
    # Keys without a single value in any column still need their row.
    return df.select(*keys).distinct().join(per_key, keys, "left")


def percentile_90(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """90th percentile per non-null key, for keys of any size."""
    heavy = heavy_keys(df, [key])
    if heavy is None:
        return grouped_p90(df, [key], columns)
    hot, cold = split_heavy(df, [key], heavy)
    return grouped_p90(cold, [key], columns).unionByName(heavy_p90(hot, [key], columns))


def aggregate_alerts(
    alerts: DataFrame,
    summary_columns: list[str] | None = None,
    numeric_columns: list[str] | None = None,
    category_columns: list[str] | None = None,
    order: str = C.ROW_ORDER,
    key: str = C.SUMMARY_ID,
) -> DataFrame:
    """The summary table: first values, number statistics, category profiles and the label.

    Ordinary summaries take one shuffle on the summary id. Heavy summaries (the null id may hold a
    third of all alerts) go through aggregates whose state is bounded and which combine map-side.
    """
    if C.BUG_NUMBER not in alerts.columns:
        raise KeyError(f"{C.BUG_NUMBER} not found; the label cannot be built")
    alerts = clean_dirty_numbers(alerts)
    firsts = present(alerts, summary_columns or C.SUMMARY_COLUMNS)
    numbers = present(alerts, numeric_columns or C.NUMERIC_COLUMNS)
    categories = present(alerts, category_columns or C.CATEGORY_COLUMNS)
    counted = categories + present(alerts, [C.SIGNATURE_ID])
    alerts = alerts.withColumns({c: F.col(c).try_cast("double") for c in numbers}) if numbers else alerts

    # The null id is a summary of its own; two non-null columns let every step group and join on it.
    keys = ["_id", "_no_id"]

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_id": F.coalesce(F.col(key), F.lit(0)), "_no_id": F.col(key).isNull()})

    def basic(df: DataFrame, extra: list[Column]) -> DataFrame:
        return df.groupBy(*keys).agg(
            *[first_non_null(c, order).alias(c) for c in firsts],
            *numeric_stats(numbers),
            *extra,
            F.count(F.lit(1)).alias("n_single_alerts"),
            F.bool_or(F.col(C.BUG_NUMBER).isNotNull()).alias(C.LABEL),
            first_non_null(C.BUG_NUMBER, order).alias(C.BUG_ID),
        )

    def ordinary(df: DataFrame) -> DataFrame:
        placed = keyed(df).repartition(*keys)
        base = basic(placed, [_list_p90(c) for c in numbers])
        return base.join(category_profile(placed, keys, order, categories, counted), keys, "left") if counted else base

    def of_heavy(df: DataFrame) -> DataFrame:
        df = keyed(df)
        base = basic(df, [])
        base = base.join(heavy_p90(df, keys, numbers), keys, "left") if numbers else base
        return base.join(category_profile(df, keys, order, categories, counted), keys, "left") if counted else base

    heavy = heavy_keys(alerts, [key])
    if heavy is None:
        summary = ordinary(alerts)
    else:
        hot, cold = split_heavy(alerts, [key], heavy)
        summary = ordinary(cold).unionByName(of_heavy(hot))
    zero = {f"{c}__nunique": F.coalesce(F.col(f"{c}__nunique"), F.lit(0)) for c in counted}
    others = [c for c in summary.columns if c not in keys]
    summary = summary.select(F.when(~F.col("_no_id"), F.col("_id")).alias(key), *others)
    summary = summary.withColumns(zero) if zero else summary
    return add_note_lengths(add_calendar(summary))


def add_calendar(df: DataFrame, time: str = C.PUSH_TIME) -> DataFrame:
    if time not in df.columns:
        return df
    t = F.col(time).try_cast("timestamp")
    return df.withColumns(
        {
            "push_dow": numeric.day_of_week(t),
            "push_hour": F.hour(t),
            "push_is_weekend": numeric.is_weekend(t),
        }
    )


def add_note_lengths(df: DataFrame, notes: str = C.NOTES) -> DataFrame:
    if notes not in df.columns:
        return df
    return df.withColumns(
        {"notes_len_chars": text.length_chars(F.col(notes)), "notes_len_words": text.length_words(F.col(notes))}
    )


def signature_list(alerts: DataFrame, key: str = C.SUMMARY_ID) -> DataFrame:
    """Distinct (summary id, signature id) pairs with readable, non-null ids. Kept as rows, not lists."""
    pairs = alerts.select(key, F.col(C.SIGNATURE_ID).try_cast("bigint").alias(C.SIGNATURE_ID))
    return pairs.where(F.col(key).isNotNull() & F.col(C.SIGNATURE_ID).isNotNull()).distinct()
