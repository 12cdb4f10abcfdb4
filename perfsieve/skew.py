"""Keys that hold too many rows for one task, and joins that stay balanced despite them.

A key is heavy when it holds at least ``perfsieve.heavyRows`` rows. The number of heavy keys is
counted before any of them is broadcast: the row limit is raised in powers of two until at most
``perfsieve.maxHeavyKeys`` keys remain above it, so a broadcast never holds more keys than that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsieve.session import setting

HEAVY_ROWS = 200_000
MAX_HEAVY_KEYS = 100_000


def heavy_keys(
    df: DataFrame, keys: list[str], heavy_rows: int | None = None, max_keys: int | None = None
) -> DataFrame | None:
    """The heavy values of ``keys``, or None when there are none (the usual case)."""
    spark = df.sparkSession
    limit = heavy_rows or setting(spark, "heavyRows", HEAVY_ROWS)
    max_keys = min(max_keys or MAX_HEAVY_KEYS, setting(spark, "maxHeavyKeys", MAX_HEAVY_KEYS))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # At most 63 size classes come back to the driver, whatever the number of keys.
    classes = (
        counts.where(F.col("_rows") >= limit)
        .groupBy(F.floor(F.log2(F.col("_rows") / limit)).cast("int").alias("size_class"))
        .agg(F.count(F.lit(1)).alias("n_keys"))
        .collect()
    )
    if not classes:
        return None
    by_class = {r["size_class"]: r["n_keys"] for r in classes}
    lowest, total = max(by_class) + 1, 0
    for size_class in sorted(by_class, reverse=True):
        if total + by_class[size_class] > max_keys:
            break
        total += by_class[size_class]
        lowest = size_class
    if total == 0:
        return None
    return counts.where(F.col("_rows") >= F.lit(float(limit) * 2.0**lowest)).select(*keys)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_heavy(df: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, all other rows); null keys compare equal. No shuffle."""
    listed = F.broadcast(heavy)
    condition = _same(df, listed, keys)
    return df.join(listed, condition, "left_semi"), df.join(listed, condition, "left_anti")


def join_unique(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    max_keys: int | None = None,
) -> DataFrame:
    """Equi-join against a side with at most one row per key, balanced for heavy left keys.

    Rows of heavy keys meet a broadcast of just those keys' right rows (one per key, so bounded by
    the number of heavy keys) and are never shuffled; all other rows take the ordinary join. Give a
    smaller ``max_keys`` when right rows are wide.
    """
    heavy = heavy_keys(left, on, max_keys=max_keys)
    if heavy is None:
        return left.join(right, on, how)
    hot, cold = split_heavy(left, on, heavy)
    few = right.join(F.broadcast(heavy), on, "left_semi")
    return hot.join(F.broadcast(few), on, how).unionByName(cold.join(right, on, how))
