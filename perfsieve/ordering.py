"""Order-dependent results without moving a whole table, or a whole group, into one task.

Running totals and neighbours: learn cut values with a mergeable sketch, turn them into bucket numbers,
do the ordered work inside buckets and carry totals across buckets through a table with one row per
bucket. Quantiles and ranks: radix selection, histograms of 16 bits of an order-preserving key at a time.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfsieve.session import materialize, setting

MAX_BUCKETS = 1024
ROWS_PER_BUCKET = 250_000
SMALL_GROUP = 100_000
# Rows of two numbers that one top-k may order.
SMALL_TABLE = 400_000


def cut_values(df: DataFrame, col: str) -> list[float]:
    """Ascending cut values that divide ``df`` evenly by ``col``; more rows give more cuts."""
    shares = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
    row = df.agg(
        F.count(col).alias("n"),
        F.percentile_approx(F.col(col).cast("double"), shares, 10 * MAX_BUCKETS).alias("cuts"),
    ).first()
    if not row["n"]:
        return []
    per_bucket = setting(df.sparkSession, "rowsPerBucket", ROWS_PER_BUCKET)
    wanted = max(8, min(MAX_BUCKETS, row["n"] // per_bucket))
    step = MAX_BUCKETS / wanted
    return [row["cuts"][int(round(i * step)) - 1] for i in range(1, wanted)]


def with_bucket(df: DataFrame, col: str, cuts: list[float], out: str = "_bucket") -> DataFrame:
    """Add the bucket number of ``col``: non-decreasing in ``col``, null for null."""
    edges = sorted(set(cuts))
    if not edges:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0.0)))
    raw = "_bucket_input"
    bucketizer = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol=raw, outputCol=out, handleInvalid="keep"
    )
    tagged = bucketizer.transform(df.withColumn(raw, F.col(col).cast("double")))
    return tagged.withColumn(out, F.when(F.col(raw).isNotNull(), F.col(out))).drop(raw)


def running_totals(df: DataFrame, key: str, values: list[str], prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``values`` in ascending order of ``key``, which must be distinct."""
    rows = with_bucket(df, key, cut_values(df, key))
    sums = rows.groupBy("_bucket").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    # One row per bucket (at most MAX_BUCKETS), so this window is small at any scale.
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket", *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in values]
    )
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(offsets), "_bucket").select(
        *df.columns, *[(F.col(f"_off_{v}") + F.sum(v).over(inside)).alias(f"{prefix}{v}") for v in values]
    )


def previous_value(df: DataFrame, key: str, out: str) -> DataFrame:
    """The next smaller value of the distinct column ``key``; null for the smallest."""
    rows = with_bucket(df, key, cut_values(df, key))
    tops = rows.groupBy("_bucket").agg(F.max(key).alias("_top"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_bucket", F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy(key)
    return rows.join(F.broadcast(carried), "_bucket").select(
        *df.columns, F.coalesce(F.lag(key).over(inside), F.col("_carried")).alias(out)
    )


# --- radix selection -------------------------------------------------------------------------
# Keys have 64 bits, whose order is that of the values; a pass settles 16 of them.
DIGIT_BITS = 16
_DIGIT = (1 << DIGIT_BITS) - 1
_SIGN = -(1 << 63)


def double_bits(value: Column) -> Column:
    """The bits of a double as a long; -0 counts as 0."""
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")


def key_of_bits(bits: Column) -> Column:
    """A long whose unsigned order is that of the doubles; NaN comes last."""
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))


def double_of_key(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_SIGN))).otherwise(F.bitwise_not(key))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def long_key(value: Column) -> Column:
    """A long whose unsigned order is the signed order of ``value``; it is its own inverse."""
    return value.bitwiseXOR(F.lit(_SIGN))


def select_ranks(rows: DataFrame, groups: list[str], targets: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The keys at 0-based ranks within groups, exact for groups of any size.

    ``rows`` holds ``groups`` (non-null, few) and ``_key``, ``targets`` holds groups, ``_i`` and ``_rank``,
    at most one row per (group, _i), every rank below its group's size. Bits that a group's keys share are
    left out first. Each pass, four at most, counts the next 16 bits of the keys that share a target's
    bits so far, map-side first: 2^16 counters for a target are all that meets in a task, whatever the
    values. Once few rows are left, they are written, or, below ``smallGroup``, ranked as they are.
    ``ends`` may give each group's _low and _high (its extreme keys, by unsigned order) and _n (its rows).
    Result: groups, _i, _key, _below (rows with smaller keys), _equal.
    """
    small = setting(rows.sparkSession, "smallGroup", SMALL_GROUP)
    if ends is None:
        low, high = (long_key(extreme(long_key(F.col("_key")))) for extreme in (F.min, F.max))
        ends = rows.groupBy(*groups).agg(low.alias("_low"), high.alias("_high"), F.count(F.lit(1)).alias("_n"))
    # The bits above the first difference are the same in all keys of the group.
    same = F.least(F.lit(63), 64 - F.length(F.bin(F.col("_low").bitwiseXOR(F.col("_high")))))
    first = F.when(same > 0, F.call_function("shiftrightunsigned", F.col("_low"), (64 - same).cast("int"))).otherwise(F.lit(0))
    ends = materialize(ends.select(*groups, "_n", same.cast("int").alias("_same"), first.cast("bigint").alias("_first")), "rank-ends")
    facts = ends.agg(F.sum("_n"), F.min("_same")).first()
    total, bits = facts[0] or 0, 64 - (facts[1] or 0)
    joined = rows.join(F.broadcast(ends.select(*groups, "_same")), groups)
    rows = joined.select(*groups, F.call_function("shiftleft", F.col("_key"), F.col("_same")).alias("_bits"))
    state = targets.select(*groups, "_i", F.lit(0).cast("bigint").alias("_prefix"), F.col("_rank").alias("_left"), F.col("_rank"))
    done = 0

    def settle(state: DataFrame, counted: DataFrame) -> DataFrame:
        """``state`` with the digit that each target's rank falls on."""
        wanted = state.groupBy(*groups, "_prefix").agg(F.collect_list(F.struct("_i", "_left", "_rank")).alias("_targets"))
        upto = Window.partitionBy(*groups, "_prefix").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        summed = counted.withColumn("_upto", F.sum("_n").over(upto)).join(F.broadcast(wanted), [*groups, "_prefix"])
        inside = F.filter("_targets", lambda t: (t["_left"] < F.col("_upto")) & (t["_left"] >= F.col("_upto") - F.col("_n")))
        left = F.col("_t._left") - F.col("_upto") + F.col("_n")
        hit = summed.withColumn("_t", F.explode(inside))
        return hit.select(*groups, "_t._i", "_t._rank", "_prefix", "_digit", left.alias("_left"), F.col("_n").alias("_equal"))

    while True:
        shift = 64 - DIGIT_BITS * (done + 1)
        if total <= small or shift < 0:
            break
        above = F.shiftrightunsigned("_bits", shift + DIGIT_BITS) if done else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("_bits", shift).bitwiseAND(F.lit(_DIGIT))
        placed = rows.select(*groups, above.alias("_prefix"), digit.alias("_digit"))
        if done:
            placed = placed.join(F.broadcast(state.select(*groups, "_prefix").distinct()), [*groups, "_prefix"], "left_semi")
        counted = placed.groupBy(*groups, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        following = settle(state, counted.withColumn("_order", F.col("_digit")))
        deeper = F.shiftleft("_prefix", DIGIT_BITS).bitwiseOR(F.col("_digit"))
        state = materialize(following.select(*groups, "_i", deeper.alias("_prefix"), "_left", "_rank", "_equal"), "ranks")
        done += 1
        if done * DIGIT_BITS >= bits:
            break
        near = state.groupBy(*groups, "_prefix").agg(F.max("_equal").alias("_n"))
        left = near.agg(F.sum("_n")).first()[0] or 0
        if 2 * left <= total:
            kept = rows.withColumn("_prefix", F.shiftrightunsigned("_bits", shift))
            kept = kept.join(F.broadcast(near.drop("_n")), [*groups, "_prefix"], "left_semi")
            rows, total = materialize(kept.select(*groups, "_bits"), "near-ranks"), left
    shift = 64 - DIGIT_BITS * done
    if done and done * DIGIT_BITS >= bits:
        found = state.withColumn("_bits", F.shiftleft("_prefix", shift) if shift else F.col("_prefix"))
    else:  # few rows: whole keys in place of digits
        prefix = F.shiftrightunsigned("_bits", shift) if done else F.lit(0).cast("bigint")
        placed = rows.select(*groups, prefix.alias("_prefix"), F.col("_bits").alias("_digit"))
        if done:
            placed = placed.join(F.broadcast(state.select(*groups, "_prefix").distinct()), [*groups, "_prefix"], "left_semi")
        counted = placed.groupBy(*groups, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        ranked = settle(state, counted.withColumn("_order", F.col("_digit").bitwiseXOR(F.lit(_SIGN))))
        found = ranked.withColumnRenamed("_digit", "_bits")
    back = found.join(F.broadcast(ends.select(*groups, "_same", "_first")), groups)
    low = F.call_function("shiftrightunsigned", F.col("_bits"), F.col("_same"))
    high = F.when(F.col("_same") > 0, F.call_function("shiftleft", F.col("_first"), (64 - F.col("_same")).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return back.select(*groups, "_i", low.bitwiseOR(high).alias("_key"), (F.col("_rank") - F.col("_left")).alias("_below"), "_equal")


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """Linearly interpolated quantiles per group, exact for groups of any size.

    When every group is small one aggregate does it, else the rows at the two ranks around each share
    are selected by ``select_ranks``. Output: groups, n, quantiles (array). The number of groups must be
    small (columns, or heavy keys): their ranks are broadcast.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    small = setting(df.sparkSession, "smallGroup", SMALL_GROUP)
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    largest = sizes.agg(F.max("n")).first()[0]
    if (largest or 0) <= small:
        wanted = F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares]))
        return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), wanted.alias("quantiles"))
    sizes = materialize(sizes, "group-sizes")
    both = []
    for i, share in enumerate(shares):
        position = F.lit(float(share)) * (F.col("n") - 1)
        for n, rank in ((2 * i, F.floor(position)), (2 * i + 1, F.ceil(position))):
            both.append(F.struct(F.lit(n).alias("_i"), rank.alias("_rank")))
    targets = sizes.select(*groups, F.explode(F.array(*both)).alias("_t")).select(*groups, "_t._i", "_t._rank")
    # Two projections: the bits are taken once.
    keys = rows.select(*groups, double_bits(F.col("_v")).alias("_bits")).select(*groups, key_of_bits(F.col("_bits")).alias("_key"))
    low, high = (key_of_bits(double_bits(F.col(c))) for c in ("_least", "_most"))
    ends = sizes.select(*groups, low.alias("_low"), high.alias("_high"), F.col("n").alias("_n"))
    found = select_ranks(keys, groups, targets, ends)
    valued = found.select(*groups, "_i", double_of_key(F.col("_key")).alias("_v"))
    listed = valued.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_at"))
    quantiles = []
    for i, share in enumerate(shares):
        position = F.lit(float(share)) * (F.col("n") - 1)
        low, high = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        quantiles.append(F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position))))
    return listed.join(sizes, groups).select(*groups, "n", F.array(*quantiles).alias("quantiles"))


def merge_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables of different columns as one row."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def value_at_rank(df: DataFrame, col: str, rank: int) -> tuple[int, int, int]:
    """(value, rows below it, rows equal to it) at 0-based ``rank`` among non-null longs."""
    keys = df.select(F.lit(0).alias("_g"), long_key(F.col(col).cast("bigint")).alias("_key"))
    target = df.sparkSession.createDataFrame([(0, 0, rank)], "_g int, _i int, _rank bigint")
    row = select_ranks(keys, ["_g"], target).select(long_key(F.col("_key")).alias("v"), "_below", "_equal").first()
    return row["v"], row["_below"], row["_equal"]


def row_at_rank(df: DataFrame, major: str, minor: str, rank: int, n: int, n_major: int):
    """(major, minor) of the row at 0-based ``rank`` in order of major (nulls last), then minor.

    ``n`` is the row count and ``n_major`` the count of non-null majors. Both columns are longs.
    Small tables take one bounded top-k; larger ones select by radix.
    """
    small = setting(df.sparkSession, "smallGroup", SMALL_TABLE)
    keys = df.select(major, minor)
    if n <= small:
        order = [F.col(major).asc_nulls_last(), F.col(minor).asc_nulls_first()]
        row = keys.orderBy(*order).offset(rank).limit(1).first()
        return row[major], row[minor]
    if rank >= n_major:
        value, same, inner = None, keys.where(F.col(major).isNull()), rank - n_major
        count = n - n_major
    else:
        value, under, count = value_at_rank(keys.where(F.col(major).isNotNull()), major, rank)
        same, inner = keys.where(F.col(major) == F.lit(value)), rank - under
    if count <= small:
        return value, same.orderBy(F.col(minor).asc_nulls_first()).offset(inner).limit(1).first()[minor]
    no_minor = same.where(F.col(minor).isNull()).count()
    if inner < no_minor:
        return value, None
    return value, value_at_rank(same.where(F.col(minor).isNotNull()), minor, inner - no_minor)[0]


def at_or_after(major: str, minor: str, cut) -> Column:
    """True for rows at or after the ``cut`` row in (major nulls last, minor nulls first) order."""
    value, tie = cut
    later_tie = F.lit(True) if tie is None else F.coalesce(F.col(minor) >= F.lit(tie), F.lit(False))
    if value is None:
        return F.col(major).isNull() & later_tie
    after = F.col(major).isNull() | (F.col(major) > F.lit(value))
    return F.coalesce(after | ((F.col(major) == F.lit(value)) & later_tie), F.lit(False))
