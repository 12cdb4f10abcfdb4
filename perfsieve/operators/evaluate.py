"""Ranking metrics, importance tables and rates, from (id, label, score) tables.

Rows are first counted per distinct score, so ties of any size collapse map-side; running totals over
the distinct scores then give every threshold metric without sorting all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.ordering import running_totals
from perfsieve.session import materialize


def threshold_table(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score: positives, rows, and both totals over this and all higher scores."""
    counted = scores.groupBy((-F.col(score).cast("double")).alias("_neg")).agg(
        F.sum(F.col(label).cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("rows")
    )
    totals = running_totals(materialize(counted, "scores"), "_neg", ["positives", "rows"])
    return totals.withColumn("threshold", -F.col("_neg") + F.lit(0.0)).drop("_neg")


def average_precision(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Step-wise area under the precision-recall curve; 0 without positives."""
    steps = threshold_table(scores, label, score)
    gained = F.sum(F.col("positives") * F.col("cum_positives") / F.col("cum_rows"))
    return steps.agg(
        F.coalesce(F.try_divide(gained, F.sum("positives")), F.lit(0.0)).alias("average_precision"),
        F.sum("positives").alias("positives"),
        F.sum("rows").alias("rows"),
    )


def roc_auc(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs ranked rightly, ties half; null with one class only."""
    steps = threshold_table(scores, label, score)
    negatives = F.col("rows") - F.col("positives")
    cum_negatives = F.col("cum_rows") - F.col("cum_positives")
    # Negatives scored higher than a positive count against it, equal ones half.
    lost = F.sum(F.col("positives").cast("double") * (cum_negatives - negatives / F.lit(2.0)))
    pairs = F.sum("positives").cast("double") * F.sum(negatives)
    return steps.agg((1 - F.try_divide(lost, pairs)).alias("roc_auc"))


def pr_curve(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """precision, recall per distinct threshold, and the end point (1, 0)."""
    steps = threshold_table(scores, label, score)
    total = steps.agg(F.sum("positives")).first()[0] or 0  # one number
    points = steps.select(
        "threshold",
        (F.col("cum_positives") / F.col("cum_rows")).alias("precision"),
        F.coalesce(F.try_divide(F.col("cum_positives"), F.lit(total)), F.lit(1.0)).alias("recall"),
    )
    end = scores.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def precision_recall_at(
    scores: DataFrame, ks: list[int] | None = None, label: str = "label", score: str = "score", key: str = "id"
) -> DataFrame:
    """Precision and recall among the min(k, n) best rows; equal scores are settled by the key."""
    ks = ks or C.TOP_KS
    order = [F.desc(score), F.asc(key)]
    best = scores.select(label, score, key).orderBy(*order).limit(max(ks))
    # At most max(ks) rows: one small ordered window.
    ranked = best.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    among = [F.sum(F.when(F.col("_rank") <= k, F.col(label).cast("bigint"))).alias(f"hits_{k}") for k in ks]
    whole = scores.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives"))
    both = ranked.agg(*among).unionByName(whole, allowMissingColumns=True)
    one = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
    entries = [F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"hits_{k}").alias("hits")) for k in ks]
    rows = one.select("n", "positives", F.explode(F.array(*entries)).alias("e"))
    return rows.select(
        F.col("e.k").alias("k"),
        F.try_divide(F.col("e.hits"), F.least(F.col("e.k"), F.col("n"))).alias("precision"),
        (F.col("e.hits") / F.greatest(F.lit(1), F.col("positives"))).alias("recall"),
    )


def confusion_shares(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """All four (label, predicted) cells as shares of their true class."""
    predicted = (F.col(score) > C.SCORE_THRESHOLD).cast("int")
    counts = scores.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(predicted).alias("positive")
    )
    cells = F.array(
        F.struct(F.lit(0).alias("predicted"), (F.col("n") - F.col("positive")).alias("c")),
        F.struct(F.lit(1).alias("predicted"), F.col("positive").alias("c")),
    )
    both = scores.sparkSession.createDataFrame([(0,), (1,)], "label int").join(F.broadcast(counts), "label", "left")
    return both.select("label", "n", F.explode(cells).alias("e")).select(
        "label", F.col("e.predicted").alias("predicted"), F.coalesce(F.col("e.c") / F.col("n"), F.lit(0.0)).alias("share")
    )


def sensitivity(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` inside the open z range."""
    low, high = C.Z_RANGE
    inside = rows.where((F.col(x) > low) & (F.col(x) < high))
    return inside.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n")
    )


def binned_mean(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of ``y`` per unit bin of ``x`` inside the open z range."""
    low, high = C.Z_RANGE
    inside = rows.where((F.col(x) > low) & (F.col(x) < high))
    return inside.groupBy(F.floor(x).alias("bin")).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))


def rate_by_split(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    return rows.groupBy(split).agg(F.avg(label).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (number of classes * rows of the class), per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    weight = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    return counts.select(label, weight.alias("weight"))


def top_importance(importance: DataFrame, n: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def grouped_importance(importance: DataFrame, with_notes: bool = False) -> DataFrame:
    """Series features, and note components if asked, summed into one row each."""
    name = F.col("feature")
    if with_notes:
        series, pooled = C.HYBRID_SERIES_ROW, F.when(name.startswith("pca_"), F.lit(C.HYBRID_NOTES_ROW)).otherwise(name)
    else:
        series, pooled = C.SERIES_IMPORTANCE_ROW, name
    named = importance.withColumn("feature", F.when(name.startswith("ts_"), F.lit(series)).otherwise(pooled))
    return named.groupBy("feature").agg(F.sum("importance").alias("importance"))


def with_total_row(rows: DataFrame, name: str, values: list[str], total_name: str = "Total") -> DataFrame:
    total = rows.agg(*[F.sum(v).alias(v) for v in values]).withColumn(name, F.lit(total_name))
    return rows.unionByName(total)
