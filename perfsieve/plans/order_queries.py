"""Queries that depend on row order: gaps, splits, folds and top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.operators import enrich, evaluate, splits
from perfsieve.plans import proxies as P
from perfsieve.plans.registry import comparable, query, sql_round

# Orders with some unknown times; most times are shared by several orders.
TIMED = {
    "o_orderkey": "o_orderkey",
    "push_timestamp": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END",
    "bug_created": "CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END",
}
TIMED_SQL = f"SELECT {P.listing(TIMED)} FROM orders"
KEY, TIME = "o_orderkey", "push_timestamp"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in TIMED.items()])


@query(
    "push_gap",
    f"""WITH g AS (SELECT {KEY}, CASE WHEN {TIME} IS NULL THEN 3600 ELSE
            coalesce(epoch_us({TIME}) - epoch_us(lag({TIME}) OVER (ORDER BY {TIME} NULLS LAST, {KEY})), 3600000000) / 1e6 END AS gap
            FROM ({TIMED_SQL}))
        SELECT {KEY}, {sql_round('gap')} AS seconds_since_last_push, {sql_round('ln(1 + gap)')} AS log_time_since_last_push FROM g""",
)
def push_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).select(KEY, TIME)
    return comparable(enrich.add_push_gap(rows, TIME, KEY).drop(TIME))


@query("drop_null_time", f"SELECT {KEY}, epoch_us({TIME}) AS {TIME} FROM ({TIMED_SQL}) WHERE {TIME} IS NOT NULL")
def drop_null_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(splits.drop_null_time(timed(spark, sf_dir).select(KEY, TIME), TIME))


CHOICES = {"empty_time": "CASE WHEN o_orderkey < 0 THEN o_orderdate END", "o_orderdate": "o_orderdate"}


@query(
    "time_column_choice",
    f"""SELECT CASE WHEN count(empty_time) > 0 THEN 'empty_time' ELSE 'o_orderdate' END AS time_column, count(*) AS n
        FROM (SELECT {P.listing(CHOICES)} FROM orders)""",
)
def time_column_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in CHOICES.items()])
    chosen = splits.choose_time_column(rows, list(CHOICES))
    return comparable(rows.agg(F.lit(chosen).alias("time_column"), F.count(F.lit(1)).alias("n")))


_RANKED = f"""SELECT *, row_number() OVER (ORDER BY {TIME} NULLS LAST, {KEY}) AS rank, count(*) OVER () AS n FROM ({TIMED_SQL})"""


@query(
    "time_split_80_20",
    f"SELECT {KEY}, CASE WHEN rank > n - CAST(floor(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train_val' END AS split FROM ({_RANKED})",
)
def time_split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split(timed(spark, sf_dir), TIME, KEY).select(KEY, "split")


@query(
    "validation_tail",
    f"""WITH r AS (SELECT *, n - CAST(floor(0.2 * n) AS BIGINT) AS n_train FROM ({_RANKED}))
        SELECT {KEY}, CASE WHEN rank > n_train THEN 'test' WHEN rank > CAST(floor(0.9 * n_train) AS BIGINT) THEN 'val'
        ELSE 'train' END AS split FROM r""",
)
def validation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split_with_tail(timed(spark, sf_dir), TIME, KEY).select(KEY, "split")


@query(
    "time_split_70_10_20",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {TIME}, {KEY}) AS rank, count(*) OVER () AS n
            FROM ({TIMED_SQL}) WHERE {TIME} IS NOT NULL),
        c AS (SELECT *, CAST(floor(0.2 * n) AS BIGINT) AS n_test, CAST(floor(0.1 * n) AS BIGINT) AS n_val FROM r)
        SELECT {KEY}, CASE WHEN rank > n - n_test THEN 'test' WHEN rank > n - n_test - n_val THEN 'val' ELSE 'train' END AS split FROM c""",
)
def time_split_70_10_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_split_three(timed(spark, sf_dir), TIME, KEY).select(KEY, "split")


@query(
    "split_label_rate",
    f"""SELECT split, {sql_round('avg(label)')} AS positive_rate, count(*) AS n FROM (
        SELECT CASE WHEN rank > n - CAST(floor(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train_val' END AS split,
        coalesce(bug_created, 0) AS label FROM ({_RANKED})) GROUP BY split""",
)
def split_label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splits.time_split(timed(spark, sf_dir), TIME, KEY)
    return comparable(evaluate.rate_by_split(parts.withColumn("label", splits.label_as_int()), "label"))


@query(
    "stratified_folds",
    """SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS STRING) || '-42'), doc_id) - 1) % 5
        AS BIGINT) AS fold FROM (SELECT doc_id, CAST(quality AS BIGINT) AS label FROM labels)""",
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = P.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return comparable(splits.stratified_folds(labelled, "label", "doc_id"))


@query("class_weights", f"""SELECT CAST(quality AS BIGINT) AS label, {sql_round('sum(n) OVER () / (count(*) OVER () * n)')} AS weight
        FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = P.table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))
    return comparable(evaluate.class_weights(labelled, "label"))


# --- importance tables: one importance per part type and brand ------------------------------
IMPORTANCE = {
    "feature": "CASE WHEN p_type = 'PROMO' THEN 'ts_' WHEN p_type = 'SMALL' THEN 'pca_' ELSE '' END || lower(p_type) || '_' || p_brand || '_' || CAST(p_size AS STRING)",
    "importance": "p_retailprice",
}
IMPORTANCE_SQL = (
    f"SELECT feature, sum(importance) AS importance FROM (SELECT {P.listing(IMPORTANCE)} FROM part) GROUP BY feature"
)


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in IMPORTANCE.items()])
    return rows.groupBy("feature").agg(F.sum("importance").alias("importance"))


@query(
    "topn_importance",
    f"SELECT feature, {sql_round('importance', 3)} AS importance FROM ({IMPORTANCE_SQL}) ORDER BY 2 DESC, 1 LIMIT 20",
)
def topn_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_importance(comparable(importance(spark, sf_dir), 3), 20)


@query(
    "importance_grouped",
    f"""SELECT CASE WHEN starts_with(feature, 'ts_') THEN 'Time Series (Signals)' WHEN starts_with(feature, 'pca_')
        THEN 'NLP: Human Notes' ELSE feature END AS feature, {sql_round('sum(importance)', 3)} AS importance
        FROM ({IMPORTANCE_SQL}) GROUP BY 1""",
)
def importance_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.grouped_importance(importance(spark, sf_dir), with_notes=True), 3)


@query(
    "union_all_summary_rows",
    """SELECT o_orderpriority AS item, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY 1
        UNION ALL SELECT 'Total', count(*), CAST(round(sum(o_totalprice), 2) AS DOUBLE) FROM orders""",
)
def union_all_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = P.table(spark, sf_dir, "orders")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")]
    rows = orders.groupBy(F.col("o_orderpriority").alias("item")).agg(*sums)
    return comparable(evaluate.with_total_row(rows, "item", ["n", "total"]), 2)
