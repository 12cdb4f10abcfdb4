"""Queries on embeddings, ranking metrics and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.operators import embed, evaluate, selection, splits, summary, tuning
from perfsieve.plans import proxies as P
from perfsieve.plans import variants
from perfsieve.plans.registry import comparable, query, sql_round
from perfsieve.plans.series_queries import clean, files
from perfsieve.plans.text_queries import _NOT_SPACE
from perfsieve.session import materialize

DIMENSIONS = 64


# --- embeddings ----------------------------------------------------------------------------
def word_vectors(spark: SparkSession, sf_dir: str, words: DataFrame) -> DataFrame:
    """(word, vector): each word takes the embedding its hash points at."""
    vectors = P.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = vectors.count()
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % F.lit(n)
    # Written once: else the join's null test takes the digest of every use of a word, below the distinct.
    listed = materialize(words.select("word").distinct(), "words")
    return listed.withColumn("vec_id", bucket).join(vectors, "vec_id").select("word", "vector")


@query(
    "embed_notes",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(notes, '{_NOT_SPACE}+')) AS word FROM ({P.notes_sql()})),
        b AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id, count(*) AS n
            FROM t GROUP BY ALL),
        e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, {DIMENSIONS})) AS dim FROM embeddings),
        p AS (SELECT doc_id, dim, sum(CAST(v AS DOUBLE) * n) / sum(n) AS mean_value, max(CAST(v AS DOUBLE)) AS max_value
            FROM b JOIN e USING (vec_id) GROUP BY ALL),
        g AS (SELECT doc_id, unnest(range(0, {DIMENSIONS})) AS dim FROM documents)
        SELECT g.doc_id, CAST(g.dim AS BIGINT) AS dim, {sql_round('coalesce(mean_value, 0)')} AS mean_value,
            {sql_round('coalesce(max_value, 0)')} AS max_value FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.dim = p.dim""",
)
def embed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = P.notes(spark, sf_dir)
    words = embed.token_counts(notes, "doc_id", "notes", counted=False)
    pooled = embed.pool_notes(notes, word_vectors(spark, sf_dir, words), DIMENSIONS, "doc_id", "notes")
    halves = F.arrays_zip(
        F.slice("embedding", 1, DIMENSIONS).alias("mean_value"), F.slice("embedding", DIMENSIONS + 1, DIMENSIONS).alias("max_value")
    )
    rows = pooled.select("doc_id", F.posexplode(halves).alias("dim", "e"))
    return comparable(rows.select("doc_id", "dim", "e.mean_value", "e.max_value"))


N_BUCKETS = 499
_FNV_SQL = """list_reduce([2166136261] || list_transform(range(0, octet_length(encode(gram))), lambda i:
    CAST('0x' || substr(hex(encode(gram)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda h, b: (xor(CAST(h AS BIGINT), CASE WHEN b < 128 THEN b ELSE b + 4294967040 END) * 16777619) % 4294967296)"""


@query(
    "embed_notes_unknown_words",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(notes, '{_NOT_SPACE}+')) AS word FROM ({P.notes_sql()})),
        w AS (SELECT DISTINCT word, '<' || word || '>' AS m FROM t WHERE length(word) % 2 = 1),
        g AS (SELECT word, substr(m, i, 5) AS gram FROM (SELECT word, m, unnest(range(1, length(m) - 3)) AS i FROM w)),
        b AS (SELECT DISTINCT gram, {_FNV_SQL} % {N_BUCKETS} AS bucket FROM (SELECT DISTINCT gram FROM g)),
        e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, {DIMENSIONS})) AS dim FROM embeddings),
        o AS (SELECT word, dim, CAST(CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE) AS v FROM g JOIN b USING (gram) JOIN e ON vec_id = bucket GROUP BY ALL),
        k AS (SELECT word, dim, CAST(v AS DOUBLE) AS v FROM (SELECT DISTINCT word,
            CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id FROM t WHERE length(word) % 2 = 0) JOIN e USING (vec_id)),
        a AS (SELECT * FROM o UNION ALL SELECT * FROM k),
        c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL),
        z AS (SELECT c.doc_id, x.dim, c.n, coalesce(a.v, 0) AS v FROM c CROSS JOIN (SELECT unnest(range(0, {DIMENSIONS})) AS dim) x
            LEFT JOIN a ON a.word = c.word AND a.dim = x.dim),
        p AS (SELECT doc_id, dim, sum(v * n) / sum(n) AS mean_value, max(v) AS max_value FROM z GROUP BY ALL),
        q AS (SELECT doc_id, unnest(range(0, {DIMENSIONS})) AS dim FROM documents)
        SELECT q.doc_id, CAST(q.dim AS BIGINT) AS dim, {sql_round('coalesce(mean_value, 0)')} AS mean_value,
            {sql_round('coalesce(max_value, 0)')} AS max_value FROM q LEFT JOIN p ON q.doc_id = p.doc_id AND q.dim = p.dim""",
)
def embed_notes_unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an odd length have no vector of their own: they take the mean of their n-grams' buckets."""
    notes = P.notes(spark, sf_dir)
    words = embed.token_counts(notes, "doc_id", "notes", counted=False).where(F.length("word") % 2 == 0)
    buckets = P.table(spark, sf_dir, "embeddings").where(F.col("vec_id") < N_BUCKETS).select(F.col("vec_id").alias("bucket"), F.col("embedding").alias("vector"))
    vectors = word_vectors(spark, sf_dir, words)
    pooled = embed.pool_notes(notes, vectors, DIMENSIONS, "doc_id", "notes", buckets, N_BUCKETS)
    halves = F.arrays_zip(
        F.slice("embedding", 1, DIMENSIONS).alias("mean_value"), F.slice("embedding", DIMENSIONS + 1, DIMENSIONS).alias("max_value")
    )
    rows = pooled.select("doc_id", F.posexplode(halves).alias("dim", "e"))
    return comparable(rows.select("doc_id", "dim", "e.mean_value", "e.max_value"))


@query("pca_embeddings")
def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.timestamp_micros("vec_id").alias("t"))
    parts = splits.time_split(rows, "t", "vec_id").drop("t")
    fitted = embed.fit_components(parts.where(F.col("split") == "train_val"), "embedding", 20)
    return comparable(embed.add_components(parts, fitted, "embedding", 20).drop("embedding"))


# --- ranking metrics -----------------------------------------------------------------------
_RANKED_SQL = f"""
s AS ({P.scores_sql()}),
g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY score),
c AS (SELECT score, pos, n, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(n) OVER (ORDER BY score DESC) AS cum_n,
    sum(pos) OVER () AS total FROM g)
"""


@query(
    "precision_recall_at_k",
    f"""WITH s AS ({P.scores_sql()}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s),
        w AS (SELECT count(*) AS n, sum(label) AS total FROM s)
        SELECT CAST(k AS BIGINT) AS k, {sql_round('sum(CASE WHEN rank <= k THEN label ELSE 0 END) / least(k, any_value(n))')} AS precision,
        {sql_round('sum(CASE WHEN rank <= k THEN label ELSE 0 END) / greatest(1, any_value(total))')} AS recall
        FROM r, w, (VALUES (50), (100), (200)) ks(k) GROUP BY k""",
)
def precision_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.precision_recall_at(P.scores(spark, sf_dir), key="doc_id"))


@query(
    "average_precision",
    f"""WITH {_RANKED_SQL} SELECT {sql_round('sum(pos * cum_pos / cum_n) / any_value(total)')} AS average_precision,
        CAST(any_value(total) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS "rows" FROM c""",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.average_precision(P.scores(spark, sf_dir)))


@query(
    "roc_auc",
    f"""WITH s AS ({P.scores_sql()}) SELECT {sql_round('avg(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END)')} AS roc_auc
        FROM s p JOIN s q ON p.label = 1 AND q.label = 0""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.roc_auc(P.scores(spark, sf_dir)))


@query(
    "pr_curve",
    f"""WITH {_RANKED_SQL} SELECT {sql_round('score')} AS threshold, {sql_round('cum_pos / cum_n')} AS precision,
        {sql_round('cum_pos / total')} AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0""",
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.pr_curve(P.scores(spark, sf_dir)))


@query(
    "confusion_normalized",
    f"""WITH s AS ({P.scores_sql()}) SELECT CAST(l AS BIGINT) AS label, CAST(p AS BIGINT) AS predicted,
        {sql_round('(SELECT avg(CASE WHEN (score > 0.5) = (p = 1) THEN 1.0 ELSE 0.0 END) FROM s WHERE label = l)')} AS share
        FROM (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(p)""",
)
def confusion_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(evaluate.confusion_shares(P.scores(spark, sf_dir)))


_Z_SQL = """SELECT (e.value - g.m) / g.s AS z, (event_id * 7 % 101) / 100 AS score FROM events e
    JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type) g USING (event_type)"""


@query(
    "score_sensitivity",
    f"""WITH r AS ({_Z_SQL}), f AS (SELECT * FROM r WHERE z > -5 AND z < 5)
        SELECT CAST(NULL AS BIGINT) AS bin, {sql_round('regr_slope(score, z)')} AS slope, {sql_round('regr_intercept(score, z)')} AS intercept,
            CAST(NULL AS DOUBLE) AS mean, count(*) AS n FROM f
        UNION ALL SELECT CAST(floor(z) AS BIGINT), NULL, NULL, {sql_round('avg(score)')}, count(*) FROM f GROUP BY 1""",
)
def score_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = P.table(spark, sf_dir, "events")
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    rows = events.join(stats, "event_type").selectExpr("(value - m) / s AS z", "(event_id * 7 % 101) / 100 AS score")
    line = evaluate.sensitivity(rows, "z", "score")
    bins = evaluate.binned_mean(rows, "z", "score")
    return comparable(bins.unionByName(line, allowMissingColumns=True))


# --- models --------------------------------------------------------------------------------
def _metric_rows(tables: dict[str, DataFrame]) -> DataFrame:
    return comparable(tables["metrics"])


@query("train_gbt_static")
def train_gbt_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, bugs = P.alerts(spark, sf_dir), P.bugs(spark, sf_dir)
    return _metric_rows(variants.run_variant(spark, alerts, bugs, C.STATIC_MODEL, blind=True))


@query("train_gbt_ts")
def train_gbt_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, bugs, points = P.alerts(spark, sf_dir), P.bugs(spark, sf_dir), clean(spark, sf_dir)
    listed = files(P.series(spark, sf_dir))
    return _metric_rows(variants.run_variant(spark, alerts, bugs, C.SERIES_MODEL, points=points, files=listed))


@query("train_gbt_hybrid")
def train_gbt_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, bugs, points = P.alerts(spark, sf_dir), P.bugs(spark, sf_dir), clean(spark, sf_dir)
    words = embed.token_counts(alerts.select(C.SUMMARY_ID, C.NOTES), C.SUMMARY_ID, C.NOTES, counted=False)
    vectors = materialize(word_vectors(spark, sf_dir, words), "word-vectors")
    tables = variants.run_variant(
        spark,
        alerts,
        bugs,
        C.HYBRID_MODEL,
        points=points,
        files=files(P.series(spark, sf_dir)),
        vectors=vectors,
        dimensions=DIMENSIONS,
    )
    return _metric_rows(tables)


_SUMMARY_SQL = f"""SELECT {C.SUMMARY_ID} AS id, max({C.PUSH_TIME}) AS t, max(CASE WHEN {C.BUG_NUMBER} IS NOT NULL THEN 1 ELSE 0 END) AS label
    FROM ({P.alerts_sql([C.SUMMARY_ID, C.PUSH_TIME, C.BUG_NUMBER])}) GROUP BY 1"""
_SPLIT_SQL = f"""s AS ({_SUMMARY_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY t NULLS LAST, id) AS rank, count(*) OVER () AS n FROM s),
    p AS (SELECT id, label, CASE WHEN rank > n - CAST(floor(0.2 * n) AS BIGINT) THEN 'test'
        WHEN rank > CAST(floor(0.9 * (n - CAST(floor(0.2 * n) AS BIGINT))) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM r)"""


@query(
    "train_checks_static",
    f"""WITH {_SPLIT_SQL} SELECT 'rows_' || split AS item, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY split
        UNION ALL SELECT 'positives_' || split, CAST(sum(label) AS DOUBLE) FROM p GROUP BY split
        UNION ALL SELECT i, CAST(count(*) AS DOUBLE) FROM p, (VALUES ('scored'), ('scores_in_range'), ('scores_at_their_row')) v(i)
            WHERE split = 'test' GROUP BY i
        UNION ALL SELECT 'importance_sum', 100.0""",
)
def train_checks_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a short training that SQL can tell as well: what it is fit and judged on, and the shape of its results."""
    settings = {**C.STATIC_MODEL, "iterations": 3}
    tables = variants.run_variant(spark, P.alerts(spark, sf_dir), P.bugs(spark, sf_dir), settings, blind=True)
    rows, scores = tables["features"], tables["scores"]
    by_split = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(C.LABEL).cast("long")).alias("positives"))
    counted = by_split.selectExpr("stack(2, 'rows_' || split, rows, 'positives_' || split, positives) AS (item, value)")
    own = rows.where("split = 'test'").select(C.SUMMARY_ID, F.col(C.LABEL).alias("_own"))
    met = scores.join(own, C.SUMMARY_ID).where(F.col(C.LABEL) == F.col("_own"))
    facts = [
        scores.agg(F.lit("scored").alias("item"), F.count(F.lit(1)).alias("value")),
        scores.agg(F.lit("scores_in_range").alias("item"), F.count_if(F.col("score").between(0, 1)).alias("value")),
        met.agg(F.lit("scores_at_their_row").alias("item"), F.count(F.lit(1)).alias("value")),
        tables["shares"].agg(F.lit("importance_sum").alias("item"), F.sum("importance").alias("value")),
    ]
    doubles = [fact.select("item", F.col("value").cast("double").alias("value")) for fact in [counted, *facts]]
    return comparable(reduce(DataFrame.unionByName, doubles))


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 80 percent of the summaries with their features, weights and folds."""
    table = variants.feature_table(P.alerts(spark, sf_dir), P.bugs(spark, sf_dir))
    old = splits.time_split(table).where("split <> 'test'").drop("split")
    return materialize(splits.stratified_folds(old, C.LABEL, C.SUMMARY_ID), "search-rows")


@query(
    "search_folds",
    f"""WITH {_SPLIT_SQL}, f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS STRING) || '-{C.FOLD_SEED}'), id) - 1) % 5
            AS fold FROM p WHERE split <> 'test')
        SELECT CAST(fold AS BIGINT) AS fold, CAST(label AS BIGINT) AS label, count(*) AS n FROM f GROUP BY ALL""",
)
def search_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fold and label that a search sees."""
    condensed = summary.aggregate_alerts(P.alerts(spark, sf_dir, [C.SUMMARY_ID, "seq", C.PUSH_TIME, C.BUG_NUMBER]))
    rows = materialize(condensed.withColumn(C.LABEL, splits.label_as_int()), "summary")
    old = splits.time_split(rows).where("split <> 'test'")
    folds = splits.stratified_folds(old, C.LABEL, C.SUMMARY_ID)
    return comparable(folds.groupBy("fold", F.col(C.LABEL).alias("label")).agg(F.count(F.lit(1)).alias("n")))


# The registered search is small: so many rounds at most, ended by so many without gain.
SEARCH_ROUNDS, SEARCH_PATIENCE = 12, 4


@query("cv_grid")
def cv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _searchable(spark, sf_dir)
    names = selection.feature_names([c for c in table.columns if c != "fold"], blind=True)
    settings = {**C.STATIC_MODEL, "iterations": SEARCH_ROUNDS}
    points = tuning.grid({"depth": [C.STATIC_MODEL["depth"]], "positive_weight": [1.0, C.STATIC_MODEL["positive_weight"]]})
    tried = tuning.search(table, names, settings, points, patience=SEARCH_PATIENCE)
    rows = [(int(t.changed["depth"]), float(t.changed["positive_weight"]), t.mean) for t in tried]
    return comparable(spark.createDataFrame(rows, "depth int, positive_weight double, mean_average_precision double"))


@query("text_dataset")
def text_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = files(P.series(spark, sf_dir))
    table, _, _ = variants.text_table(P.alerts(spark, sf_dir), clean(spark, sf_dir), listed)
    return table.select(C.SUMMARY_ID, "split", C.LABEL, "notes_sanitized", "fused_text_sanitized", "all_text")
