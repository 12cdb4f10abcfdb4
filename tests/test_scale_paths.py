"""The paths taken for heavy keys and large tables give the same results as the ordinary ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfsieve import ordering
from perfsieve.operators import embed, enrich, evaluate, splits, summary
from perfsieve.ordering import exact_quantiles, long_key, previous_value, row_at_rank, running_totals, select_ranks
from perfsieve.plans import proxies as P
from perfsieve.skew import heavy_keys, join_unique

SF_DIR = "/root/testdata/sf0.001"


def test_heavy_summaries(spark, tuned):
    # One id holds a third of the rows, the null id many more.
    key = F.when(F.col("seq") % 3 == 0, 5).when(F.col("seq") % 7 == 0, None).otherwise(F.col("alert_summary_id"))
    alerts = P.alerts(spark, SF_DIR).withColumns({"alert_summary_id": key, "seq": F.xxhash64("alert_summary_id", "seq")})
    ordinary = summary.aggregate_alerts(alerts).toPandas()
    tuned(heavyRows=10, smallGroup=50)
    assert heavy_keys(alerts, ["alert_summary_id"]) is not None
    heavy = summary.aggregate_alerts(alerts).toPandas()
    by_id = ["alert_summary_id"]
    a, b = (t.sort_values(by_id).reset_index(drop=True) for t in (ordinary, heavy))
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    assert a["alert_summary_id"].isna().sum() == 1


def test_mode_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, None), (3, 2, "z")], "id long, seq long, c string")
    out = {r["id"]: (r["c__mode"], r["c__nunique"]) for r in summary.category_profile(rows, ["id"], "seq", ["c"], ["c"]).collect()}
    assert out == {1: ("b", 2), 3: ("z", 1)}


@pytest.mark.parametrize("values", [{}, {"heavyRows": 3}], ids=["plain", "heavy"])
def test_join_unique(spark, tuned, values):
    tuned(**values)
    left = spark.createDataFrame([(i, None if i % 5 == 0 else i % 4) for i in range(60)], "i int, k int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, v string")
    out = {r["i"]: r["v"] for r in join_unique(left, right, ["k"]).collect()}
    assert out == {i: {0: "a", 1: "b"}.get(None if i % 5 == 0 else i % 4) for i in range(60)}
    assert join_unique(left, right, ["k"], "inner").count() == sum(v is not None for v in out.values())


def test_number_of_broadcast_keys_is_bounded(spark, tuned):
    tuned(heavyRows=2, maxHeavyKeys=3)
    rows = spark.range(400).selectExpr("CASE WHEN id < 64 THEN 1 WHEN id < 96 THEN 2 WHEN id < 112 THEN 3 ELSE id DIV 2 + 1000 END AS k")
    assert sorted(r["k"] for r in heavy_keys(rows, ["k"]).collect()) == [1, 2, 3]
    assert heavy_keys(rows, ["k"], heavy_rows=1000) is None


@pytest.mark.parametrize("small", [100_000, 200], ids=["one aggregate", "radix"])
def test_exact_quantiles(spark, tuned, small):
    tuned(smallGroup=small)
    rng = np.random.default_rng(2)
    groups = {"smooth": rng.normal(0, 5, 6000), "ties": np.repeat([1.0, 2.0, 2.5], [2000, 3500, 500]), "few": np.array([3.0, 1.0])}
    rows = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    frame = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("few", None)], "g string, v double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    out = exact_quantiles(frame, ["g"], "v", shares).collect()
    assert {r["g"]: r["n"] for r in out} == {"smooth": 6000, "ties": 6000, "few": 2}
    for r in out:
        assert r["quantiles"] == pytest.approx(list(np.quantile(groups[r["g"]], shares)), rel=1e-12, abs=1e-12)


NEIGHBOURS = 1.0 + np.arange(3000) * 2.0**-52


@pytest.mark.parametrize(
    "values",
    [
        NEIGHBOURS,  # all share their first 40 bits and any sketch's bracket
        np.concatenate([-NEIGHBOURS, NEIGHBOURS]),
        np.array([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 2.5, 2.5] * 100),
        np.concatenate([np.full(2000, 7.0), np.full(1000, 7.0000000000000009), [1e-300]]),
        np.array([math.inf, 1.0, -1.0] * 300),
    ],
    ids=["neighbours", "both signs", "extremes", "ties", "infinite"],
)
def test_ranks_of_values_no_sketch_can_part(spark, tuned, values):
    tuned(smallGroup=10)
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([("g", float(v)) for v in rng.permutation(values)], "g string, v double").repartition(4)
    shares = [0.0, 0.123, 0.5, 0.9, 1.0]
    out = exact_quantiles(frame, ["g"], "v", shares).first()
    ordered = np.sort(values)
    for share, found in zip(shares, out["quantiles"]):
        place = share * (len(ordered) - 1)
        low, high = ordered[math.floor(place)], ordered[math.ceil(place)]
        assert found == (low if low == high else low + (high - low) * (place - math.floor(place)))
    assert out["n"] == len(values)


def test_selected_ranks_tell_what_lies_below(spark):
    rng = np.random.default_rng(5)
    values = {g: rng.integers(-50, 50, 900) * scale for g, scale in (("a", 1), ("b", 2**40))}
    rows = spark.createDataFrame([(g, int(v)) for g, vs in values.items() for v in vs], "g string, v long")
    targets = [(g, i, r) for g in values for i, r in enumerate([0, 1, 449, 450, 899])]
    keys = rows.select("g", long_key(F.col("v")).alias("_key"))
    found = select_ranks(keys, ["g"], spark.createDataFrame(targets, "g string, _i int, _rank long"))
    out = {(r["g"], r["_i"]): (r["v"], r["_below"], r["_equal"]) for r in found.select("*", long_key(F.col("_key")).alias("v")).collect()}
    assert len(out) == len(targets)
    for g, i, rank in targets:
        value = int(np.sort(values[g])[rank])
        assert out[g, i] == (value, int((values[g] < value).sum()), int((values[g] == value).sum()))


def test_no_task_of_a_selection_holds_more_than_its_counters(spark, tuned, monkeypatch):
    """Every written step of a selection over 60,000 rows with one bracket stays below the counters' bound."""
    tuned(smallGroup=10)
    rows = spark.range(60_000).selectExpr("'g' AS g", "CAST(id AS DOUBLE) * 1e-9 + 1 AS v")
    written = []
    real = ordering.materialize

    def watched(df, purpose):
        out = real(df, purpose)
        written.append((purpose, out.count()))
        return out

    monkeypatch.setattr(ordering, "materialize", watched)
    out = exact_quantiles(rows, ["g"], "v", [0.5]).first()
    assert out["quantiles"] == [pytest.approx(1 + 29999.5e-9, abs=1e-15)]
    assert all(n <= 2 for purpose, n in written if purpose == "ranks")
    assert all(n <= 60_000 / 2 for purpose, n in written if purpose == "near-ranks")
    assert "ranks" in dict(written)


@pytest.mark.parametrize("small", [100_000, 100], ids=["top-k", "radix"])
def test_rows_at_ranks(spark, tuned, small):
    tuned(smallGroup=small)
    rng = np.random.default_rng(6)
    # A third of the rows share one time, some have none.
    times = [None if i % 11 == 0 else 500 if i % 3 == 0 else int(t) for i, t in enumerate(rng.integers(0, 2000, 3000))]
    ids = [int(i) for i in rng.permutation(3000)]
    rows = spark.createDataFrame(list(zip(times, ids)), "t long, id long")
    order = sorted(zip(times, ids), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    known = sum(t is not None for t in times)
    for rank in [0, 1, 700, 1200, 2399, known - 1, known, 2999]:
        assert row_at_rank(rows, "t", "id", rank, 3000, known) == order[rank]


def test_splits_agree_on_both_paths(spark, tuned):
    rows = P.table(spark, SF_DIR, "orders").selectExpr("o_orderkey AS alert_summary_id", "o_orderdate AS push_timestamp")
    first = {r[0]: r[1] for r in splits.time_split_with_tail(rows).select("alert_summary_id", "split").collect()}
    tuned(smallGroup=100)
    assert {r[0]: r[1] for r in splits.time_split_with_tail(rows).select("alert_summary_id", "split").collect()} == first


@pytest.mark.parametrize("per_bucket", [250_000, 10])
def test_running_totals_and_previous(spark, tuned, per_bucket):
    tuned(rowsPerBucket=per_bucket)
    rng = np.random.default_rng(9)
    keys = rng.permutation(np.unique(np.round(rng.exponential(3, 900), 4)))
    rows = pd.DataFrame({"k": keys, "n": rng.integers(1, 9, len(keys))})
    frame = spark.createDataFrame(rows)
    expected = rows.sort_values("k").reset_index(drop=True)
    got = running_totals(frame, "k", ["n"]).toPandas().sort_values("k")
    assert got["cum_n"].tolist() == expected["n"].cumsum().tolist()
    before = previous_value(frame, "k", "p").toPandas().sort_values("k")["p"].tolist()
    assert before[1:] == expected["k"].tolist()[:-1] and (before[0] is None or np.isnan(before[0]))


def test_gap_with_shared_times(spark, tuned):
    tuned(rowsPerBucket=10)
    rows = P.table(spark, SF_DIR, "orders").selectExpr("o_orderkey AS alert_summary_id", "o_orderdate AS push_timestamp")
    got = enrich.add_push_gap(rows).toPandas().sort_values(["push_timestamp", "alert_summary_id"])
    expected = got["push_timestamp"].diff().dt.total_seconds().fillna(3600)
    assert got["seconds_since_last_push"].tolist() == expected.tolist()


def test_average_precision_with_random_ties(spark):
    rng = np.random.default_rng(11)
    label, score = rng.integers(0, 2, 800), np.round(rng.random(800), 2)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score)], "label int, score double")
    ap, seen, hits = 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        at = score == s
        seen, hits = seen + at.sum(), hits + label[at].sum()
        ap += label[at].sum() / label.sum() * hits / seen
    assert evaluate.average_precision(rows).first()["average_precision"] == pytest.approx(ap)
    pairs = [(p > n) + 0.5 * (p == n) for p in score[label == 1] for n in score[label == 0]]
    assert evaluate.roc_auc(rows).first()["roc_auc"] == pytest.approx(float(np.mean(pairs)))


@pytest.mark.parametrize("block_bytes", [embed.BLOCK_BYTES, 100], ids=["one block", "many blocks"])
def test_pooling(spark, block_bytes):
    notes = [(1, "a b a  a"), (2, "b unknown"), (3, " "), (4, None), (5, "a"), (6, "nothing known"), (7, "a " * 25_000 + "b")]
    vectors = {"a": [1.0, -2.0], "b": [3.0, -4.0], "never": [9.0, 9.0], "used": [9.0, 9.0]}
    frame = spark.createDataFrame(notes, "id long, note string")
    words = spark.createDataFrame(list(vectors.items()), "word string, vector array<float>")
    out = {r["id"]: r["embedding"] for r in embed.pool_notes(frame, words, 2, "id", "note", block_bytes=block_bytes).collect()}
    assert out == {
        1: pytest.approx([1.5, -2.5, 3.0, -2.0]),
        2: pytest.approx([1.5, -2.0, 3.0, 0.0]),
        3: [0.0] * 4,
        4: [0.0] * 4,
        5: [1.0, -2.0, 1.0, -2.0],
        6: [0.0] * 4,
        7: pytest.approx([25_003 / 25_001, -50_004 / 25_001, 3.0, -2.0]),
    }
    grams = spark.createDataFrame([("<unkn", [2.0, 2.0]), ("nown>", [4.0, 6.0]), ("other", [9.0, 9.0])], "ngram string, vector array<float>")
    out = {r["id"]: r["embedding"] for r in embed.pool_notes(frame, words, 2, "id", "note", grams, block_bytes=block_bytes).collect()}
    assert out[2] == pytest.approx([3.0, 0.0, 3.0, 4.0])


def test_pooling_moves_no_vector(spark):
    notes = P.notes(spark, SF_DIR)
    words = spark.createDataFrame([("von", [1.0, 2.0]), ("the", [0.0, 1.0])], "word string, vector array<float>")
    plan = embed.pool_notes(notes, words, 2, "doc_id", "notes")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    # The vectors are broadcast; what `spread` deals out are the notes themselves.
    assert all("BroadcastExchange" in line or "RoundRobin" in line or "roundrobin" in line for line in exchanges), exchanges


def plain_bucket(gram: str, n: int) -> int:
    h = 2166136261
    for byte in gram.encode():
        h = ((h ^ (byte if byte < 128 else byte + 0xFFFFFF00)) * 16777619) % 2**32
    return h % n


def test_buckets_of_ngrams(spark):
    grams = ["<unkn", "nown>", "", "é", "日本語です", "a" * 30]
    rows = spark.createDataFrame([(g,) for g in grams], "g string")
    out = {r["g"]: r["b"] for r in rows.select("g", embed.ngram_bucket(F.col("g"), 2_000_000).alias("b")).collect()}
    assert out == {g: plain_bucket(g, 2_000_000) if g else None for g in grams}
    words = spark.createDataFrame([("unknown",)], "word string")
    buckets = spark.createDataFrame([(plain_bucket(g, 97), [float(i), 1.0]) for i, g in enumerate(["<unkn", "nown>"])], "bucket long, vector array<float>")
    assert embed.subword_vectors(words, buckets, n_buckets=97).first()["vector"] is not None


def test_folds_keep_the_class_ratio(spark):
    rows = spark.range(1003).selectExpr("id", "CAST(id % 7 = 0 AS INT) AS label")
    folds = splits.stratified_folds(rows, "label", "id")
    counts = folds.groupBy("label", "fold").count().toPandas()
    for _, part in counts.groupby("label"):
        assert part["count"].max() - part["count"].min() <= 1 and len(part) == 5


def test_components_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 4, 3, 1, 0.5, 0.1]) + 7.0
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, e array<double>")
    fitted = embed.fit_components(frame, "e", 3)
    got = embed.add_components(frame, fitted, "e", 3).orderBy("id").toPandas()[["pca_0", "pca_1", "pca_2"]].to_numpy()
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    axes = axes[:3] * np.sign(axes[np.arange(3), np.abs(axes[:3]).argmax(axis=1)])[:, None]
    np.testing.assert_allclose(got, (x - x.mean(axis=0)) @ axes.T, atol=1e-8)
