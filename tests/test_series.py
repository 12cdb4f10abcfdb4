"""Series positions and windows against plain loops over small fixtures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.operators import series as S

POINTS = "folder string, signature_id long, push_id double, seq long, revision string, value double"


def slope(y):
    x = np.arange(len(y))
    return 0.0 if len(y) < 2 else float(np.polyfit(x, y, 1)[0])


def loop_multi(values, at):
    """Expected features for 0-based position ``at``."""
    out = {}
    for n_pre, n_post, name in C.WINDOW_SCALES:
        pre, post = values[max(0, at - n_pre) : at], values[at + 1 : at + 1 + n_post]
        if len(pre) < 2 or len(post) < 2:
            out |= {f"ts_{m}_{name}": None for m in C.WINDOW_METRICS}
            continue
        moved, std = post.mean() - pre.mean(), pre.std(ddof=1)
        out[f"ts_delta_{name}"] = moved / max(abs(pre.mean()), 1e-9)
        out[f"ts_z_{name}"] = moved / std if std > 0 else (100.0 if abs(moved) > 1e-9 else 0.0)
        out[f"ts_slope_{name}"] = slope(post) - slope(pre)
        out[f"ts_std_ratio_{name}"] = post.std(ddof=1) / max(std, 1e-9)
        a, b = np.median(pre), np.median(post)
        out[f"ts_median_shift_{name}"] = (b - a) / max(abs(a), 1e-9)
        a, b = np.percentile(pre, 90), np.percentile(post, 90)
        out[f"ts_p90_delta_{name}"] = (b - a) / max(abs(a), 1e-9)
    return out


def make_series(seed=3):
    """Two folders; one long series (several blocks), repeated pushes, one constant series."""
    rng = np.random.default_rng(seed)
    rows = []
    for folder, sig, n in [("autoland1", 1, 1300), ("autoland1", 2, 40), ("beta", 2, 60), ("beta", 3, 9)]:
        push = np.sort(rng.integers(0, 2 * n, n))
        for i in range(n):
            value = 10.0 if sig == 3 else round(float(rng.normal(50, 9)), 3)
            rows.append((folder, sig, float(push[i]), len(rows), f"r{push[i]}", value))
    return rows


def make_pairs(rows, rng):
    pairs = []
    for folder, sig in sorted({(r[0], r[1]) for r in rows}):
        top = max(r[2] for r in rows if r[:2] == (folder, sig))
        for anchor in [*rng.integers(-2, int(top) + 5, 60), -1]:
            pairs.append((len(pairs), folder, sig, float(anchor)))
    return pairs


def position(rows, folder, sig, anchor, rule="asof"):
    mine = sorted([r for r in rows if r[:2] == (folder, sig)], key=lambda r: (r[2], r[3]))
    push = np.array([r[2] for r in mine])
    exact, upto = np.where(push == anchor)[0], np.where(push <= anchor)[0]
    if rule == "exact" and len(exact):
        return int(exact[0]), mine
    return (int(upto[-1]) if len(upto) else None), mine


@pytest.fixture(scope="module")
def data():
    rows = make_series()
    return rows, make_pairs(rows, np.random.default_rng(4))


HEAVY = {"heavyRows": 30, "rowsPerBucket": 20}


@pytest.mark.parametrize("values", [{}, HEAVY], ids=["plain", "heavy"])
@pytest.mark.parametrize("rule", ["asof", "exact"])
def test_positions(spark, tuned, data, rule, values):
    tuned(**values)
    rows, pairs = data
    points = spark.createDataFrame(rows, POINTS)
    asked = spark.createDataFrame(pairs, "id long, folder string, signature_id long, anchor double")
    placed = S.positions(points, asked, rule=rule)
    got = {(r[0], r[1], r["anchor"]): r["idx"] for r in S.anchor_positions(placed).collect()}
    for _, folder, sig, anchor in pairs:
        at, _ = position(rows, folder, sig, anchor, rule)
        assert got.get((folder, sig, anchor)) == (None if at is None else at + 1)
    ranks = {(r[0], r[1]): r["n"] for r in S.placed_points(placed).groupBy("folder", "signature_id").agg(F.count_distinct("rn").alias("n")).collect()}
    assert ranks == pd.DataFrame(rows).groupby([0, 1]).size().to_dict()


@pytest.mark.parametrize("values", [{}, HEAVY], ids=["plain", "heavy"])
def test_one_push_may_hold_most_points(spark, tuned, values):
    tuned(**values)
    rows = [("f", 1, 5.0 if i % 4 else float(i), i, "r", float(i)) for i in range(400)]
    points = spark.createDataFrame(rows, POINTS)
    asked = spark.createDataFrame([("f", 1, a) for a in [5.0, 4.0, 6.0, 500.0, -1.0]], "folder string, signature_id long, anchor double")
    for rule in ["asof", "exact"]:
        placed = S.positions(points, asked, rule=rule)
        got = {r["anchor"]: r["idx"] for r in S.anchor_positions(placed).collect()}
        for anchor in [5.0, 4.0, 6.0, 500.0, -1.0]:
            at, mine = position(rows, "f", 1, anchor, rule)
            assert got.get(anchor) == (None if at is None else at + 1), (rule, anchor)
        order = [r["seq"] for r in placed.where("rn IS NOT NULL").orderBy("rn").collect()]
        assert order == [r[3] for r in mine]


@pytest.mark.parametrize("values", [{}, HEAVY], ids=["plain", "heavy"])
def test_file_order(spark, tuned, values):
    tuned(**values)
    rng = np.random.default_rng(8)
    rows = [("f", 1, float(rng.integers(0, 300)) if i % 9 else None, i, "r", float(i)) for i in range(300)]
    points = spark.createDataFrame(rows, POINTS)
    anchors = [float(a) for a in range(-1, 310, 7)]
    asked = spark.createDataFrame([("f", 1, a) for a in anchors], "folder string, signature_id long, anchor double")
    got = {r["anchor"]: r["idx"] for r in S.anchor_positions(S.positions(points, asked, file_order=True)).collect()}
    for anchor in anchors:
        hits = [i for i, r in enumerate(rows) if r[2] is not None and r[2] <= anchor]
        assert got.get(anchor) == (hits[-1] + 1 if hits else None)


def check_features(rows, pairs, got, features_of):
    for key, folder, sig, anchor in pairs:
        at, mine = position(rows, folder, sig, anchor)
        expected = features_of(np.array([r[5] for r in mine]), at) if at is not None else {}
        for name, value in expected.items():
            have = got[key][name]
            assert (have is None) == (value is None), (key, name, have, value)
            if value is not None:
                assert have == pytest.approx(value, rel=1e-7, abs=1e-9), (key, name)


@pytest.mark.parametrize("values", [{}, HEAVY], ids=["plain", "heavy"])
def test_multi_scale_windows_equal_a_loop(spark, tuned, data, values):
    tuned(**values)
    rows, pairs = data
    points = spark.createDataFrame(rows, POINTS).orderBy(F.rand(1))  # input order must not matter
    asked = spark.createDataFrame(pairs, "alert_summary_id long, alert_summary_repository string, signature_id long, anchor double")
    asked = asked.withColumn("alert_summary_framework", F.lit("talos"))
    files = points.select("folder", "signature_id").distinct()
    got = {r["alert_summary_id"]: r for r in S.window_features(asked, points, files).collect()}
    assert len(got) == len(pairs)
    check_features(rows, pairs, got, loop_multi)


def test_worked_windows(spark):
    values = [10, 10, 11, 9, 10, 12, 20, 21, 19, 20, 22, 20]
    points = spark.createDataFrame([("f", 1, 101.0 + i, i, "r", float(v)) for i, v in enumerate(values)], POINTS)
    asked = spark.createDataFrame([(a, "f", 1, float(a)) for a in [106, 107, 102, 111, 100]], "alert_summary_id long, alert_summary_repository string, signature_id long, anchor double")
    rows = {r[0]: r for r in S.window_features(asked, points, points.select("folder", "signature_id").distinct()).select("alert_summary_id", *[f"ts_{m}_short" for m in C.WINDOW_METRICS]).collect()}
    assert tuple(rows[106])[1:] == pytest.approx((1.04, 14.707821048680186, 0.4, 1.6124515496597096, 1.0, 1.037735849056604))
    assert tuple(rows[107])[1:] == pytest.approx((0.9615384615384613, 8.770580193070291, -0.2, 1.0, 1.0, 0.8620689655172415))
    for nothing in (102, 111, 100):
        assert tuple(rows[nothing])[1:] == (None,) * 6


def test_constant_sides(spark):
    points = spark.createDataFrame([("f", 1, float(i), i, "r", 10.0 if i < 5 else 20.0) for i in range(11)], POINTS)
    asked = spark.createDataFrame([(1, "f", 1, 5.0), (2, "f", 1, 2.0)], "alert_summary_id long, alert_summary_repository string, signature_id long, anchor double")
    rows = {r["alert_summary_id"]: r for r in S.window_features(asked, points, points.select("folder", "signature_id").distinct()).collect()}
    assert (rows[1]["ts_delta_short"], rows[1]["ts_z_short"], rows[1]["ts_std_ratio_short"]) == (1.0, 100.0, 0.0)
    few = S.multi_scale_features(spark.createDataFrame([("f", 1, 3, [10.0, 10.0], [10.0, 10.0])], "folder string, signature_id long, idx long, pre array<double>, post array<double>"))
    assert (few.first()["ts_z_short"], few.first()["ts_delta_short"]) == (0.0, 0.0)


def test_single_scale_uses_revision_when_no_push_fits(spark):
    points = spark.createDataFrame([("f", 1, 10.0 + i, i, f"rev{i // 2}", float(i * i)) for i in range(12)], POINTS)
    asked = spark.createDataFrame(
        [(1, "f", 1, 14.0, "none"), (2, "f", 1, None, "rev3"), (3, "f", 1, 3.0, "rev1"), (4, "f", 1, 3.0, "none"), (5, "f", 99, 14.0, "rev1")],
        "alert_summary_id long, alert_summary_repository string, signature_id long, anchor double, anchor_revision string",
    )
    out = S.window_features_single(asked, points, points.select("folder", "signature_id").distinct())
    rows = {r["alert_summary_id"]: r for r in out.collect()}
    assert [rows[i]["idx"] for i in (1, 2, 3, 4, 5)] == [5, 7, 3, None, None]
    assert [rows[i]["ts_n_pre"] for i in (1, 2, 3, 4)] == [4, 6, 2, None]
    pre, post = np.array([0, 1, 4, 9.0]), np.array([25, 36, 49, 64, 81, 100, 121.0])
    assert rows[1]["ts_delta_mean"] == pytest.approx(post.mean() - pre.mean())
    assert rows[1]["ts_delta_std"] == pytest.approx(post.std(ddof=1) - pre.std(ddof=1))
    assert rows[1]["ts_slope_change"] == pytest.approx(slope(post) - slope(pre))
    rolled = {r[0]: r for r in S.rollup_single(out).collect()}
    assert (rolled[4]["ts_sig_used"], rolled[4]["ts_sig_missing"]) == (1, 0)
    assert (rolled[5]["ts_sig_used"], rolled[5]["ts_sig_missing"]) == (0, 1)


@pytest.mark.parametrize("values", [{}, {"heavyRows": 2}], ids=["plain", "heavy"])
def test_resolution_order(spark, tuned, values):
    tuned(**values)
    files = spark.createDataFrame(
        [("autoland1", 1), ("autoland2", 1), ("beta", 1), ("beta", 2), ("x-android", 2), ("zeta", 3), ("alpha", 3)], "folder string, signature_id long"
    )
    pairs = spark.createDataFrame(
        [(1, 1, "BETA", "f"), (2, 1, "autoland", "f"), (3, 1, "other", None), (4, 2, "fenix", "android"), (5, 3, None, None), (6, 9, "beta", "f")],
        "alert_summary_id long, signature_id long, alert_summary_repository string, alert_summary_framework string",
    )

    def folders(**options):
        return [r["folder"] for r in S.resolve_series(pairs, files, **options).orderBy("alert_summary_id").collect()]

    assert folders() == ["beta", "autoland1", "autoland1", "beta", "alpha", None]
    assert folders(android_rule=True) == ["beta", "autoland1", "autoland1", "x-android", "alpha", None]
