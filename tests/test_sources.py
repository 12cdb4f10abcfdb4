"""Reading input folders laid out as a user has them, and a whole run from files to reports."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.plans import variants
from perfsieve.session import spread, work_folder
from perfsieve.sources import files, series


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """alerts_data.csv, bugs_data.csv, timeseries-data/<folder>/<id>_timeseries_data.csv, word vectors."""
    base = tmp_path_factory.mktemp("input")
    rng = np.random.default_rng(12)
    rows = []
    for summary in range(120):
        bug = 900 + summary if summary % 3 == 0 else ""
        for _ in range(int(rng.integers(1, 4))):
            context = json.dumps([{"value": float(v), "push_timestamp": f"2024-01-0{i + 1}"} for i, v in enumerate(rng.integers(1, 9, 3))])
            rows.append(
                {
                    "alert_summary_id": summary,
                    "alert_summary_bug_number": bug,
                    "signature_id": int(rng.integers(1, 7)) if rng.random() > 0.1 else "bad",
                    "push_timestamp": str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=3 * summary)),
                    "alert_summary_repository": "autoland" if summary % 2 else "central",
                    "alert_summary_framework": "talos",
                    "alert_summary_push_id": 100 + summary,
                    "alert_summary_revision": f"r{summary}",
                    "alert_summary_related_alerts": "|1|2|" if summary % 4 == 0 else "NaN",
                    "alert_summary_notes": 'line one\nline "two", bug 12345' if summary % 5 == 0 else "",
                    "alert_summary_performance_tags": "infra, improvement" if summary % 3 == 0 else "none",
                    "single_alert_amount_abs": round(float(rng.normal(5 + 4 * (summary % 3 == 0), 1)), 3),
                    "single_alert_amount_pct": "inf?" if rng.random() < 0.05 else round(float(rng.normal(3, 1)), 3),
                    "single_alert_new_value": round(float(rng.normal(4, 1)), 3),
                    "single_alert_is_regression": bool(rng.random() < 0.7),
                    "single_alert_noise_profile": ["SKEWED", "OK", "N/A"][int(rng.integers(0, 3))],
                    "single_alert_backfill_record_context": context,
                    "single_alert_backfill_record_total_backfills_failed": "(1,",
                    "single_alert_series_signature_machine_platform": "linux1804-64-qr",
                    "single_alert_series_signature_extra_options": "e10s,stylo",
                }
            )
    (base / "deep").mkdir()
    pd.DataFrame(rows).to_csv(base / "deep" / "alerts_data.csv", index=False)
    pd.DataFrame([{"id": 900 + s, "priority": ["P1", "P2", "--"][s % 3 - 1]} for s in range(0, 120, 3)]).to_csv(base / "bugs_data.csv", index=False)
    for folder, signatures in {"autoland1": [1, 2, 3], "central": [3, 4, 5], "other": ["notanid"]}.items():
        place = base / "timeseries-data" / folder
        place.mkdir(parents=True)
        for signature in signatures:
            push = np.arange(60, 260, 2)
            value = [str(round(float(v), 2)) for v in rng.normal(20, 3, len(push))]
            value[7] = "oops"
            table = pd.DataFrame({"revision": [f"r{p - 100}" for p in push], "push_id": push, "value": value})
            table.to_csv(place / f"{signature}_timeseries_data.csv", index=False)
    return str(base)


def test_alerts_and_bugs(spark, root):
    alerts, bugs = files.load_raw_data(spark, root)
    assert bugs.count() == 40 and dict(bugs.dtypes)["id"] == "bigint"
    raw = pd.read_csv(f"{root}/deep/alerts_data.csv")
    got = alerts.orderBy("seq").toPandas()
    assert got["alert_summary_id"].tolist() == raw["alert_summary_id"].tolist()
    assert got["alert_summary_notes"].isna().sum() == raw["alert_summary_notes"].isna().sum()
    assert 'line one\nline "two", bug 12345' in set(got["alert_summary_notes"])
    assert got["signature_id"].isna().sum() == (raw["signature_id"] == "bad").sum()
    assert got["single_alert_noise_profile"].isna().sum() == raw["single_alert_noise_profile"].isna().sum() > 0
    assert got["alert_summary_bug_number"].dropna().astype(int).tolist() == raw["alert_summary_bug_number"].dropna().astype(int).tolist()


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_raw_data(spark, str(tmp_path))
    pd.DataFrame({"alert_summary_id": [1], "alert_summary_bug_number": [None]}).to_csv(tmp_path / "alerts_data.csv", index=False)
    alerts, bugs = files.load_raw_data(spark, str(tmp_path))
    assert bugs is None and alerts.count() == 1


def test_series_files(spark, root):
    listed = series.series_files(spark, root)
    assert {tuple(r) for r in listed.collect()} == {("autoland1", i) for i in (1, 2, 3)} | {("central", i) for i in (3, 4, 5)}
    points = series.scan_series(spark, f"{root}/timeseries-data")
    assert points.count() == 600
    clean = series.clean_points(points, need_push=True)
    assert clean.count() == 594 and dict(clean.dtypes)["push_id"] == "double"
    report = {r["item"]: r["n"] for r in series.catalog_report(listed).collect()}
    assert report == {"folder:autoland1": 3, "folder:central": 3, "unique_signatures": 5, "signatures_in_several_folders": 1}


def test_cache_key_follows_parameters_and_input(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(3).write.parquet(str(source))
    calls = []

    def read(**extra):
        parameters = {"version": files.input_version(spark, str(source)), **extra}

        def build():
            calls.append(parameters)
            return spark.read.parquet(str(source))

        return files.cached(spark, str(tmp_path / "cache"), "t", parameters, build).count()

    assert [read(), read(), read(k=1)] == [3, 3, 3] and len(calls) == 2
    spark.range(5).write.mode("append").parquet(str(source))
    assert read() == 8 and len(calls) == 3


def test_work_folder_is_the_shared_one(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert work_folder(spark, "x") != work_folder(spark, "x")


def test_spread_leaves_wide_scans_alone(spark):
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 6)
    assert spread(wide) is wide


def test_run_from_files(spark, root, tmp_path, monkeypatch):
    quick = {**C.SERIES_MODEL, "iterations": 3, "min_rows_in_leaf": 2}
    monkeypatch.setattr(C, "SERIES_MODEL", quick)
    monkeypatch.setattr(variants, "build_session", lambda: spark)
    variants.main(["series", root, str(tmp_path)])
    metrics = {(r["metric"], r["k"]): r["value"] for r in spark.read.parquet(f"{tmp_path}/metrics").collect()}
    assert metrics["average_precision", None] > 0.3
    assert set(metrics) == {("average_precision", None), ("roc_auc", None)} | {(m, k) for m in ("precision", "recall") for k in (50, 100, 200)}
    report = spark.read.option("header", "true").csv(f"{tmp_path}/fi")
    assert report.columns == ["feature", "importance"] and 0 < report.count() <= 20
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 24
    assert spark.read.parquet(f"{tmp_path}/sensitivity").select(F.col("slope")).count() == 1


def test_hybrid_run_from_files(spark, root, tmp_path, monkeypatch):
    words = ["line", "one", "two", "bug", '"two",', "12345"]
    rng = np.random.default_rng(3)
    vectors = [(w, [float(v) for v in rng.normal(size=20)]) for w in words]
    spark.createDataFrame(vectors, "word string, vector array<float>").write.mode("overwrite").parquet(f"{root}/word_vectors.parquet")
    monkeypatch.setattr(C, "HYBRID_MODEL", {**C.HYBRID_MODEL, "iterations": 2, "min_rows_in_leaf": 2})
    monkeypatch.setattr(variants, "build_session", lambda: spark)
    variants.main(["hybrid", root, str(tmp_path)])
    names = {r["feature"] for r in spark.read.option("header", "true").csv(f"{tmp_path}/fi").collect()}
    assert {C.HYBRID_SERIES_ROW, C.HYBRID_NOTES_ROW} <= names
    assert not any(n.startswith(("ts_", "pca_")) for n in names)


def test_text_run_from_files(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(variants, "build_session", lambda: spark)
    variants.main(["text", root, str(tmp_path)])
    table = spark.read.parquet(f"{tmp_path}/text")
    assert {r["split"]: r["count"] for r in table.groupBy("split").count().collect()} == {"train": 84, "val": 12, "test": 24}
    row = table.where("alert_summary_id = 5").first()
    assert row["notes_sanitized"] == 'line one\nline "two",  BUG_ID' and row["all_text"].endswith(row["notes_sanitized"])
    assert " | alert_summary_repository=autoland | alert_summary_framework=talos | " in row["fused_text_sanitized"]
    assert table.where("notes_sanitized = 'NO_NOTES'").count() == 96


def test_series_columns_are_found_by_each_file_s_header(spark, tmp_path):
    folder = tmp_path / "data" / "autoland1"
    folder.mkdir(parents=True)
    texts = {1: "push_id,revision,value\n7,ab,1.5\n", 2: "value,push_id,revision\n2.5,8,cd\n", 3: "x,push_id,value\nq,9,3.5\n", 4: "push_id,revision\n1,ef\n"}
    for i, text in texts.items():
        (folder / f"{i}_timeseries_data.csv").write_text(text)
    points = series.clean_points(series.scan_series(spark, str(tmp_path / "data")))
    assert sorted((r["signature_id"], r["push_id"], r["revision"], r["value"]) for r in points.collect()) == [(1, 7.0, "ab", 1.5), (2, 8.0, "cd", 2.5), (3, 9.0, None, 3.5)]


def test_many_headers_take_two_passes(spark, tmp_path):
    """150 files, each with its columns at other places and of another width."""
    folder = tmp_path / "data" / "autoland1"
    folder.mkdir(parents=True)
    rng = np.random.default_rng(4)
    expected = []
    for i in range(1, 151):
        names = [f"x{k}" for k in range(i % 40)] + ["push_id", "value", *(["revision"] if i % 3 else []), *(["seq"] if i % 5 == 0 else [])]
        names = [names[k] for k in rng.permutation(len(names))]
        for name in [n for n in names if n == "x3"]:
            names[names.index(name)] = '"x, 3"'
        lines = [",".join(names)]
        for point in range(3):
            values = {"push_id": str(10 * i + point), "value": f"{i}.{point}5", "revision": f"r{i}", "seq": str(9 - point)}
            lines.append(",".join(values.get(n, '"a,b"') for n in names))
            expected.append((i, 10.0 * i + point, float(f"{i}.{point}5"), f"r{i}" if i % 3 else None))
        (folder / f"{i}_timeseries_data.csv").write_text("\n".join(lines) + "\n")
    scanned = series.scan_series(spark, str(tmp_path / "data"))
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2, "the points and their files' places, however many headers"
    rows = series.clean_points(scanned).orderBy("signature_id", "seq").collect()
    assert sorted((r["signature_id"], r["push_id"], r["value"], r["revision"]) for r in rows) == sorted(expected, key=lambda e: e[:2])
    assert [r["seq"] for r in rows if r["signature_id"] == 5] == [7, 8, 9]
    assert [r["push_id"] for r in rows if r["signature_id"] == 7] == [70.0, 71.0, 72.0]


def test_a_file_without_a_value_column_has_no_points(spark, tmp_path):
    folder = tmp_path / "data" / "f"
    folder.mkdir(parents=True)
    (folder / "1_timeseries_data.csv").write_text("push_id,revision,value\n7,ab,1.5\n")
    (folder / "2_timeseries_data.csv").write_text("amount,other,third\n7,ab,9.5\n")
    (folder / "3_timeseries_data.csv").write_text("")
    assert [r["value"] for r in series.scan_series(spark, str(tmp_path / "data")).collect()] == ["1.5"]


def test_no_series_files_at_all(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("nothing here")
    assert series.scan_series(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def alert_parts(root, tmp_path_factory):
    """The alert table cut into three files of falling size, in several forms."""
    raw = pd.read_csv(f"{root}/deep/alerts_data.csv", dtype=str, keep_default_na=False)
    cuts = [0, 20, 90, len(raw)]
    return raw, [raw.iloc[a:b] for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("form", ["folder", "csv_folder", "numbered", "parquet_folder", "parquet_file"])
def test_alerts_in_many_files_keep_their_order(spark, alert_parts, tmp_path, form):
    raw, parts = alert_parts
    place = tmp_path / "in" / {"folder": "alerts_data", "csv_folder": "alerts_data.csv", "parquet_folder": "alerts_data"}.get(form, "")
    place.mkdir(parents=True, exist_ok=True)
    if form == "parquet_file":
        raw.to_parquet(place / "alerts_data.parquet")
    for i, part in enumerate(parts if form != "parquet_file" else []):
        if form == "parquet_folder":
            part.to_parquet(place / f"part-{i}.parquet")
        else:
            part.to_csv(place / (f"alerts_data-{i}.csv" if form == "numbered" else f"part-{i}.csv"), index=False)
    alerts, bugs = files.load_raw_data(spark, str(tmp_path / "in"))
    got = alerts.orderBy("seq").toPandas()
    assert bugs is None and got["seq"].is_unique
    assert got["alert_summary_id"].astype(str).tolist() == raw["alert_summary_id"].tolist()
    assert got["single_alert_amount_abs"].tolist() == raw["single_alert_amount_abs"].astype(float).tolist()
    assert 'line one\nline "two", bug 12345' in set(got["alert_summary_notes"]) and "" not in set(got["alert_summary_notes"])


def test_files_of_one_table_must_have_one_header(spark, tmp_path):
    (tmp_path / "alerts_data").mkdir()
    (tmp_path / "alerts_data" / "a.csv").write_text("alert_summary_id,signature_id\n1,2\n")
    (tmp_path / "alerts_data" / "b.csv").write_text("signature_id,alert_summary_id\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.load_raw_data(spark, str(tmp_path))[0].collect()
