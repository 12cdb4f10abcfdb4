"""Window features kept between runs: what is read again, and that the result is the same."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from perfsieve import constants as C
from perfsieve.operators import series, series_cache
from perfsieve.sources import series as source

NAMES = [f"ts_{m}_{s}" for _, _, s in C.WINDOW_SCALES for m in C.WINDOW_METRICS]


def write(place, signature: int, seed: int, n: int = 60) -> None:
    rng = np.random.default_rng(seed)
    push = [str(p) if p % 7 else "" for p in range(100, 100 + n)]
    pd.DataFrame({"push_id": push, "revision": "r", "value": rng.normal(9, 2, n).round(3)}).to_csv(place / f"{signature}_timeseries_data.csv", index=False)


@pytest.fixture
def root(tmp_path):
    place = tmp_path / "in" / "a [1]{x}"
    place.mkdir(parents=True)
    for signature in range(1, 6):
        write(place, signature, signature)
    return place


def pairs_of(spark, anchors):
    rows = [(i, signature, float(anchor) if anchor else None, "autoland", "talos") for i, (signature, anchor) in enumerate(anchors)]
    return spark.createDataFrame(
        rows, f"{C.SUMMARY_ID} long, {C.SIGNATURE_ID} long, anchor double, {C.REPOSITORY} string, {C.FRAMEWORK} string"
    )


@pytest.fixture
def run(spark, root, tmp_path, monkeypatch):
    """run(anchors) -> names of the series files read; the features are compared with uncached ones."""
    read = []
    whole = source.scan_series
    where = str(root.parent)

    def watched(spark_, paths, *rest):
        listed = paths if isinstance(paths, list) else ["everything"]
        read.extend(os.path.basename(p).split("_")[0] for p in listed)
        return whole(spark_, paths, *rest)

    def go(anchors):
        read.clear()
        pairs = pairs_of(spark, anchors)
        columns = [C.SUMMARY_ID, C.SIGNATURE_ID, "folder", "anchor", "idx", *NAMES]
        monkeypatch.setattr(source, "scan_series", watched)
        got = series_cache.window_features(spark, where, str(tmp_path / "cache"), pairs, file_order=True).select(*columns)
        got = got.orderBy(C.SUMMARY_ID).toPandas()
        monkeypatch.setattr(source, "scan_series", whole)
        points = source.clean_points(whole(spark, where))
        plain = series.window_features(pairs, points, source.series_files(spark, where), file_order=True).select(*columns)
        pd.testing.assert_frame_equal(got, plain.orderBy(C.SUMMARY_ID).toPandas(), check_dtype=False)
        return sorted(read)

    return go


ANCHORS = [(1, 130), (2, 130), (3, 140), (4, 5), (4, None), (5, 159), (5, 159), (9, 120)]


def test_only_changed_and_new_series_are_read(spark, run, root, tmp_path):
    assert run(ANCHORS) == ["1", "2", "3", "4", "5"]
    assert run(ANCHORS) == [], "nothing changed, a push before every point included"
    write(root, 3, 77, 70)
    assert run(ANCHORS) == ["3"]
    write(root, 9, 9)
    assert run(ANCHORS) == ["9"]
    assert run([*ANCHORS, (2, 131)]) == ["2"], "another push of an unchanged series"
    (root / "1_timeseries_data.csv").unlink()
    assert run(ANCHORS) == []
    before = spark.read.parquet(series_cache.cache_folder(str(tmp_path / "cache"), True)).count()
    series_cache.compact(spark, str(root.parent), str(tmp_path / "cache"), True)
    after = spark.read.parquet(series_cache.cache_folder(str(tmp_path / "cache"), True)).count()
    assert before - after == 2 and run(ANCHORS) == []


def test_many_changed_files_are_read_with_their_folder(run, tuned):
    tuned(namedFiles=2)
    assert run(ANCHORS) == ["everything"]


def test_no_pair_has_a_push(run):
    assert run([(1, None), (2, None)]) == []
