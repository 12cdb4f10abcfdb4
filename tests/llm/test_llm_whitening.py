"""Whitening against numpy on given vectors, odd rows and matrices with clustered eigenvalues."""

from __future__ import annotations

import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rows import SF  # noqa: E402

from perfsieve.llm import whitening  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, n long, k string, v string, component int"


def plain(rows, components=whitening.COMPONENTS):
    """{(id, place among equal ids): ...} by the contract's words, with numpy's own solver."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(d, np.longdouble) / n
    spread = (centred.T @ centred / n).astype(np.float64)
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1], vectors[:, ::-1]
    take = np.flatnonzero(values > 1e-12 * values.max())[:components]
    white = centred.astype(np.float64) @ (vectors[:, take] / np.sqrt(values[take]))
    return [i for i, _ in kept], n, [sum(c * c for c in row) for row in d], white, values[take] / np.trace(spread)


def compare(spark, rows, found, components=whitening.COMPONENTS):
    ids, n, deviations, white, explained = plain(rows, components)
    got = found.collect()
    assert len(got) == white.size
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        by.setdefault(r["component"], []).append((str(r["vec_id"]), int(r["deviation"]), r["whitened"]))
    for c, mine in by.items():
        theirs = [(str(i), e, w) for i, e, w in zip(ids, deviations, white[:, c - 1].tolist(), strict=True)]
        best = min(_gap(mine, theirs, sign) for sign in (1.0, -1.0))
        assert best < 1e-8, c


def _gap(mine, theirs, sign):
    flipped = sorted((i, e, w * sign) for i, e, w in theirs)
    pairs = list(zip(sorted(mine), flipped, strict=True))
    assert all(a[:2] == b[:2] for a, b in pairs)
    return max(abs(a[2] - b[2]) for a, b in pairs)


def test_query_equals_numpy(spark):
    found = whitening.op11_whitening(spark, SF)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["component"] == "int"
    compare(spark, rows, found)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 7, 5, 3, 1]]) for i in range(40)]
    rows += [rows[3]] * 60  # one very common vector
    rows += [(None, rows[5][1]), (70, None), (71, []), (72, [1.0, None, 2.0, 3.0, 4.0]), (73, [math.nan] * 5), (74, [math.inf, 1.0, 1.0, 1.0, 1.0])]
    rows += [(75, [1.0, 2.0]), (76, [-0.0] * 5), (77, [1e9, -1e9, 1e9, 0.5, 0.25])]
    df = spark.createDataFrame([(i, v, 1, "k", "v", 2) for i, v in rows], SCHEMA).repartition(4)
    compare(spark, rows, whitening.whiten(df))


def test_directions_without_spread_have_no_component(spark):
    rows = [(i, [float(i), float(i), 2.0, float(i % 3)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(df).collect()
    assert {r["component"] for r in found} == {1, 2} and len(found) == 60
    assert sum(r["explained"] for r in found if r["vec_id"] == 4) == pytest.approx(1.0)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0


def test_tables_without_a_usable_vector(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [math.nan])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_entries_too_large_for_whole_numbers_raise(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2.45 or more"):
        whitening.whiten(df).count()


def test_deviations_beyond_64_bits_stay_exact(spark):
    rows = [(i, [float((-1) ** i * (i + 1) * 1e11), float(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(spark, rows, whitening.whiten(df))


VALUES = {
    "apart": np.linspace(1, 64, 64),
    "near": np.r_[5 + 1e-9 * np.arange(20), np.linspace(0.1, 1, 44)],
    "nearer": np.r_[5 + 1e-13 * np.arange(20), np.linspace(0.1, 1, 44)],
    "equal": np.ones(40),
    "low rank": np.r_[np.ones(3), np.zeros(30)],
    "two clusters": np.r_[1e6, np.ones(20), np.full(20, 1e-5)],
    "wide range": np.geomspace(1, 1e-14, 50),
    "one": np.ones(1),
}


@pytest.mark.parametrize("name", VALUES)
def test_refined_vectors_are_right_to_double_precision(name):
    rng = np.random.default_rng(5)
    wanted = VALUES[name]
    turn, _ = np.linalg.qr(rng.normal(size=(len(wanted), len(wanted))))
    matrix = (turn * wanted) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.refined_eigenvectors(matrix)
    assert np.abs(matrix @ vectors - vectors * values).max() < 4e-15 * np.abs(wanted).max()
    assert np.abs(vectors.T @ vectors - np.eye(len(wanted))).max() < 4e-15
    assert (np.diff(values) <= 1e-15 * np.abs(wanted).max()).all()
    _, single = np.linalg.eigh(matrix.astype(np.float32))
    if name == "apart":  # single precision alone is not enough
        assert np.abs(single.T.astype(float) @ single.astype(float) - np.eye(64)).max() > 1e-8


def test_sums_are_exact_where_doubles_are_not(spark):
    rows = [(i, [float(2**36 + i), 1.0 + i % 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    width, n, sums = whitening.column_sums(df, "embedding")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    assert (width, n, sums) == (2, 50, [sum(c) for c in zip(*x, strict=True)])
    scaled = whitening.covariance(df, "embedding", width, n, sums)
    for a in range(2):
        for b in range(2):
            assert scaled[a, b] == n * sum(r[a] * r[b] for r in x) - sums[a] * sums[b]
