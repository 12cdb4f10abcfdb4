"""Whitening of embeddings: float32 eigenvectors, refined in higher precision.

1. Every entry c becomes the whole number x = floor(64 c) + 1,000,000, so that sums and products are
   exact. One pass gives the width, the count n and the sums S; a second one the products of
   y = x - round(S / n), whole numbers centred before they are multiplied. Tasks hand on partial
   sums of the width's square; n^2 times the covariance follows from them without rounding.
2. The driver holds matrices of the vectors' width only. Eigenvectors of the covariance in float32
   are corrected by the matrix-multiplication iteration of Ogita and Aishima in extended precision:
   with R = I - X'X and S = X'AX the correction of a pair of columns is (S_ij + l_j R_ij) / (l_j - l_i).
   Columns whose eigenvalues lie closer than the iteration can tell apart form a cluster: there the
   correction only restores orthogonality, then the small problem X_J'(A - mean)X_J is solved and
   turns the cluster's columns, until the residual no longer falls.
3. Rows are projected in batches and written once; the identity error is measured on what was written.

Rows whose vector is null, or holds nulls or entries that are not finite, are left out; a vector
shorter than the longest one lacks entries, so it is left out too. Repeated rows and null ids count
as rows like any other. Components whose eigenvalue is zero up to rounding (constant or repeated
dimensions, fewer rows than dimensions) have no whitened value and are left out. A table without a
usable vector gives no rows. Extra columns are ignored. Entries beyond 2^45 raise an error: whole
numbers could not hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm.common import table, tidy
from perfsieve.session import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BATCH = 4096
# Sums of products of doubles are exact below 2^53.
EXACT = float(1 << 53)
ROUNDS = 30


def usable(column: pa.Array, width: int) -> np.ndarray:
    """Which vectors have ``width`` entries, all of them finite."""
    kept = np.zeros(len(column), bool)
    if not len(column):
        return kept
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return (lengths == width) & (lengths > 0) & (bad[ends] == bad[ends - lengths])


def whole_numbers(column: pa.Array, kept: np.ndarray, width: int) -> np.ndarray:
    """x of the kept vectors, one row each."""
    chosen = column.filter(pa.array(kept))
    values = chosen.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    if values.size and np.abs(values).max() >= float(1 << 45):
        raise ValueError("an embedding holds entries of 2^45 or more")
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"))


_PARTIAL = "i int, j int, total decimal(38,0)"
_PARTIAL_SCHEMA = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])


def _partial(i, j, totals) -> pa.RecordBatch:
    columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(t) for t in totals], pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTIAL_SCHEMA)


def column_sums(df: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """(width, n, S): the longest vector's length, and count and exact sums of the usable vectors."""
    rows = _vectors(df, vector)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if width <= 0:
        return 0, 0, []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            column = batch.column(0)
            x = whole_numbers(column, usable(column, width), width)
            n += len(x)
            for start in range(0, len(x), BATCH):
                sums = [a + int(b) for a, b in zip(sums, x[start : start + BATCH].sum(axis=0), strict=True)]
        if n:
            yield _partial(range(-1, width), [0] * (width + 1), [n, *sums])

    found = {r["i"]: int(r["total"]) for r in rows.mapInArrow(tidy(work), _PARTIAL).groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return width, found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _gram(y: np.ndarray) -> list[np.ndarray]:
    """Exact products y'y as integer matrices whose sum is meant."""
    top = float(np.abs(y).max()) if y.size else 0.0
    if top * top * len(y) < EXACT:
        wide = y.astype(np.float64)
        return [np.rint(wide.T @ wide).astype(np.int64)]
    wide = y.astype(object)
    return [wide.T @ wide]


def covariance(df: DataFrame, vector: str, width: int, n: int, sums: list[int]) -> np.ndarray:
    """n^2 times the covariance (divisor n) of the usable vectors, as exact Python integers."""
    center = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        small, room = np.zeros((width, width), np.int64), 1 << 62
        for batch in batches:
            column = batch.column(0)
            y = whole_numbers(column, usable(column, width), width) - center
            for start in range(0, len(y), BATCH):
                for part in _gram(y[start : start + BATCH]):
                    if part.dtype == object:
                        total += part
                        continue
                    room -= 1 << 53
                    if room < 0:
                        total, small, room = total + small, np.zeros_like(small), (1 << 62) - (1 << 53)
                    small += part
        total = total + small
        if total.any():
            yield _partial(upper[0], upper[1], total[upper])

    parts = _vectors(df, vector).mapInArrow(tidy(work), _PARTIAL)
    rows = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()  # the width's square at most
    products = np.zeros((width, width), object)
    for r in rows:
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["total"])
    rest = np.array([s - n * int(c) for s, c in zip(sums, center, strict=True)], object)
    return n * products - np.outer(rest, rest)


# --- eigenvectors -----------------------------------------------------------------------------
def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Index runs, by falling value, whose neighbours lie within ``gap``; only runs of two or more."""
    order = np.argsort(-values, kind="stable")
    breaks = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, breaks) if len(run) > 1]


def _orthogonal(vectors: np.ndarray) -> np.ndarray:
    """Newton steps towards the nearest orthogonal matrix."""
    for _ in range(3):
        vectors = vectors + vectors @ ((np.eye(vectors.shape[1], dtype=vectors.dtype) - vectors.T @ vectors) / 2)
    return vectors


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, object]:
    """One Ogita-Aishima step: (better vectors, eigenvalues, distance below which values count as one)."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    gap = 2 * (np.sqrt((off * off).sum()) + np.abs(a).sum(axis=1).max() * np.sqrt((r * r).sum()))
    apart = values[None, :] - values[:, None]
    clear = np.abs(apart) > gap
    np.fill_diagonal(clear, False)
    e = np.where(clear, (s + values[None, :] * r) / np.where(clear, apart, 1), r / 2)
    return x + x @ e, values, gap


def _turned(a: np.ndarray, x: np.ndarray, values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The columns of one cluster turned by the eigenvectors of their own shifted small problem."""
    part = _orthogonal(x[:, run])
    shifted = part.T @ (a @ part - values[run].mean() * part)
    scale = np.abs(shifted).max()
    if scale == 0:
        return part
    small = ((shifted + shifted.T) / (2 * scale)).astype(np.float64)
    _, turn = np.linalg.eigh(small)
    return part @ _orthogonal(turn[:, ::-1].astype(x.dtype))


def refined_eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    Starts from single precision; ``a`` is taken in extended precision. Ends when the residual
    |AX - XD| no longer falls.
    """
    a = a.astype(np.longdouble)
    top = np.abs(a).max()
    if not top:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / top
    _, start = np.linalg.eigh(a.astype(np.float32))
    x = start[:, ::-1].astype(np.longdouble)
    best, best_error = None, np.inf
    for _ in range(ROUNDS):
        x, values, gap = _corrected(a, x)
        for run in _clusters(values, gap):
            x[:, run] = _turned(a, x, values, run)
        x = _orthogonal(x)
        values = ((x * (a @ x)).sum(axis=0)) / (x * x).sum(axis=0)
        off = x.T @ a @ x
        error = float(np.abs(off - np.diag(np.diag(off))).max() + np.abs(x.T @ x - np.eye(len(a))).max())
        if error < best_error:
            best, stalled = (values.copy(), x.copy()), error > best_error / 2
            best_error = error
            if stalled or best_error < 4 * len(a) * float(np.finfo(np.longdouble).eps):
                break
        elif best_error < 1e-15 or error > 4 * best_error:
            break
    values, x = best
    order = np.argsort(-values, kind="stable")
    return (values[order] * top).astype(np.float64), x[:, order].astype(np.float64)


# --- whitening --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Whitening:
    """Fitted facts: what was counted and the components with an eigenvalue above rounding."""

    width: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Statistics over all usable vectors of ``df``; None when there is none."""
    width, n, sums = column_sums(df, vector)
    if not n:
        return None
    scaled = covariance(df, vector, width, n, sums)
    matrix = np.array([[np.longdouble(v) for v in row] for row in scaled.tolist()], np.longdouble).reshape(width, width) / (np.longdouble(n) * n)
    values, vectors = refined_eigenvectors(matrix)
    trace = float(np.trace(matrix))
    kept = np.flatnonzero(values > width * np.finfo(np.float64).eps * max(values.max(), 0.0))[:components]
    return Whitening(width, n, sums, values[kept], vectors[:, kept], values[kept] / trace if trace else values[kept])


_DECIMAL = pa.decimal128(38, 0)


def _deviations(d: np.ndarray, n: int) -> pa.Array:
    top = int(np.abs(d).max()) if d.size else 0
    if top * top * d.shape[1] < 1 << 63:
        return pa.array([int(v) for v in (d * d).sum(axis=1)], _DECIMAL)
    wide = d.astype(object)
    return pa.array([int(v) for v in (wide * wide).sum(axis=1)], _DECIMAL)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    if n * ((1 << 52) + SHIFT) < 1 << 62 or (x.size and n * int(np.abs(x).max()) < 1 << 62):
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def project(df: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation decimal(38,0), whitened array) of the usable rows of ``df``."""
    width, n, sums = fitted.width, fitted.n, fitted.sums
    loadings = fitted.vectors / np.sqrt(fitted.values)
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                kept = usable(batch.column(1), width)
                d = _differences(whole_numbers(batch.column(1), kept, width), n, sums)
                values = (d / n).astype(np.float64) @ loadings
                lists = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())
                columns = [batch.column(0).filter(pa.array(kept)), _deviations(d, n), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "deviation", "whitened"])

    found = rows.mapInArrow(tidy(work), f"k {kind}, deviation decimal(38,0), whitened array<double>")
    return found.withColumnRenamed("k", key)


_SUMS = "i int, values array<double>"


def identity_error(projected: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (divisor n) minus the identity."""
    if not components:
        return 0.0

    def partial(center: np.ndarray | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1, components) if center is None else (components, components))
            for batch in batches:
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                total += w.sum(axis=0, keepdims=True) if center is None else (w - center).T @ (w - center)
            lists = pa.array(total.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), lists], names=["i", "values"])

        return tidy(work)

    def summed(center: np.ndarray | None, height: int) -> np.ndarray:
        parts = projected.select("whitened").mapInArrow(partial(center), _SUMS).select("i", F.posexplode("values").alias("j", "v"))
        out = np.zeros((height, components))
        for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # components squared at most
            out[r["i"], r["j"]] = r["v"]
        return out / n

    spread = summed(summed(None, 1)[0], components)
    return float(np.abs(spread - np.eye(components)).max())


RESULT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component, as the module's text says."""
    spark = df.sparkSession
    fitted = fit(df, vector, components)
    kind = df.select(key).schema[0].dataType.simpleString()
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], f"`{key}` {kind}, {RESULT}")
    rows = materialize(project(df, fitted, key, vector), "whitened")
    error = identity_error(rows, fitted.n, len(fitted.values))
    shares = F.array(*[F.lit(float(v)) for v in fitted.explained])
    long = rows.select(key, "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    return long.select(
        key,
        (F.col("_place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    # A deviation beyond 64 bits raises here; the operator itself keeps all its digits.
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op11_whitening": op11_whitening}
CHECKS: dict[str, str] = {}
