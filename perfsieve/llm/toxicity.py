"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The labels tell toxic from clean. Words and beginnings of words (so that inflected forms count
together) that are over-represented in the toxic documents of a bounded sample, stratified by label,
become the features. They are chosen by a false discovery rate, which scales with the number of toxic
documents and needs no least count. A toxic document above the median number of their occurrences
is graded 2, other toxic ones 1, clean ones 0. One weight vector serves both thresholds:
P(grade > k) = logistic(w.x - t_k). The expected severity is the sum of these probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfsieve.llm.common import as_bytes, fresh, table, tidy, words
from perfsieve.session import materialize

# Bounds of the fit: labelled documents, features.
SAMPLE = 20_000
FEATURES = 256
# Expected share of chance finds among the features.
FALSE_SHARE = 0.05
# Beginnings of words that may become features, in characters; whole words of any length may.
PREFIXES = range(3, 13)
# Features, or words with their features, that a worker holds at a time.
HELD = 100_000
GRADES = 3
PENALTY = 1.0
SEED = 11


@dataclass(frozen=True)
class OrdinalModel:
    """Weights per feature (of log(1 + count)) and ascending thresholds."""

    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def severity(self, text: bytes | None, memo: dict[bytes, list[bytes]] | None = None) -> tuple[float, float]:
        """(expected grade, probability of any grade above 0). ``memo`` keeps the features of words."""
        counts = feature_counts(text, self.weights, {} if memo is None else memo)
        score = sum(self.weights[w] * np.log1p(n) for w, n in sorted(counts.items()))
        above = [1 / (1 + np.exp(min(500.0, t - score))) for t in self.thresholds]
        return float(sum(above)), float(above[0])


def features_of(word: bytes) -> list[bytes]:
    """The word, marked by a space at its end, and its beginnings of 3 to 12 characters (the word itself too)."""
    ends = [i for i in range(1, len(word)) if word[i] & 0xC0 != 0x80][: PREFIXES.stop - 1] if len(word) > 1 else []
    ends.append(len(word))
    return [word + b" ", *[word[:i] for i in ends[PREFIXES.start - 1 : PREFIXES.stop - 1]]]


def feature_counts(text: bytes | None, known: dict[bytes, object], memo: dict[bytes, list[bytes]]) -> dict[bytes, int]:
    """How often each of the ``known`` features occurs in ``text``."""
    counts: dict[bytes, int] = {}
    for word in words(text):
        found = memo.get(word)
        if found is None:
            if len(memo) >= HELD:
                memo.clear()
            found = memo[word] = [f for f in features_of(word) if f in known]
        for f in found:
            counts[f] = counts.get(f, 0) + 1
    return counts


def evidence(a: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """n KL(a/n, share): exp(-evidence) bounds the chance of ``a`` or more toxic ones among n documents."""
    part = a / n
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(a > 0, a * np.log(part / share), 0.0)
        down = np.where(a < n, (n - a) * np.log((1 - part) / (1 - share)), 0.0)
    return np.where(part > share, up + down, 0.0)


def least_evidence(a: np.ndarray, b: np.ndarray, times: np.ndarray, toxic: int, clean: int) -> float:
    """The least evidence at which at most FALSE_SHARE of the finds are expected by chance; inf without any.

    ``times`` features each occur in ``a`` toxic and ``b`` clean documents. Features so rare that
    they could not reach the evidence even without a clean document do not count as tried.
    """
    share = toxic / (toxic + clean)
    n = a + b
    found, could = evidence(a, n, share), np.minimum(n, toxic) * -math.log(share)
    could_order, found_order = np.argsort(-could), np.argsort(-found, kind="stable")
    tried_upto, found_upto = np.cumsum(times[could_order]), np.cumsum(times[found_order])
    levels = np.unique(found[found >= -math.log(FALSE_SHARE)])
    tried = tried_upto[np.searchsorted(-could[could_order], -levels + 1e-9, "right") - 1]
    finds = found_upto[np.searchsorted(-found[found_order], -levels, "right") - 1]
    good = levels[tried * np.exp(-levels) <= FALSE_SHARE * finds]
    return float(good[0]) if len(good) else math.inf


def without_repeats(rows: list[tuple[bytes, int, int]]) -> list[bytes]:
    """Features in their order, of those in the same documents only the longest beginning of a word.

    A longer feature with the counts of a shorter one that it begins with is in the same documents.
    """
    alike: dict[tuple[int, int], set[bytes]] = {}
    for f, a, b in rows:
        alike.setdefault((a, b), set()).add(f)
    kept: set[bytes] = set()
    for same in alike.values():
        order = sorted(f for f in same if not (f.endswith(b" ") and f[:-1] in same))
        kept.update(f for f, after in zip(order, [*order[1:], b""], strict=True) if not after.startswith(f))
    return [f for f, _, _ in rows if f in kept]


def fit_ordinal(
    x: np.ndarray, grade: np.ndarray, n_grades: int, penalty: float = PENALTY, turns: int = 60, weight: np.ndarray | None = None
):
    """(weights, thresholds) of the proportional-odds model with a ridge penalty, by Fisher scoring.

    ``weight`` says how many rows each row stands for. With F the logistic function, P(grade <= k) = F(t_k - x.w). Grades that never occur have no
    threshold information; the small ridge on the thresholds keeps those finite.
    """
    n, d = x.shape
    cuts = n_grades - 1
    weight = np.ones(n) if weight is None else weight
    share = np.clip(np.cumsum(np.bincount(grade, weight, minlength=n_grades))[:-1] / max(1e-9, weight.sum()), 0.01, 0.99)
    t = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(cuts))
    w = np.zeros(d)
    ridge = np.concatenate([np.full(d, penalty), np.full(cuts, 1e-3)])

    def parts(w: np.ndarray, t: np.ndarray):
        low = 1 / (1 + np.exp(-np.clip(t[None, :] - (x @ w)[:, None], -500, 500)))
        low = np.concatenate([np.zeros((n, 1)), low, np.ones((n, 1))], axis=1)
        return low, np.maximum(np.diff(low, axis=1), 1e-12)

    def loss(w: np.ndarray, t: np.ndarray) -> float:
        if (np.diff(t) <= 0).any():
            return np.inf
        return -(weight * np.log(parts(w, t)[1][np.arange(n), grade])).sum() + 0.5 * (ridge * np.concatenate([w, t - t0]) ** 2).sum()

    t0 = t.copy()
    now = loss(w, t)
    for _ in range(turns):
        low, p = parts(w, t)
        slope = low * (1 - low)
        # Derivatives of each grade's probability by x.w and by each threshold.
        by_score = -(slope[:, 1:] - slope[:, :-1])
        by_cut = np.zeros((n, n_grades, cuts))
        for k in range(cuts):
            by_cut[:, k, k] = slope[:, k + 1]
            by_cut[:, k + 1, k] = -slope[:, k + 1]
        own = np.arange(n)
        gradient_score = weight * by_score[own, grade] / p[own, grade]
        gradient_cut = (by_cut[own, grade] * (weight / p[own, grade])[:, None]).sum(axis=0)
        gradient = np.concatenate([x.T @ gradient_score, gradient_cut]) - ridge * np.concatenate([w, t - t0])
        cross = np.einsum("n,ng,ngk->nk", weight, by_score / p, by_cut)
        information = np.zeros((d + cuts, d + cuts))
        information[:d, :d] = x.T @ (x * (weight * (by_score**2 / p).sum(axis=1))[:, None])
        information[:d, d:] = x.T @ cross
        information[d:, :d] = information[:d, d:].T
        information[d:, d:] = np.einsum("n,ngk,ngl->kl", weight, by_cut / p[:, :, None], by_cut)
        step = np.linalg.solve(information + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-6:
            new_w, new_t = w + size * step[:d], t + size * step[d:]
            new = loss(new_w, new_t)
            if new <= now:
                break
            size /= 2
        if size <= 1e-6 or now - new < 1e-9 * max(1.0, abs(now)):
            break
        w, t, now = new_w, new_t, new
    return w, t


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, clean documents), summed over the documents that fit in memory together."""
    schema = pa.schema([("feature", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
    held: dict[bytes, list[int]] = {}

    def rows() -> pa.RecordBatch:
        a, b = zip(*held.values(), strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
        held.clear()
        return out

    for batch in batches:
        for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for f in {f for word in set(words(text)) for f in features_of(word)}:
                held.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            if len(held) >= HELD:
                yield rows()
    if held:
        yield rows()


def _count_rows(vocabulary: list[bytes]):
    place = {w: i for i, w in enumerate(vocabulary)}
    schema = pa.schema(
        [("doc_id", pa.int64()), ("toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, list[bytes]] = {}
        for batch in batches:
            at, n = [], []
            for text in as_bytes(batch.column(2)):
                counts = sorted((place[f], c) for f, c in feature_counts(text, place, memo).items())
                at.append([i for i, _ in counts])
                n.append([c for _, c in counts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))],
                schema=schema,
            )

    return tidy(rows)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    features: int = FEATURES,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of their id.

    Toxic and clean labels get half the sample each, and what the other leaves; each row is weighted
    by the labels it stands for, so the probabilities are those of all labelled documents. Labels without an id or a value are left out; an id with several labels is toxic if any says so.
    An id that several documents share labels each of them (only the sample's own rows are read).
    Without a toxic or without a clean document in the sample the model grades everything 0.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull())
    named = named.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic"))
    labelled = dict(named.groupBy("toxic").count().collect())
    n_clean, n_toxic = labelled.get(0, 0), labelled.get(1, 0)
    most_toxic = min(n_toxic, max(sample // 2, sample - n_clean))
    # Two top-k of bounded size: this is what may be broadcast.
    order = [F.xxhash64("l_id", F.lit(SEED)), F.col("l_id")]
    chosen = named.where("toxic = 1").orderBy(*order).limit(most_toxic)
    chosen = chosen.unionAll(named.where("toxic = 0").orderBy(*order).limit(sample - most_toxic))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["l_id"]).select("doc_id", "toxic", "text")
    joined = joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    known = materialize(joined, "toxic-sample")
    halves = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = halves.get(0, 0), halves.get(1, 0)
    if not clean or not toxic:
        return OrdinalModel({}, (500.0, 501.0))
    by_feature = known.select("text", "toxic").mapInArrow(tidy(_feature_rows), "feature binary, a long, b long")
    by_feature = materialize(by_feature.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxic-features")
    base = toxic / (toxic + clean)
    # Rarer features cannot be told from chance at any level. There are far fewer pairs of counts than features.
    rarest = math.floor(math.log(FALSE_SHARE) / math.log(base))
    pairs = np.array(by_feature.where(F.col("a") + F.col("b") >= rarest).groupBy("a", "b").count().collect(), dtype=float).reshape(-1, 3)
    least = least_evidence(*pairs.T, toxic, clean)
    if least == math.inf:
        return OrdinalModel({}, (500.0, 501.0))
    n, part = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    up = F.col("a") * F.log(part / base)
    down = F.when(F.col("b") > 0, F.col("b") * F.log((1 - part) / (1 - base))).otherwise(0.0)
    told = by_feature.where((F.col("a") > 0) & (part > base) & (n >= rarest)).withColumn("told", up + down)
    telling = told.where(F.col("told") >= least - 1e-6).orderBy(F.desc(F.round("told", 6)), "feature").limit(16 * features)
    vocabulary = without_repeats([(bytes(r["feature"]), r["a"], r["b"]) for r in telling.collect()])[:features]
    counted = known.select("doc_id", "toxic", "text").mapInArrow(
        _count_rows(vocabulary), "doc_id long, toxic int, at array<int>, n array<int>"
    )
    # At most ``sample`` rows of at most ``features`` pairs.
    found = sorted(counted.collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(found), len(vocabulary)))
    for row, r in enumerate(found):
        x[row, r["at"]] = np.log1p(np.array(r["n"], float))
    hits = np.array([sum(r["n"]) for r in found])
    is_toxic = np.array([r["toxic"] == 1 for r in found])
    grade = np.where(is_toxic, np.where(hits > np.median(hits[is_toxic]), 2, 1), 0)
    stands_for = np.where(is_toxic, n_toxic / toxic, n_clean / clean)
    weights, thresholds = fit_ordinal(x, grade, GRADES, weight=stands_for / stands_for.min())
    return OrdinalModel(
        {w: round(float(v), 9) for w, v in zip(vocabulary, weights, strict=True)}, tuple(round(float(t), 9) for t in thresholds)
    )


SCORED = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("any", T.DoubleType())])
_ARROW = pa.struct([("severity", pa.float64()), ("any", pa.float64())])


def _scorer(shared):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[bytes, list[bytes]] = {}
        for texts in batches:
            found = [shared.value.severity(t, memo) for t in as_bytes(texts)]
            yield pa.array([{"severity": s, "any": p} for s, p in found], _ARROW)

    return tidy(score)


def with_severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", out: str = "scored") -> DataFrame:
    """``docs`` with a column ``out``: severity (expected grade) and any (probability above grade 0).

    Null and empty texts have the score of a text without features. Every row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = F.arrow_udf(_scorer(shared), SCORED, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return docs.withColumn(out, score(F.col(text_col)))


def grades(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, expected_severity, p_toxic, grade (nearest whole severity), toxic (p_toxic of 0.5 or more)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = with_severity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    severity, any_grade = F.round("scored.severity", 6), F.round("scored.any", 6)
    return scored.select(
        F.col("id").alias(id_col),
        severity.alias("expected_severity"),
        any_grade.alias("p_toxic"),
        F.round("scored.severity").cast("int").alias("grade"),
        (any_grade >= 0.5).alias("toxic"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose probability of any toxicity is below a half, unchanged."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    out = fresh(docs, "_scored")
    return with_severity(docs, model, text_col, out).where(F.round(F.col(out)["any"], 6) < 0.5).drop(out)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": _query}
CHECKS: dict[str, str] = {}
