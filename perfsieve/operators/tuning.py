"""Search over the settings of the boosted trees by mean average precision over prepared folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsieve import constants as C
from perfsieve.operators import embed, evaluate, model
from perfsieve.operators.boosting import PATIENCE
from perfsieve.session import materialize


@dataclass(frozen=True)
class Trial:
    """One point of the grid: what was changed, and the average precision and kept rounds by fold."""

    changed: dict
    scores: list[float]
    rounds: list[int]

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores)


def grid(choices: dict[str, list]) -> list[dict]:
    """Every combination of the choices."""
    points: list[dict] = [{}]
    for name, values in choices.items():
        points = [{**p, name: v} for p in points for v in values]
    return points


def in_fold(table: DataFrame, fold: str, number: int) -> DataFrame:
    """``table`` with the fold's rows as validation rows."""
    return table.withColumn("is_val", F.col(fold) == number)


def search(
    table: DataFrame,
    features: list[str],
    settings: dict,
    points: list[dict],
    fold: str = "fold",
    n_folds: int = C.N_FOLDS,
    label: str = C.LABEL,
    embedding: str | None = None,
    patience: int = PATIENCE,
) -> list[Trial]:
    """Trials of all ``points``, best first; ties keep the grid's order.

    A point changes some of ``settings``, and may set ``components``, the number of principal components
    of the array column ``embedding``. In each fold the encodings of the text columns and the components
    are fit on the other folds' rows (components once for the largest number wanted: the first ones
    are the same), the fold's rows end the boosting and are then scored. Every feature takes part,
    whatever its number of values. ``table`` must hold only rows that a search may see.
    """
    found: list[tuple[list[float], list[int]]] = [([], []) for _ in points]
    most = max((p.get("components", 0) for p in points), default=0)
    for number in range(n_folds):
        rows = in_fold(table, fold, number)
        if embedding and most:
            components = embed.fit_components(rows.where(~F.col("is_val")), embedding, most)
            rows = materialize(embed.add_components(rows, components, embedding, most).drop(embedding), "fold-components")
        prepared: dict[tuple, model.Prepared] = {}
        for point, (scores, rounds) in zip(points, found, strict=True):
            wanted = {**settings, **{k: v for k, v in point.items() if k != "components"}}
            names = [*features, *[f"pca_{i}" for i in range(point.get("components", 0))]]
            key = (wanted["max_bins"], len(names))
            if key not in prepared:
                prepared[key] = model.prepare(rows, names, wanted["max_bins"], label)
            fitted, _ = model.boost(prepared[key], wanted, label, patience)
            trees = fitted.stages[-1]
            held = prepared[key].rows.where("is_val").select(label, "features")
            judged = trees.transform(held).select(label, model.positive_score().alias("score"))
            scores.append(float(evaluate.average_precision(judged, label).first()["average_precision"]))
            rounds.append(trees.getNumTrees)
    trials = [Trial(p, s, r) for p, (s, r) in zip(points, found, strict=True)]
    return sorted(trials, key=lambda t: -t.mean)
