"""Logistic regression from sums: every Newton step is one aggregation.

The loss is the weighted log-loss times a strength, plus half the squared coefficients
(not the intercept) of standardised features. Its minimum is unique, and gradient and
Hessian are plain sums over rows: a step takes one pass with map-side combining, which
brings a few numbers per fit to the driver, whatever the rows. Several fits over
overlapping parts of the same rows (hold-out, folds) share their passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STEPS = 100
#: A step this small against the coefficients ends a fit; Newton steps square the error.
CLOSE = 1e-10


@dataclass(frozen=True)
class Logistic:
    """A fitted regression; the first coefficient is the intercept."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]

    def scaled(self) -> list[Column]:
        parts = zip(self.features, self.means, self.scales, strict=True)
        return [(F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in parts]

    def probability(self) -> Column:
        margin = F.lit(self.coefficients[0])
        for b, z in zip(self.coefficients[1:], self.scaled(), strict=True):
            margin = margin + F.lit(b) * z
        return 1.0 / (1.0 + F.exp(-margin))


def _per_fit(values: Sequence[Sequence[float]], fit: Column) -> Column:
    rows = [F.array(*[F.lit(float(v)) for v in row]) for row in values]
    return F.element_at(F.array(*rows), fit + 1)


def _members(rows: DataFrame, features: Sequence[str], parts: list[Column], label: str) -> DataFrame:
    """y, x0, x1, ... and fit: a row for each fit that a row is part of."""
    fits = F.array(*[F.when(part, F.lit(k)) for k, part in enumerate(parts)])
    named = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    kept = rows.select(F.col(label).cast("double").alias("y"), *named, F.array_compact(fits).alias("fits"))
    return kept.select("y", *[f"x{i}" for i in range(len(features))], F.explode("fits").alias("fit"))


def _sums(members: DataFrame, models: dict[int, Logistic], weights: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """Per fit: loss, gradient and upper half of the Hessian of the weighted log-loss."""
    order = sorted(models)
    names = [f"x{i}" for i in range(len(models[order[0]].features))]
    place = F.lit(0)
    for k, fit in enumerate(order):
        place = F.when(F.col("fit") == fit, k).otherwise(place)
    held = members.where(F.col("fit").isin(order)).withColumn("place", place)
    at = F.col("place")
    held = held.select(
        "place", "y", *names,
        _per_fit([models[f].means for f in order], at).alias("m"),
        _per_fit([models[f].scales for f in order], at).alias("s"),
        _per_fit([models[f].coefficients for f in order], at).alias("b"),
        F.element_at(_per_fit([weights[f] for f in order], at), F.col("y").cast("int") + 1).alias("w"),
    )
    z = [F.lit(1.0), *[(F.col(x) - F.col("m")[i]) / F.col("s")[i] for i, x in enumerate(names)]]
    names = [f"z{i}" for i in range(len(z))]
    margin = sum((F.col("b")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    rows = held.select("place", "y", "w", "b", *[c.alias(n) for c, n in zip(z, names, strict=True)])
    rows = rows.select("place", "y", "w", *names, margin.alias("margin")).withColumn("p", 1.0 / (1.0 + F.exp(-F.col("margin"))))
    loss = F.log1p(F.exp(-F.abs(F.col("margin")))) + F.greatest(F.col("margin"), F.lit(0.0)) - F.col("y") * F.col("margin")
    slope, curve = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1.0 - F.col("p"))
    wanted = [F.col("w") * loss, *[slope * F.col(n) for n in names]]
    wanted += [curve * F.col(names[i]) * F.col(names[j]) for i in range(len(z)) for j in range(i, len(z))]
    found = rows.groupBy("place").agg(*[F.sum(c).alias(f"v{k}") for k, c in enumerate(wanted)]).collect()
    return {order[r["place"]]: np.array(r[1:]) for r in found}


def fit_logistic(rows: DataFrame, features: Sequence[str], parts: dict, strength: float, label: str = "label") -> dict:
    """A regression for each part of the rows, with equal total weight of both classes.

    ``parts`` maps a name to the condition of the rows it is fitted on. Features must
    not be null; a constant one counts as 0. Both classes must occur in each part.
    """
    names, width = list(parts), len(features)
    members = _members(rows, features, list(parts.values()), label)
    moments = members.groupBy("fit").agg(
        F.count("*").alias("n"), F.sum("y").alias("high"),
        F.array(*[F.avg(f"x{i}") for i in range(width)]).alias("means"), F.array(*[F.stddev_pop(f"x{i}") for i in range(width)]).alias("scales"),
    ).collect()
    models, weights = {}, {}
    for r in moments:
        if not 0 < r["high"] < r["n"]:
            raise ValueError(f"{names[r['fit']]}: both classes are needed")
        scales = tuple(s or 1.0 for s in r["scales"])
        models[r["fit"]] = Logistic(tuple(features), tuple(r["means"]), scales, (0.0,) * (width + 1))
        weights[r["fit"]] = (r["n"] / (2.0 * (r["n"] - r["high"])), r["n"] / (2.0 * r["high"]))
    if len(models) < len(names):
        raise ValueError("a part without rows cannot be fitted")
    done: dict[int, Logistic] = {}
    best: dict[int, float] = {}
    steps: dict[int, np.ndarray] = {}
    penalty = np.diag([0.0] + [1.0] * width)
    upper = np.triu_indices(width + 1)

    def moved(fit: int, by: np.ndarray) -> None:
        old = models[fit]
        models[fit] = Logistic(old.features, old.means, old.scales, tuple((np.array(old.coefficients) + by).tolist()))

    for _ in range(MOST_STEPS):
        for fit, values in _sums(members, models, weights).items():
            b = np.array(models[fit].coefficients)
            loss = strength * values[0] + b[1:] @ b[1:] / 2
            if fit in best and loss > best[fit] * (1 + 1e-12):
                steps[fit] = steps[fit] / 2  # too far: halfway back
                moved(fit, -steps[fit])
                continue
            hessian = np.zeros((width + 1, width + 1))
            hessian[upper] = strength * values[width + 2 :]
            hessian = hessian + np.triu(hessian, 1).T + penalty
            best[fit] = loss
            steps[fit] = -np.linalg.solve(hessian, strength * values[1 : width + 2] + penalty @ b)
            moved(fit, steps[fit])
            if np.abs(steps[fit]).max() <= CLOSE * (1 + np.abs(b).max()):
                done[fit] = models.pop(fit)
        if not models:
            return {name: done[k] for k, name in enumerate(names)}
    raise ArithmeticError("the regression does not settle")
