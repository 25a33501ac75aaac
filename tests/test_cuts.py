"""Cut points that differ with every evaluation, as merged sketches may, change no result."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.operators.quantiles import exact_quantiles
from rentlens.operators.ranksum import roc_areas


@pytest.fixture
def unsteady(monkeypatch):
    exact = F.percentile_approx

    def shaken(*args):
        move = F.udf(lambda cuts: sorted(c + random.randrange(-90, 90) for c in cuts), "array<double>")
        return move(exact(*args))

    monkeypatch.setattr(F, "percentile_approx", shaken)


def test_quantiles_with_unsteady_cuts(spark, unsteady):
    values = [float(v) for v in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    wanted = [0.1, 0.25, 0.5, 0.55, 0.75, 0.9]
    for _ in range(3):
        got = exact_quantiles(df, {"a": wanted}, width=6)
        for p in wanted:
            assert got[("a", p)] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_roc_areas_with_unsteady_cuts(spark, unsteady):
    rng = random.Random(3)
    rows = [(float(s), rng.randrange(2)) for s in range(500)]
    high, low = ([s for s, y in rows if y == k] for k in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low))
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, s double, label int")
    for _ in range(3):
        assert roc_areas(df, ["g"], "s", "label", slices=20).first()["auc"] == pytest.approx(area, rel=1e-12)
