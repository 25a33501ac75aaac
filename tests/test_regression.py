"""Regression by sums and exact ROC areas against other ways to the same numbers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from rentlens import Workspace
from rentlens.operators.logistic import fit_logistic
from rentlens.operators.ranksum import roc_areas
from rentlens.plans import models, profiles
from rentlens.sources import from_star


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(4)
    x = random.standard_normal((900, 2)) * [3, 200] + [1, 5000]
    y = (x[:, 0] + x[:, 1] / 100 - 50 + random.standard_normal(900) * 2 > 2).astype(int)
    data = [(k, float(a), float(b), 7.0, int(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, label int").repartition(5)


def plain_gradient(rows, model, strength):
    """Slope of the penalised loss at the fit, which is zero at the optimum."""
    data = np.array([[r.a, r.b, r.c] for r in rows])
    y = np.array([r.label for r in rows])
    z = np.c_[np.ones(len(y)), (data - model.means) / model.scales]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b = np.array(model.coefficients)
    p = 1 / (1 + np.exp(-z @ b))
    return strength * z.T @ (w * (p - y)) + np.r_[0, b[1:]]


def test_each_part_is_at_its_optimum(rows):
    parts = {"most": F.col("id") % 4 != 0, "few": F.col("id") < 60, "all": F.lit(True)}
    found = fit_logistic(rows, ["a", "b", "c"], parts, 0.5)
    for name, part in parts.items():
        own = rows.where(part).collect()
        assert np.abs(plain_gradient(own, found[name], 0.5)).max() < 1e-7 * len(own)
    assert found["all"].coefficients[3] == 0 and found["all"].scales[2] == 1.0
    p = rows.select(found["all"].probability().alias("p"), "label").collect()
    assert sum((r.p >= 0.5) == (r.label == 1) for r in p) > 700


def test_separable_rows_settle_and_one_class_is_refused(spark):
    rows = spark.createDataFrame([(float(k), int(k > 4)) for k in range(10)], "a double, label int")
    model = fit_logistic(rows, ["a"], {0: F.lit(True)}, 50.0)[0]
    assert 1 < model.coefficients[1] < 100
    for part in (F.col("label") == 1, F.lit(False)):
        with pytest.raises(ValueError):
            fit_logistic(rows, ["a"], {0: part}, 0.5)


@pytest.mark.parametrize("places", [0, 1, 6])
def test_areas_equal_the_evaluator(spark, places):
    """Rounded scores are tied, whole numbers most of all."""
    random = np.random.default_rng(places)
    data = [(int(k % 3), float(round(s, places)) + 0.0, int(s + random.standard_normal() > 0)) for k, s in enumerate(random.standard_normal(1500))]
    rows = spark.createDataFrame(data, "g int, s double, label int").repartition(4)
    found = {r.g: r for r in roc_areas(rows, ["g"], "s", "label", slices=7).collect()}
    judge = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="label", numBins=0)
    for g, r in found.items():
        own = rows.where(F.col("g") == g)
        assert r.auc == pytest.approx(judge.evaluate(own), abs=1e-12)
        assert (r.positives, r.negatives) == (own.where("label = 1").count(), own.where("label = 0").count())


def test_areas_of_one_class_or_no_rows(spark):
    rows = spark.createDataFrame([("x", 0.5, 1), ("x", None, 0), ("y", 0.1, 0), ("y", 0.1, 1)], "g string, s double, label int")
    found = {r.g: r.auc for r in roc_areas(rows, ["g"], "s", "label").collect()}
    assert found == {"x": None, "y": 0.5}
    assert roc_areas(rows.limit(0), ["g"], "s", "label").count() == 0


def test_area_plan_has_no_global_window(spark):
    rows = spark.createDataFrame([("x", 0.5, 1)], "g string, s double, label int")
    plan = roc_areas(rows, ["g"], "s", "label")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_settings_are_honoured_and_noise_is_one_setting(spark):
    relations = from_star(spark, "/root/testdata/sf0.001")
    ws = Workspace(spark, relations)
    name = models.DEFAULT_MODEL
    first = models.train(ws, models.Settings(trees=3, rounds=2), [name])[name]
    assert models.train(ws, None, [name])[name] is first
    assert models.train(ws, models.Settings(trees=4, rounds=2), [name])[name] is not first
    assert set(first.fits) == {models.HOLD_OUT, *range(models.FOLDS)}
    high = lambda w: {r.customer_id for r in profiles.profiles(w).where("is_high_risk").collect()}
    labelled = {r.customer_id for r in models.training_rows(ws).where("label = 1").collect()}
    assert labelled == high(ws)
    plain = Workspace(spark, relations, noise="none")
    assert {r.customer_id for r in models.training_rows(plain).where("label = 1").collect()} == high(plain)
