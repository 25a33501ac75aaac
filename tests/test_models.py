"""Classifiers: invariants and bounds, with small ensembles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rentlens import Workspace
from rentlens.functions import labels
from rentlens.plans import models
from rentlens.sources import from_star


@pytest.fixture(scope="module")
def ws(spark):
    workspace = Workspace(spark, from_star(spark, "/root/testdata/sf0.001"))
    models.train(workspace, models.Settings(trees=10, rounds=5))
    return workspace


def test_split_and_folds_keep_class_shares(ws):
    rows = models.training_rows(ws).groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("held"),
        *[F.count(F.when(F.col("fold") == k, 1)).alias(f"f{k}") for k in range(5)],
    ).collect()
    assert sum(r["n"] for r in rows) == 150 and sum(r["held"] for r in rows) == 38
    for r in rows:
        assert abs(r["held"] - r["n"] / 4) < 1
        assert max(r[f"f{k}"] for k in range(5)) - min(r[f"f{k}"] for k in range(5)) <= 1


def test_sizes_are_shared_out_exactly():
    assert models._test_sizes({0: 825, 1: 675}) == {0: 206, 1: 169}
    assert sum(models._test_sizes({0: 7, 1: 6}).values()) == 4


def test_metrics(ws):
    rows = {r["model"]: r for r in models.model_metrics(ws).collect()}
    assert set(rows) == set(labels.FEATURE_SETS)
    for r in rows.values():
        assert (r["train_size"], r["test_size"]) == (112, 38)
        assert 0.5 <= r["roc_auc"] <= 1 and 0.5 <= r["cv_auc_mean"] <= 1
    assert models.best_model(ws).first()["model"] in rows


def test_confusion_and_report_agree(ws):
    cells = models.confusion_matrix(ws).collect()
    report = models.classification_report(ws).collect()
    metrics = {r["model"]: r for r in models.model_metrics(ws).collect()}
    for model in labels.FEATURE_SETS:
        mine = [c for c in cells if c["model"] == model]
        assert sum(c["predicted_low"] + c["predicted_high"] for c in mine) == 38
        entries = {r["entry"]: r for r in report if r["model"] == model}
        assert entries["1"]["f1"] == pytest.approx(metrics[model]["f1"], abs=1e-4)
        assert entries["accuracy"]["f1"] == pytest.approx(metrics[model]["accuracy"], abs=1e-4)
        assert entries["0"]["support"] + entries["1"]["support"] == 38


def test_contributions_add_up(ws):
    sums = models.risk_contributions(ws).groupBy("customer_id", "model").agg(
        F.sum("contribution").alias("s"), F.count("*").alias("n")
    ).collect()
    assert len(sums) == 150 * 3
    assert all(abs(r["s"] - 100) <= 0.5 for r in sums)
    assert {r["model"]: r["n"] for r in sums} == {m: len(f) for m, f in labels.FEATURE_SETS.items()}


def test_scores_and_actions(ws):
    rows = models.risk_scores(ws).collect()
    assert len(rows) == 450
    assert all(r["predicted_risk"] == (r["probability"] >= 0.5) for r in rows if r["probability"] != 0.5)
    cards = models.risk_actions(ws).collect()
    assert len(cards) == 450 and all(r["body"] for r in cards)


def test_missing_inputs_count_as_zero(ws, spark):
    sparse = spark.createDataFrame([(1, 10)], "customer_id long, total_rentals int")
    full = spark.createDataFrame(
        [(1, 10, 0.0, 0)], "customer_id long, total_rentals int, total_spending double, days_since_last_rental int"
    )
    assert models.score(ws, sparse).collect() == models.score(ws, full).collect()


def test_importances(ws):
    rows = models.feature_importance(ws).collect()
    assert len(rows) == 18 and all(r["importance"] >= 0 for r in rows)


def test_only_the_scores_of_the_folds_take_fits_on_folds(spark, monkeypatch):
    workspace = Workspace(spark, from_star(spark, "/root/testdata/sf0.001"))
    workspace.memo["model_settings"] = models.Settings(trees=2, rounds=1)
    fitted = []
    ensemble, logistic = models._fit_ensemble, models.fit_logistic

    def fit_ensemble(name, rows, settings):
        fitted.append(name)
        return ensemble(name, rows, settings)

    def fit_logistic(rows, features, parts, strength):
        fitted.extend([models.DEFAULT_MODEL] * len(parts))
        return logistic(rows, features, parts, strength)

    monkeypatch.setattr(models, "_fit_ensemble", fit_ensemble)
    monkeypatch.setattr(models, "fit_logistic", fit_logistic)
    for plan in (models.confusion_matrix, models.classification_report, models.feature_importance, models.risk_scores, models.risk_contributions):
        assert plan(workspace).count()
    assert sorted(fitted) == sorted(models.CLASSIFIERS)
    rows = models.model_metrics(workspace).collect()
    assert sorted(fitted) == sorted(models.CLASSIFIERS * (1 + models.FOLDS))
    assert all((r["train_size"], r["test_size"]) == (112, 38) and r["cv_auc_mean"] for r in rows)
