"""Late-return classifiers: training, evaluation, batch scoring.

The label is a function of the model's own inputs plus noise, so the metrics
describe how well a model recovers a rule; they say nothing about foresight.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.functions.scalar import rint_to
from rentlens.operators.logistic import Logistic, fit_logistic
from rentlens.operators.ranking import sliced_row_number
from rentlens.operators.ranksum import roc_areas
from rentlens.plans.actions import filled
from rentlens.plans.profiles import profiles
from rentlens.session import shared_dir

ALL_FEATURES = list(labels.FEATURE_LABELS)
TEST_SHARE, FOLDS = 0.25, 5
SPLIT_SEED, FOLD_SEED, MODEL_SEED = 7, 42, 42
HIGH_FROM = 0.5
DEFAULT_MODEL = "Logistic Regression"


#: Strength of the loss against the penalty of the regression.
STRENGTH = 0.5
#: The hold-out fit, besides the folds 0, 1, ...
HOLD_OUT = -1


@dataclass(frozen=True)
class Settings:
    """Sizes of the ensembles; smaller ones are for tests only."""

    trees: int = 200
    rounds: int = 150
    parallelism: int = 6


def _forest(width: int, settings: Settings):
    return RandomForestClassifier(
        numTrees=settings.trees, maxDepth=6, minInstancesPerNode=3, seed=MODEL_SEED,
        featureSubsetStrategy=str(max(1, math.isqrt(width))),
    )


def _boosted(width: int, settings: Settings):
    return GBTClassifier(
        maxIter=settings.rounds, maxDepth=4, minInstancesPerNode=3, subsamplingRate=0.8,
        stepSize=0.05, seed=MODEL_SEED,
    )


# Name -> (estimator, whether the two classes get equal total weight).
ENSEMBLES: dict[str, tuple[Callable, bool]] = {
    "Random Forest": (_forest, True),
    "Gradient Boosting": (_boosted, False),
}
CLASSIFIERS = [DEFAULT_MODEL, *ENSEMBLES]


class Ensemble:
    """A fitted Spark ML pipeline."""

    def __init__(self, pipeline: PipelineModel) -> None:
        self.pipeline = pipeline

    @property
    def weights(self) -> list[float]:
        return [float(v) for v in self.pipeline.stages[-1].featureImportances.toArray()]

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with p, the probability of high risk, and the scaled features."""
        made = self.pipeline.transform(rows)
        return made.select(*rows.columns, vector_to_array("probability")[1].alias("p"), vector_to_array("scaled").alias("scaled"))


class Regression:
    """A fitted logistic regression: plain column expressions."""

    def __init__(self, model: Logistic) -> None:
        self.model = model

    @property
    def weights(self) -> list[float]:
        return [abs(v) for v in self.model.coefficients[1:]]

    def scored(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", self.model.probability().alias("p"), F.array(*self.model.scaled()).alias("scaled"))


@dataclass(frozen=True)
class Trained:
    """The fits of one classifier so far: on all but the held-out rows, and on all but each fold."""

    name: str
    features: list[str]
    fits: dict[int, Ensemble | Regression]

    @property
    def model(self) -> Ensemble | Regression:
        return self.fits[HOLD_OUT]


def _draw(seed: int) -> Column:
    """60 bits of md5 of the customer and the seed."""
    digest = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def training_rows(ws) -> DataFrame:
    """Features, label, hold-out flag and fold of every customer.

    Both draws number the customers of a class in hash order, which keeps the
    class shares exact; the numbering is sliced by the leading hash bits, so a
    class is never sorted in one task. A customer's draw does not depend on
    partitioning.
    """

    def build() -> DataFrame:
        rows = profiles(ws).select(
            "customer_id",
            F.col("is_high_risk").cast("int").alias("label"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ALL_FEATURES],
        )
        for seed, name in ((SPLIT_SEED, "split_draw"), (FOLD_SEED, "fold_draw")):
            draw = _draw(seed)
            rows = sliced_row_number(
                rows, ["label"], [F.shiftright(draw, 44)], [draw, F.col("customer_id")], name
            )
        per_class = {
            r["label"]: r["n"]
            for r in profiles(ws)
            .groupBy(F.col("is_high_risk").cast("int").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")).collect()
        }
        held_out = F.lit(0)
        for label, n in _test_sizes(per_class).items():
            held_out = F.when(F.col("label") == label, n).otherwise(held_out)
        return rows.select(
            "customer_id", "label", *ALL_FEATURES,
            (F.col("split_draw") <= held_out).alias("is_test"),
            ((F.col("fold_draw") - 1) % FOLDS).cast("int").alias("fold"),
        )

    return ws.keep("training_rows", build)


def _test_sizes(per_class: dict[int, int]) -> dict[int, int]:
    """A quarter of all rows, rounded up, shared out by class size."""
    total = sum(per_class.values())
    size = math.ceil(total * TEST_SHARE)
    shares = {k: size * n / total for k, n in per_class.items()}
    sizes = {k: math.floor(v) for k, v in shares.items()}
    by_remainder = sorted(shares, key=lambda k: (sizes[k] - shares[k], k))
    for k in by_remainder[: size - sum(sizes.values())]:
        sizes[k] += 1
    return sizes


def _fit_ensemble(name: str, rows: DataFrame, settings: Settings) -> Ensemble:
    make, balanced = ENSEMBLES[name]
    features = labels.FEATURE_SETS[name]
    estimator = make(len(features), settings).setFeaturesCol("scaled").setLabelCol("label")
    if balanced:
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        total, weight = sum(sizes.values()), F.lit(1.0)
        for label, n in sizes.items():
            weight = F.when(F.col("label") == label, total / (len(sizes) * n)).otherwise(weight)
        rows = rows.withColumn("weight", weight)
        estimator = estimator.setWeightCol("weight")
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        estimator,
    ]
    # A copy has no training summary, which holds a session and cannot go to executors.
    return Ensemble(Pipeline(stages=stages).fit(rows).copy())


def _parts() -> dict[int, tuple[Column, Column]]:
    """Each fit's condition of the rows it learns from and of those it is judged on."""
    folds = {k: (F.col("fold") != k, F.col("fold") == k) for k in range(FOLDS)}
    return {HOLD_OUT: (~F.col("is_test"), F.col("is_test")), **folds}


def _fit_ensembles(ws, tasks: list[tuple[str, int]], settings: Settings) -> dict[tuple[str, int], Ensemble]:
    """The fits are independent Spark jobs and run side by side; if one fails, the others are stopped."""
    context = ws.spark.sparkContext
    if context.getCheckpointDir() is None:
        # Boosting truncates its lineage every few rounds if it has a place to.
        context.setCheckpointDir(shared_dir(ws.spark))
    rows, tag = training_rows(ws), f"rentlens-fits-{uuid.uuid4().hex}"

    def fit(name: str, k: int) -> Ensemble:
        ws.spark.addTag(tag)
        return _fit_ensemble(name, rows.where(_parts()[k][0]), settings)

    pool = ThreadPool(settings.parallelism)
    try:
        start = inheritable_thread_target(ws.spark)
        waiting = {task: pool.apply_async(start(fit), task) for task in tasks}
        return {task: found.get() for task, found in waiting.items()}
    except BaseException:
        ws.spark.interruptTag(tag)
        raise
    finally:
        pool.terminate()


def train(
    ws, settings: Settings | None = None, names: Iterable[str] = CLASSIFIERS, fits: Iterable[int] | None = None
) -> dict[str, Trained]:
    """The named models with the fits asked for, hold-out and cross-validation if none are named, each fitted once for each setting.

    Settings given here are the workspace's from then on. Each fold fits its own scaler on the rows it trains on.
    """
    if settings:
        ws.memo["model_settings"] = settings
    settings = ws.memo.setdefault("model_settings", Settings())
    models = ws.memo.setdefault(("models", settings), {})
    names, parts = list(names), _parts()
    missing = {n: [k for k in (parts if fits is None else fits) if n not in models or k not in models[n].fits] for n in names}
    found: dict[tuple[str, int], Ensemble | Regression] = {}
    if wanted := missing.get(DEFAULT_MODEL):
        learned = {k: parts[k][0] for k in wanted}
        regressions = fit_logistic(training_rows(ws), labels.FEATURE_SETS[DEFAULT_MODEL], learned, STRENGTH)
        found |= {(DEFAULT_MODEL, k): Regression(m) for k, m in regressions.items()}
    # The slowest fits first, so that none is left running alone at the end.
    if tasks := [(n, k) for n in reversed(names) if n in ENSEMBLES for k in missing[n]]:
        found |= _fit_ensembles(ws, tasks, settings)
    for (name, k), fit in found.items():
        models.setdefault(name, Trained(name, labels.FEATURE_SETS[name], {})).fits[k] = fit
    return {n: models[n] for n in names}


def judged(ws, names: Iterable[str] = CLASSIFIERS, folds: bool = True) -> DataFrame:
    """(model, fit, label, p, prediction) of every row a fit is judged on; fit -1 is the hold-out, the only one without folds."""
    names, union = list(names), None
    groups = {"held": [HOLD_OUT]} | ({"folds": list(range(FOLDS))} if folds else {})
    models = train(ws, None, names, [k for fits in groups.values() for k in fits])
    settings = ws.memo["model_settings"]
    for (name, trained), (group, fits) in product(models.items(), groups.items()):

        def build(trained=trained, fits=fits) -> DataFrame:
            rows, found = training_rows(ws), None
            for k in fits:
                part = trained.fits[k].scored(rows.where(_parts()[k][1]).select("label", *trained.features))
                part = part.select(F.lit(trained.name).alias("model"), F.lit(k).alias("fit"), "label", "p")
                found = part if found is None else found.unionByName(part)
            return found.withColumn("prediction", (F.col("p") >= HIGH_FROM).cast("int"))

        part = ws.keep(f"judged-{name}-{group}-{settings.trees}-{settings.rounds}".replace(" ", "_"), build)
        union = part if union is None else union.unionByName(part)
    return union


def confusion_matrix(ws, names: Iterable[str] = CLASSIFIERS) -> DataFrame:
    """Hold-out rows per model, label and prediction; absent cells are 0."""
    predicted = lambda k: F.count(F.when(F.col("prediction") == k, 1))
    return (
        judged(ws, names, folds=False)
        .groupBy("model", "label").agg(predicted(0).alias("predicted_low"), predicted(1).alias("predicted_high"))
        .orderBy("model", "label")
    )


def classification_report(ws, names: Iterable[str] = CLASSIFIERS) -> DataFrame:
    """Precision, recall, F1 and support per class, with the usual averages."""
    one = lambda column, label: F.sum(F.when(F.col("label") == label, F.col(column)))
    cells = confusion_matrix(ws, names).groupBy("model").agg(
        F.coalesce(one("predicted_low", 0), F.lit(0)).alias("tn"),
        F.coalesce(one("predicted_high", 0), F.lit(0)).alias("fp"),
        F.coalesce(one("predicted_low", 1), F.lit(0)).alias("fn"),
        F.coalesce(one("predicted_high", 1), F.lit(0)).alias("tp"),
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    scores = {}
    for label, (hit, wrong, missed) in {"0": ("tn", "fn", "fp"), "1": ("tp", "fp", "fn")}.items():
        hit, wrong, missed = F.col(hit), F.col(wrong), F.col(missed)
        scores[label] = {
            "precision": share(hit, hit + wrong),
            "recall": share(hit, hit + missed),
            "f1": share(2 * hit, 2 * hit + wrong + missed),
            "support": hit + missed,
        }
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    accuracy = share(F.col("tn") + F.col("tp"), total)
    measures = ("precision", "recall", "f1")
    rows = [
        *[(label, *[s[m] for m in measures], s["support"]) for label, s in scores.items()],
        ("accuracy", accuracy, accuracy, accuracy, total),
        ("macro avg", *[(scores["0"][m] + scores["1"][m]) / 2 for m in measures], total),
        (
            "weighted avg",
            *[
                share(sum(s[m] * s["support"] for s in scores.values()), total)
                for m in measures
            ],
            total,
        ),
    ]
    names = ("entry", *measures, "support")
    entries = F.array(
        *[
            F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, row, strict=True)])
            for row in rows
        ]
    )
    return cells.select("model", F.explode(entries).alias("e")).select("model", "e.*")


def model_metrics(ws, names: Iterable[str] = CLASSIFIERS) -> DataFrame:
    """Hold-out and cross-validation scores, four places, one row per model."""
    rows = judged(ws, names)
    cell = lambda label, k: F.count(F.when((F.col("label") == label) & (F.col("prediction") == k), 1))
    counts = rows.groupBy("model", "fit").agg(
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), F.count("*").alias("n"),
    )
    areas = roc_areas(rows, ["model", "fit"], "p", "label")
    each = counts.join(areas, ["model", "fit"]).select(
        "model", "fit", "n", "auc",
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        # Rows that are neither true positives nor true negatives are the errors of both kinds.
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("n") - F.col("tn")), F.lit(0.0)).alias("f1"),
    )
    held, fold = F.col("fit") == HOLD_OUT, F.col("fit") != HOLD_OUT
    at = lambda column: rint_to(F.max(F.when(held, F.col(column))), 4)
    mean = lambda column: rint_to(F.avg(F.when(fold, F.col(column))), 4)
    spread = lambda column: rint_to(F.stddev_pop(F.when(fold, F.col(column))), 4)
    width = F.lit(0)
    for name, features in labels.FEATURE_SETS.items():
        width = F.when(F.col("model") == name, len(features)).otherwise(width)
    # Every row is held out by one fold, so the folds together are all rows.
    test_size = F.max(F.when(held, F.col("n")))
    return each.groupBy("model").agg(
        width.alias("features"), at("accuracy").alias("accuracy"), at("auc").alias("roc_auc"), at("f1").alias("f1"),
        mean("accuracy").alias("cv_acc_mean"), spread("accuracy").alias("cv_acc_std"),
        mean("auc").alias("cv_auc_mean"), spread("auc").alias("cv_auc_std"), mean("f1").alias("cv_f1_mean"),
        (F.sum(F.when(fold, F.col("n"))) - test_size).alias("train_size"), test_size.alias("test_size"),
    )


def best_model(ws) -> DataFrame:
    return (
        model_metrics(ws).select("model", "cv_auc_mean", "cv_acc_std", "cv_auc_std")
        .orderBy(F.desc("cv_auc_mean"), "model").limit(1)
    )


def feature_importance(ws, names: Iterable[str] = CLASSIFIERS) -> DataFrame:
    rows = [
        (model.name, i, labels.FEATURE_LABELS[feature], round(weight, 4))
        for model in train(ws, None, names, [HOLD_OUT]).values()
        for i, (feature, weight) in enumerate(zip(model.features, model.model.weights, strict=True))
    ]
    return ws.spark.createDataFrame(
        rows, "model string, position int, feature string, importance double"
    )


def scoring_inputs(ws, diversity_places: int = 2) -> DataFrame:
    """Profiles as model input, with genre diversity recomputed for scoring."""
    diversity = rint_to(F.col("unique_genres") / F.col("total_rentals"), diversity_places)
    return profiles(ws).select(
        "customer_id", *[c for c in ALL_FEATURES if c != "genre_diversity"],
        diversity.alias("genre_diversity"),
    )


def score(ws, customers: DataFrame, name: str = DEFAULT_MODEL) -> DataFrame:
    """Probability, label and feature contributions for any customers.

    ``customers`` holds customer_id and any of the feature columns; a missing
    column or value counts as 0.
    """
    model = train(ws, None, [name], [HOLD_OUT])[name]
    inputs = customers.select(
        "customer_id",
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in customers.columns else F.lit(0.0))
            .alias(c)
            for c in model.features
        ],
    )
    # |scaled value| times the weight of its feature, as shares of their sum.
    raw = F.array(*[F.abs(F.col("scaled")[i]) * w for i, w in enumerate(model.model.weights)])
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    divisor = F.when(total > 0, total).otherwise(1.0)
    return (
        model.model.scored(inputs)
        .select("customer_id", "p", raw.alias("raw"))
        .select(
            "customer_id",
            F.lit(name).alias("model"),
            rint_to(F.col("p"), 4).alias("probability"),
            (F.col("p") >= HIGH_FROM).alias("predicted_risk"),
            F.when(F.col("p") >= HIGH_FROM, labels.RISK_HIGH).otherwise(labels.RISK_LOW)
            .alias("risk_label"),
            F.transform("raw", lambda x: rint_to(x / divisor * 100, 1)).alias("contributions"),
        )
    )


def _scored_by(ws, names: Iterable[str]) -> DataFrame:
    result = None
    for name in train(ws, None, names, [HOLD_OUT]):
        part = score(ws, scoring_inputs(ws), name)
        result = part if result is None else result.unionByName(part)
    return result


def risk_scores(ws, names: Iterable[str] = CLASSIFIERS) -> DataFrame:
    """Every customer scored by every model."""
    return _scored_by(ws, names).drop("contributions")


def _unfolded(scored: DataFrame) -> DataFrame:
    named = F.lit(None).cast("array<string>")
    for name, features in labels.FEATURE_SETS.items():
        texts = F.array(*[F.lit(labels.FEATURE_LABELS[f]) for f in features])
        named = F.when(F.col("model") == name, texts).otherwise(named)
    return scored.select(
        "*", F.posexplode(F.arrays_zip(named.alias("feature"), "contributions")).alias("position", "c")
    ).select(
        *[c for c in scored.columns if c != "contributions"], "position",
        F.col("c.feature").alias("feature"), F.col("c.contributions").alias("contribution"),
    )


def risk_contributions(ws, names: Iterable[str] = CLASSIFIERS) -> DataFrame:
    """Per customer, model and feature: its share of the score in percent."""
    return _unfolded(_scored_by(ws, names)).select(
        "customer_id", "model", "position", "feature", "contribution"
    )


def top_drivers(ws, name: str = DEFAULT_MODEL) -> DataFrame:
    """The feature with the largest contribution, the first one on ties."""
    first = F.row_number().over(
        Window.partitionBy("customer_id").orderBy(F.desc("contribution"), "position")
    )
    return (
        _unfolded(score(ws, scoring_inputs(ws), name))
        .withColumn("k", first).where("k = 1").drop("k", "position")
    )


def risk_actions(ws, name: str = DEFAULT_MODEL) -> DataFrame:
    """Three cards per customer, depending on the predicted risk."""
    values = {
        "driver": F.col("feature"),
        "share": F.call_function("format_number", F.col("contribution"), F.lit("0.0")),
    }

    def cards(texts):
        return F.array(
            *[
                F.struct(
                    F.lit(tier).alias("tier"), F.lit(title).alias("title"),
                    filled(body, values).alias("body"),
                )
                for tier, (title, body) in zip(labels.TIERS, texts, strict=True)
            ]
        )

    chosen = F.when(F.col("predicted_risk"), cards(labels.RISK_ACTIONS_HIGH)).otherwise(
        cards(labels.RISK_ACTIONS_LOW)
    )
    return top_drivers(ws, name).select(
        "customer_id", "predicted_risk", F.explode(chosen).alias("action")
    ).select("customer_id", "predicted_risk", "action.*")
