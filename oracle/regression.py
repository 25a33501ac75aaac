"""The logistic regression in SQL: draws, standardisation, Newton steps, and what follows from the fit.

The optimum is unique, so a fixed number of plain Newton steps meets the engine's
fit after rounding. A step sums gradient and Hessian over the rows of each fit and
solves four equations by a Cholesky factor, written out column by column.
"""

from __future__ import annotations

from oracle.base import RELATIONS, labels, quoted, r, statement, text

MODEL = "Logistic Regression"
FEATURES = labels.FEATURE_SETS[MODEL]
STEPS = 12


def draw(seed: int) -> str:
    return f"('0x' || substr(md5(customer_id || ':{seed}'), 1, 15))::BIGINT"


def newton(before: str) -> str:
    """The coefficients after one step from those in ``before``; later columns use earlier ones."""
    z = ["1.0::DOUBLE", "z1", "z2", "z3"]
    gradient = [f"sum(w * (p - y) * {z[i]}) * 0.5 + {f'any_value(b{i})' if i else '0'} AS g{i}" for i in range(4)]
    hessian = [
        f"sum(w * p * (1 - p) * {z[i]} * {z[j]}) * 0.5 + {1 if i == j and i else 0} AS h{i}{j}"
        for i in range(4) for j in range(i, 4)
    ]
    factor = []
    for i in range(4):
        factor.append(f"sqrt(h{i}{i}{''.join(f' - l{i}{k} * l{i}{k}' for k in range(i))}) AS l{i}{i}")
        for j in range(i + 1, 4):
            factor.append(f"(h{i}{j}{''.join(f' - l{j}{k} * l{i}{k}' for k in range(i))}) / l{i}{i} AS l{j}{i}")
    down = [f"(-g{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i}" for i in range(4)]
    up = [f"(y{i}{''.join(f' - l{k}{i} * d{k}' for k in range(i + 1, 4))}) / l{i}{i} AS d{i}" for i in reversed(range(4))]
    return f"""
        SELECT fit, {", ".join(f"b{i} + d{i} AS b{i}" for i in range(4))}
        FROM (SELECT *, {", ".join(factor + down + up)}
              FROM (SELECT fit, {", ".join(f"any_value(b{i}) AS b{i}" for i in range(4))}, {", ".join(gradient + hessian)}
                    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3))) AS p
                          FROM unit_rows JOIN {before} USING (fit)) GROUP BY fit))"""


def unit(i: int) -> str:
    return f"(x{i} - m{i}) / coalesce(nullif(s{i}, 0), 1)"


MARGIN = "b0 + " + " + ".join(f"b{i} * {unit(i)}" for i in (1, 2, 3))

RELATIONS |= {
    "features": f"""
        SELECT customer_id, is_high_risk::INTEGER AS label,
               {", ".join(f"coalesce({f}::DOUBLE, 0) AS x{i}" for i, f in enumerate(FEATURES, 1))} FROM profile""",
    "drawn": f"""
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw(7)}, customer_id) AS split_draw,
               row_number() OVER (PARTITION BY label ORDER BY {draw(42)}, customer_id) AS fold_draw FROM features""",
    "held_out": """
        SELECT label, least_n + (row_number() OVER (ORDER BY least_n - share, label)
                   <= size - sum(least_n) OVER ())::INTEGER AS n_test
        FROM (SELECT *, floor(share)::BIGINT AS least_n
              FROM (SELECT label, ceil(sum(count(*)) OVER () * 0.25) AS size, size * count(*)::DOUBLE / sum(count(*)) OVER () AS share
                    FROM features GROUP BY label))""",
    "training": """
        SELECT drawn.*, split_draw <= n_test AS is_test, (fold_draw - 1) % 5 AS fold
        FROM drawn JOIN held_out ON drawn.label = held_out.label""",
    "learned": """
        SELECT -1 AS fit, * FROM training WHERE NOT is_test
        UNION ALL SELECT k, training.* FROM training, range(5) AS folds(k) WHERE fold <> k""",
    "moments": f"""
        SELECT fit, count(*) / (2.0::DOUBLE * (count(*) - sum(label))) AS w0, count(*) / (2.0::DOUBLE * sum(label)) AS w1,
               {", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in (1, 2, 3))}
        FROM learned GROUP BY fit""",
    "unit_rows": f"""
        SELECT l.fit, l.label AS y, CASE l.label WHEN 1 THEN w1 ELSE w0 END AS w, {", ".join(f"{unit(i)} AS z{i}" for i in (1, 2, 3))}
        FROM learned l JOIN moments ON l.fit = moments.fit""",
    "newton0": "SELECT fit, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2, 0::DOUBLE AS b3 FROM moments",
    **{f"newton{k}": newton(f"newton{k - 1}") for k in range(1, STEPS + 1)},
    "fitted": f"SELECT n.*, moments.* EXCLUDE (fit) FROM newton{STEPS} n JOIN moments ON n.fit = moments.fit",
    "judged": f"""
        SELECT *, (p >= 0.5)::INTEGER AS prediction
        FROM (SELECT f.fit, t.label, 1 / (1 + exp(-({MARGIN}))) AS p
              FROM training t JOIN fitted f ON CASE WHEN f.fit < 0 THEN t.is_test ELSE t.fold = f.fit END)""",
    "cells": """
        SELECT fit, count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
               count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
               count(*) FILTER (label = 0 AND prediction = 1) AS fp FROM judged GROUP BY fit""",
    "areas": """
        SELECT fit, (sum(place) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
                   / (sum(label) * (count(*) - sum(label))) AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY fit ORDER BY p)
                  + (count(*) OVER (PARTITION BY fit, p) - 1) / 2.0::DOUBLE AS place FROM judged) GROUP BY fit""",
    "fold_scores": """
        SELECT c.*, auc, (tp + tn)::DOUBLE / n AS accuracy, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
        FROM cells c JOIN areas a ON c.fit = a.fit""",
    "rated": f"""
        SELECT customer_id, p, {", ".join(f"abs({unit(i)}) * abs(b{i}) AS c{i}" for i in (1, 2, 3))}, c1 + c2 + c3 AS whole
        FROM (SELECT f.*, t.*, 1 / (1 + exp(-({MARGIN}))) AS p FROM features t, fitted f WHERE fit = -1)""",
    "rated_features": " UNION ALL ".join(
        f"""SELECT customer_id, p, {i - 1} AS position, {quoted(labels.FEATURE_LABELS[f])} AS feature,
            round_even(c{i} / CASE WHEN whole > 0 THEN whole ELSE 1 END * 100, 1) AS contribution FROM rated"""
        for i, f in enumerate(FEATURES, 1)
    ),
    "driver": """
        SELECT * FROM rated_features
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY contribution DESC, position) = 1""",
}

NAME = f"{quoted(MODEL)} AS model"
JUDGEMENT = f"""round_even(p, 4) AS probability, p >= 0.5 AS predicted_risk,
    CASE WHEN p >= 0.5 THEN {quoted(labels.RISK_HIGH)} ELSE {quoted(labels.RISK_LOW)} END AS risk_label"""


def share(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0)"


def report() -> str:
    """Precision, recall, F1 and support of each class, and their averages."""
    of = {"0": ("tn", "fn", "fp"), "1": ("tp", "fp", "fn")}
    scores = {
        label: (share(hit, f"{hit} + {wrong}"), share(hit, f"{hit} + {missed}"), share(f"2 * {hit}", f"2 * {hit} + {wrong} + {missed}"), f"({hit} + {missed})")
        for label, (hit, wrong, missed) in of.items()
    }
    low, high = scores.values()
    accuracy = share("tp + tn", "n")
    rows = [
        *((label, *s) for label, s in scores.items()),
        ("accuracy", accuracy, accuracy, accuracy, "n"),
        ("macro avg", *(f"({low[k]} + {high[k]}) / 2" for k in range(3)), "n"),
        ("weighted avg", *(share(f"{low[k]} * {low[3]} + {high[k]} * {high[3]}", "n") for k in range(3)), "n"),
    ]
    return " UNION ALL ".join(
        f"SELECT {NAME}, {quoted(entry)} AS entry, {r(precision, 'precision')}, {r(recall, 'recall')}, {r(f1, 'f1')}, {support} AS support FROM cells WHERE fit = -1"
        for entry, precision, recall, f1, support in rows
    )


def action_cards() -> str:
    fill = {"driver": "feature", "share": "format('{:.1f}', contribution)"}
    return " UNION ALL ".join(
        f"SELECT customer_id, p >= 0.5 AS predicted_risk, {quoted(tier)} AS tier, {quoted(title)} AS title, {text(body, **fill)} AS body FROM driver WHERE {condition}"
        for condition, cards in (("p >= 0.5", labels.RISK_ACTIONS_HIGH), ("p < 0.5", labels.RISK_ACTIONS_LOW))
        for tier, (title, body) in zip(labels.TIERS, cards, strict=True)
    )


HELD, FOLDS = "FILTER (fit = -1)", "FILTER (fit >= 0)"
STATEMENTS = {
    "logistic_metrics": statement(f"""
        SELECT {NAME}, 3 AS features, round_even(max(accuracy) {HELD}, 4) AS accuracy, round_even(max(auc) {HELD}, 4) AS roc_auc,
               round_even(max(f1) {HELD}, 4) AS f1, round_even(avg(accuracy) {FOLDS}, 4) AS cv_acc_mean,
               round_even(stddev_pop(accuracy) {FOLDS}, 4) AS cv_acc_std, round_even(avg(auc) {FOLDS}, 4) AS cv_auc_mean,
               round_even(stddev_pop(auc) {FOLDS}, 4) AS cv_auc_std, round_even(avg(f1) {FOLDS}, 4) AS cv_f1_mean,
               (sum(n) {FOLDS} - max(n) {HELD})::BIGINT AS train_size, max(n) {HELD} AS test_size
        FROM fold_scores"""),
    "logistic_confusion": statement(f"""
        SELECT {NAME}, label, count(*) FILTER (prediction = 0) AS predicted_low, count(*) FILTER (prediction = 1) AS predicted_high
        FROM judged WHERE fit = -1 GROUP BY label"""),
    "logistic_report": statement(report()),
    "logistic_importance": statement(" UNION ALL ".join(
        f"SELECT {NAME}, {i - 1} AS position, {quoted(labels.FEATURE_LABELS[f])} AS feature, round_even(abs(b{i}), 4) AS importance FROM fitted WHERE fit = -1"
        for i, f in enumerate(FEATURES, 1)
    )),
    "logistic_scores": statement(f"SELECT customer_id, {NAME}, {JUDGEMENT} FROM rated"),
    "logistic_contributions": statement(f"SELECT customer_id, {NAME}, position, feature, contribution FROM rated_features"),
    "top_drivers": statement(f"SELECT customer_id, {NAME}, {JUDGEMENT}, feature, contribution FROM driver"),
    "risk_actions": statement(action_cards()),
}
