"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as contract

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return duck(ROOT)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, ROOT)
    assert differences(df, sql.execute(contract.oracle_sql()[name])) == []


def test_entry_is_the_profile(spark):
    from rentlens.plans.profiles import PROFILE_COLUMNS

    assert contract.entry(spark).columns == PROFILE_COLUMNS


def test_only_models_lack_sql():
    own = {x for x in contract.queries() if not (x.startswith("op") or x == "pipeline")}
    missing = own - set(contract.oracle_sql())
    assert missing == {
        "risk_model_metrics", "risk_feature_importance", "confusion_matrix",
        "classification_report", "best_model", "risk_scores", "risk_contributions",
    }
