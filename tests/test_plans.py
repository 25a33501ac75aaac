"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from rentlens import Workspace
from rentlens.operators import fact
from rentlens.plans import overview
from rentlens.registry import PLANS
from rentlens.sources import from_star

ROOT = "/root/testdata/sf0.001"
SQL_PLANS = sorted(contract.oracle_sql())
# Joins of this kind compare every row with every row.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SQL_PLANS)
def test_no_cross_join_and_no_python(spark, name):
    plan = physical(contract.queries()[name](spark, ROOT))
    assert not [word for word in FORBIDDEN if word in plan]


@pytest.mark.parametrize("name", SQL_PLANS)
def test_windows_are_partitioned(spark, name):
    plan = physical(contract.queries()[name](spark, ROOT))
    for line in plan.splitlines():
        found = re.search(r"Window \[.*?windowspecdefinition\((.*)", line)
        # A window over everything starts its definition with an ordering.
        assert not (found and re.match(r"\w+#\w+ (ASC|DESC)", found.group(1))), line


def test_scan_reads_only_what_weighted_rentals_need(spark):
    plan = physical(fact.weighted_rentals(from_star(spark, ROOT)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>?", plan)
    assert schemas and not [s for s in schemas if "l_shipdate" in s or "p_name" in s]
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.0)" in plan


@pytest.mark.parametrize("name", ["monthly_trend", "category_stats"])
def test_distinct_customers_are_counted_rows(spark, name):
    """Rows of a table reduced by customer: nothing is expanded or shuffled by customer again."""
    plan = physical(PLANS[name](Workspace(spark, from_star(spark, ROOT))))
    assert "Expand" not in plan and not re.search(r"hashpartitioning\([^)]*customer_id", plan)


def test_one_customer_is_read_from_one_bucket(spark):
    ws = Workspace(spark, from_star(spark, ROOT))
    df = PLANS["customer_rentals"](ws)
    plan = physical(df)
    buckets = re.findall(r"PartitionFilters: \[[^]]*bucket#\d+ = (\d+)", plan)
    assert len(buckets) == 1 and re.search(r"PushedFilters: \[[^]]*EqualTo\(customer_id,42\)", plan)
    # The payments are in the layout: no scan of theirs, and so no exchange above one.
    assert "l_discount" not in plan
    found = ws.facts_by_customer.where("customer_id = 42").select("bucket").distinct().collect()
    assert [str(r["bucket"]) for r in found] == buckets


def test_a_customer_without_rentals_has_no_rows(spark):
    ws = Workspace(spark, from_star(spark, ROOT))
    assert overview.customer_rentals(ws, 10**12).count() == 0


@pytest.mark.parametrize(
    "name",
    ["customer_profiles", "genre_transitions", "next_genre_films", "film_recommendations",
     "category_stats", "country_top_genre"],
)
def test_results_hold_without_any_automatic_broadcast(spark, name):
    """As with dimensions too large to broadcast."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        ws = Workspace(spark, from_star(spark, ROOT))
        from rentlens.functions.scalar import tidy

        df = tidy(PLANS[name](ws))
        assert "BroadcastHashJoin" not in physical(df)
        assert differences(df, duck(ROOT).execute(contract.oracle_sql()[name])) == []
    finally:
        spark.conf.set(threshold, before)


@pytest.mark.parametrize(
    "name", ["dayofweek_stats", "monthly_trend", "customer_profiles", "genre_transitions"]
)
def test_results_do_not_depend_on_the_session_time_zone(spark, name):
    from rentlens.functions.scalar import tidy

    zone = "spark.sql.session.timeZone"
    before = spark.conf.get(zone)
    spark.conf.set(zone, "America/New_York")
    try:
        ws = Workspace(spark, from_star(spark, ROOT))
        df = tidy(PLANS[name](ws))
        assert differences(df, duck(ROOT).execute(contract.oracle_sql()[name])) == []
    finally:
        spark.conf.set(zone, before)
