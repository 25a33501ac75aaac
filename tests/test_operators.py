"""Building blocks against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.functions.scalar import clip, rint_to, whole_days
from rentlens.operators.quantiles import exact_quantiles
from rentlens.operators.ranking import sliced_row_number, spread_join, taken_before
from rentlens.operators.sequences import FIRST, ORDER, category_steps, neighbour_scan, rental_gaps


@pytest.mark.parametrize("width", [2, 3, 32])
def test_quantiles_equal_numpy(spark, width):
    rng = random.Random(width)
    heavy_tail = [round(rng.lognormvariate(3, 3), 2) for _ in range(700)]
    ties = [float(rng.choice([1, 1, 1, 2, 50])) for _ in range(700)]
    df = spark.createDataFrame(list(zip(heavy_tail, ties)), "a double, b double")
    wanted = {"a": [0.0, 0.25, 0.5, 0.75, 1.0], "b": [0.5, 0.55, 0.9]}
    got = exact_quantiles(df, wanted, width=width)
    for column, values in (("a", heavy_tail), ("b", ties)):
        for p in wanted[column]:
            assert got[(column, p)] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_one_and_no_row(spark):
    df = spark.createDataFrame([(5.0, None)], "a double, b double")
    assert exact_quantiles(df, {"a": [0.3], "b": [0.5]}) == {("a", 0.3): 5.0, ("b", 0.5): None}


def test_sliced_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = sliced_row_number(
        df, ["g"], [F.floor(F.col("v") / 7)], [F.col("v"), F.col("id")], "n"
    ).collect()
    for g in "xy":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        assert {r["id"]: r["n"] for r in got if r["g"] == g} == {
            r[2]: i for i, r in enumerate(ordered, 1)
        }


@pytest.mark.parametrize("range_end", [12, 400])
def test_taken_before_finds_the_first_free_positions(spark, range_end):
    """Sets within a word and over several, with whole words taken, and with repeats."""
    rng = random.Random(2)
    seen = {k: sorted(rng.sample(range(1, range_end), rng.randrange(1, range_end - 1))) for k in range(60)}
    seen |= {100: list(range(1, 129)), 101: list(range(1, 131)) + [140], 102: [64], 103: [65], 104: list(range(1, 65)) + [300]}
    df = spark.createDataFrame([(k, p) for k, ps in seen.items() for p in ps * 2], "k int, p int")
    rows = taken_before(df, ["k"], "p", 4).collect()
    assert len(rows) == len(seen)
    for row in rows:
        free = [p for p in range(1, 2 * range_end + 400) if p not in seen[row["k"]]]
        assert [j + t for j, t in enumerate(row["taken"], 1)] == free[:4]
        assert row["n_taken"] == len(seen[row["k"]])


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_spread_join_bounds_the_rows_of_a_key(spark, most):
    rows = spark.range(300).select("id", F.when(F.col("id") < 250, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    found = rows.select("k").distinct().select("k", F.concat("k", F.lit("!")).alias("v"))
    joined = spread_join(rows, found, ["k"], "id", most)
    assert {(r["id"], r["v"]) for r in joined.collect()} == {(r["id"], r["k"] + "!") for r in rows.collect()} and joined.count() == 300
    copies = 250 // most + 1
    dealt = rows.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(copies))).count().agg(F.max("count")).first()[0]
    assert dealt <= max(3 * most, 8)
    assert spread_join(rows.limit(0), found, ["k"], "id", most).count() == 0


@pytest.fixture(scope="module")
def history(spark):
    """Random rentals with many equal timestamps; a third belong to customer 1."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        customer = 1 if i % 3 == 0 else rng.randrange(2, 40)
        hours = rng.choice([rng.randrange(24 * 60), rng.randrange(6)])
        rows.append((customer, i, 3600 * hours + rng.choice([0, 0, 59, 3599]), rng.choice("ABC"), rng.choice([1, 1, 3])))
    return rows


def _frame(spark, history):
    at = F.expr("timestampadd(SECOND, seconds, TIMESTAMP_NTZ '2020-01-01 00:00:00')")
    return spark.createDataFrame(
        history, "customer_id long, rental_id long, seconds int, category string, n_rows long"
    ).withColumn("rental_date", at)


@pytest.mark.parametrize("partitions", [1, 3, 200])
def test_gaps_and_steps(spark, history, partitions):
    """From one partition to more than there are customers: their edges meet within customer 1."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = neighbour_scan(_frame(spark, history)).persist()
        places = scan.where(F.col("kind") == FIRST).count()
        gaps = {r["customer_id"]: r["gap_days"] for r in rental_gaps(scan).collect()}
        steps = {(r["category"], r["next_category"]): r["count"] for r in category_steps(scan).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert places == 1 if partitions == 1 else places > partitions / 2
    want_gaps, want_steps = {}, {}
    for customer in {r[0] for r in history}:
        rows = sorted((r[2], r[1], r[3], r[4]) for r in history if r[0] == customer)
        want_gaps[customer] = sum((b[0] - a[0]) // 86400 for a, b in zip(rows, rows[1:]))
        expanded = [r[2] for r in rows for _ in range(r[3])]
        for pair in zip(expanded, expanded[1:]):
            want_steps[pair] = want_steps.get(pair, 0) + 1
    assert gaps == {k: v for k, v in want_gaps.items() if v} and steps == want_steps


def test_one_customer_at_one_time_is_spread(spark):
    """Most rows belong to one customer and one timestamp: no partition holds much more than its share."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("customer_id"), F.col("id").alias("rental_id"),
        F.lit("2020-01-01 10:00:00").cast("timestamp_ntz").alias("rental_date"), F.lit("A").alias("category"), F.lit(1).cast("long").alias("n_rows"),
    )
    ordered = rows.repartitionByRange(8, *ORDER)
    sizes = [r["n"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 20_000 / 8
    assert [tuple(r) for r in category_steps(neighbour_scan(rows)).collect()] == [("A", "A", 17_999)]


def test_scan_of_nothing_and_of_single_rows(spark, history):
    frame = _frame(spark, history)
    assert rental_gaps(neighbour_scan(frame.limit(0))).count() == 0
    single = frame.dropDuplicates(["customer_id"]).withColumn("n_rows", F.lit(1).cast("long"))
    assert rental_gaps(neighbour_scan(single)).count() == 0 and category_steps(neighbour_scan(single)).count() == 0


def test_scalar_rules(spark):
    row = spark.sql(
        "SELECT 0.125D AS x, CAST(NULL AS DOUBLE) AS n, TIMESTAMP_NTZ '2020-01-01 23:00:00' AS a, "
        "TIMESTAMP_NTZ '2020-01-03 22:59:59' AS b"
    ).select(
        rint_to(F.col("x"), 2).alias("even"), clip(F.col("n"), 0, 1).alias("null"),
        clip(F.col("x") * 100, 0, 10).alias("high"), whole_days(F.col("a"), F.col("b")).alias("days"),
    ).first()
    assert (row["even"], row["null"], row["high"], row["days"]) == (0.12, None, 10.0, 1)
