"""Measures by category from the ordered scan."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from small import relations

from rentlens import Workspace
from rentlens.operators.sequences import category_measures, neighbour_scan
from rentlens.plans import profiles
from rentlens.sources import from_star

ROOT = "/root/testdata/sf0.01"


def test_measures_of_the_scan_are_those_of_a_grouping(spark, tmp_path):
    """In many small batches, with nulls, sums beyond a long and one customer with most rows."""
    rng = random.Random(7)
    start = datetime(2020, 1, 1)
    rows = [
        (rng.choice([1] * 8 + list(range(2, 9))), start + timedelta(hours=rng.randrange(400)), rng.choice([None, 1, 2]),
         rng.choice([None, "A", "B"]), rng.randrange(1, 4), rng.choice([None, None, 7]))
        for _ in range(600)
    ]
    frame = spark.createDataFrame(rows, "customer_id long, rental_date timestamp_ntz, rental_id long, category string, n_rows long, cents long")
    sums = {"rentals": F.col("n_rows"), "cents": F.col("cents"), "huge": F.col("n_rows").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)")}
    sums["huge"] = sums["huge"].cast("decimal(38,0)")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    try:
        neighbour_scan(frame, sums).write.parquet(str(tmp_path / "scan"))
    finally:
        spark.conf.unset(size)
    got = category_measures(spark.read.parquet(str(tmp_path / "scan")))
    want = frame.groupBy("customer_id", "category").agg(
        *[F.sum(c).cast("decimal(38,0)" if n == "huge" else "long").alias(n) for n, c in sums.items()],
        F.min("rental_date").alias("first_date"), F.max("rental_date").alias("last_date"),
    )
    assert got.dtypes == want.dtypes
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert max(r.huge for r in want.collect()) > 2**63


def test_profiles_write_no_rentals_and_no_rows_per_country(spark):
    ws = Workspace(spark, from_star(spark, ROOT))
    ws.profile_base  # noqa: B018
    assert not {"genre_rentals", "customer_genre", "all_customer_genre", "ordered_steps_all"} & ws._kept.keys()
    plain = Workspace(spark, from_star(spark, ROOT))
    plain.all_customer_genre.count()
    both = [w.customer_genre for w in (ws, plain)]
    assert both[0].dtypes == both[1].dtypes
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()


def test_a_customer_with_two_places_counts_twice(spark):
    rel = relations(spark)
    rel = replace(rel, customer=rel.customer.unionByName(rel.customer.where("customer_id = 1")))
    ws = Workspace(spark, rel)
    found = profiles.profile_measures(_scanned(ws)).where("customer_id = 1").collect()
    totals = ws.customer_genre.where("customer_id = 1").agg(F.sum("rentals"), F.sum("late"), F.count("*")).first()
    assert len(found) == 2
    assert {(r.total_rentals, r.late_return_count, r.unique_genres) for r in found} == {tuple(totals)}


def _scanned(ws):
    ws.scan_once()
    return ws
