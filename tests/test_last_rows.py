"""The last row of each customer from the ordered scan, and customers without a place."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from small import RENTALS, D, fact_rows, relations

from rentlens import Workspace
from rentlens.operators.sequences import last_rows, neighbour_scan, scanned_customers
from rentlens.plans import genres
from rentlens.sources import from_star


def _written(spark, tmp_path, frame):
    frame.write.parquet(str(tmp_path / "scan"))
    return spark.read.parquet(str(tmp_path / "scan"))


def test_last_rows_hold_the_last_of_each_customer(spark, tmp_path):
    """In many small batches, with ties, missing rental ids and one customer with most rows."""
    rng = random.Random(5)
    start = datetime(2020, 1, 1)
    rows = [
        (rng.choice([1] * 8 + list(range(2, 9))), start + timedelta(days=rng.randrange(4)), rng.choice([None, 1, 2]),
         rng.choice([None, "A", "B"]), 1, rng.randrange(5))
        for _ in range(600)
    ]
    frame = spark.createDataFrame(rows, "customer_id long, rental_date timestamp_ntz, rental_id long, category string, n_rows long, inventory_id long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    try:
        scan = _written(spark, tmp_path, neighbour_scan(frame))
    finally:
        spark.conf.unset(size)
    key = lambda r: (r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")
    got = {}
    for r in last_rows(scan).collect():
        row = (r.customer_id, start + timedelta(microseconds=r.at_us - 1577836800000000), r.rental_id, r.category)
        got.setdefault(r.customer_id, []).append((key(row), r.inventory_id))
    assert {r.customer_id for r in scanned_customers(scan).collect()} == {r[0] for r in rows} == set(got)
    for customer, found in got.items():
        mine = [(key(r), r[5]) for r in rows if r[0] == customer]
        last = max(k for k, _ in mine)
        assert {i for k, i in found if k == last} == {i for k, i in mine if k == last}
        assert max(k for k, _ in found) == last and len(found) < len(mine) / 2 + 60


def test_steps_and_last_rows_leave_out_customers_without_a_place(spark):
    more = [*RENTALS, (502, 5, 3, D(2020, 5, 9), timedelta(days=1), []), (601, None, 3, D(2020, 5, 9), None, [])]
    ws = Workspace(spark, relations(spark, more))
    rows = fact_rows([r for r in more if r[1] is not None])
    want = {}
    for a, b in zip(rows, rows[1:]):
        if a["customer"] == b["customer"]:
            want[a["category"], b["category"]] = want.get((a["category"], b["category"]), 0) + 1
    assert {(r["category"], r["next_category"]): r["count"] for r in genres.transitions(ws).collect()} == want
    last = {r["customer_id"]: (r["last_category"], r["last_film"], r["last_date"]) for r in genres.last_rentals(ws).collect()}
    assert last == {
        1: ("Action", "One", D(2020, 3, 5, 23, 30)), 2: ("Drama", "Five", D(2020, 3, 1, 12)),
        3: ("Action", "Two", D(2020, 2, 12, 7)), 4: ("Drama", "Six", D(2020, 3, 31, 20)),
    }


def test_rentals_meet_orders_payments_and_films_once(spark, monkeypatch):
    """Profiles, next genres and rented films start from one written table."""
    from rentlens.operators import fact
    from rentlens.plans import recommend

    made, build = [], fact.weighted_rentals
    monkeypatch.setattr(fact, "weighted_rentals", lambda rel: made.append(1) or build(rel))
    ws = Workspace(spark, from_star(spark, "/root/testdata/sf0.001"))
    recommend.next_genre_films(ws).count()
    found = recommend.film_recommendations(ws)
    assert made == [1]
    rented = recommend._rented(ws).select(F.col("customer_id"))
    assert "l_orderkey" not in rented._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0
