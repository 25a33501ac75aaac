"""The plans on hand-built rows, against a row-by-row computation."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from small import CATEGORIES, FILMS, fact_rows, relations

from rentlens import Workspace
from rentlens.functions import labels
from rentlens.plans import actions, churn, genres, overview, profiles, recommend, regions, segments


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(spark, relations(spark))


def test_fact_rows(ws):
    got = sorted(
        (r["customer_id"], r["rental_id"], r["category"], r["amount"] or 0, r["is_late_return"])
        for r in overview.rental_fact(ws).collect()
    )
    want = sorted(
        (r["customer"], r["rental"], r["category"], r["amount"] or 0, r["late"])
        for r in fact_rows()
    )
    assert got == want


def test_profile_measures(ws):
    got = {r["customer_id"]: r for r in profiles.profiles(ws).collect()}
    assert set(got) == {1, 2, 3, 4}
    for customer, row in got.items():
        mine = [r for r in fact_rows() if r["customer"] == customer]
        gaps = [(b["at"] - a["at"]).days for a, b in zip(mine, mine[1:])]
        counts = {}
        for r in mine:
            counts[r["category"]] = counts.get(r["category"], 0) + 1
        assert row["total_rentals"] == len(mine)
        assert row["total_spending"] == pytest.approx(sum(r["amount"] or 0 for r in mine))
        assert row["late_return_count"] == sum(bool(r["late"]) for r in mine)
        assert row["avg_days_overdue"] == pytest.approx(sum(r["overdue"] for r in mine) / len(mine))
        assert row["avg_rental_gap_days"] == pytest.approx(sum(gaps) / len(gaps) if gaps else 0)
        assert row["unique_genres"] == len(counts)
        assert row["top_genre"] == min(counts, key=lambda c: (-counts[c], c))
    assert got[2]["total_spending"] == 0.0
    assert got[3]["top_genre"] == "Action"  # tied with Comedy
    assert got[4]["days_since_last_rental"] == 0
    assert got[1]["avg_rentals_per_month"] == 2.5  # five rows, two calendar months apart


def test_return_on_the_limit_is_in_time(ws):
    rows = {r["rental_id"]: r["is_late_return"] for r in overview.rental_fact(ws).collect()}
    assert (rows[101], rows[102], rows[103]) == (False, True, None)


def test_transitions(ws):
    want = {}
    rows = fact_rows()
    for a, b in zip(rows, rows[1:]):
        if a["customer"] == b["customer"]:
            pair = (a["category"], b["category"])
            want[pair] = want.get(pair, 0) + 1
    got = genres.transitions(ws).collect()
    assert {(r["category"], r["next_category"]): r["count"] for r in got} == want
    sums = {}
    for r in got:
        sums[r["category"]] = sums.get(r["category"], 0) + r["prob"]
    assert all(total == pytest.approx(1) for total in sums.values())


def test_parts_add_up(ws):
    n = ws.size.customers
    assert sum(r["customers"] for r in segments.segment_overview(ws).collect()) == n
    assert sum(r["customers"] for r in segments.tier_breakdown(ws).collect()) == n
    assert len(segments.segment_overview(ws).collect()) == len(labels.SEGMENT_ORDER)
    assert sum(r["customers"] for r in churn.churn_bands(ws).collect()) == n
    assert len(overview.dayofweek_chart(ws).collect()) == 7


def test_shares_per_country(ws):
    sums = {}
    for r in regions.country_genre_share(ws).collect():
        sums[r["country"]] = sums.get(r["country"], 0) + r["share"]
    assert set(sums) == {"Norway", "Italy"}
    assert all(total == pytest.approx(100, abs=0.5) for total in sums.values())


def test_cooccurrence_is_bounded_and_symmetric(ws):
    sizes = {
        r["category"]: r["n"]
        for r in genres.genre_preferences(ws).groupBy("category").agg(F.count("*").alias("n")).collect()
    }
    pairs = {
        (r["genre_a"], r["genre_b"]): r["customers"]
        for r in genres.cooccurrence_matrix(ws).collect()
    }
    for (a, b), n in pairs.items():
        assert n == pairs[(b, a)] and n <= min(sizes[a], sizes[b])
        assert a != b or n == 0
    assert len(genres.top_bundles(ws).collect()) == 3


@pytest.mark.parametrize("mode", ["observed", "preference"])
def test_recommendations(ws, mode):
    names = dict(CATEGORIES)
    risky = {r["customer_id"]: r["is_high_risk"] for r in profiles.profiles(ws).collect()}
    got = {}
    for r in recommend.film_recommendations(ws, rank_mode=mode).orderBy("customer_id", "position").collect():
        got.setdefault(r["customer_id"], []).append((r["category"], r["film_id"]))
    for customer, high in risky.items():
        mine = [r for r in fact_rows() if r["customer"] == customer]
        rented = {r["film"] for r in mine}
        counts = {}
        for r in mine:
            counts[r["category"]] = counts.get(r["category"], 0) + 1
        order = sorted(counts) if mode == "observed" else sorted(counts, key=lambda c: (-counts[c], c))
        rank = {c: i for i, c in enumerate(order)}
        offers = []
        for category in {names[c] for f in FILMS for c in f[4]}:
            free = [f for f in FILMS if f[0] not in rented and category in [names[c] for c in f[4]]]
            free.sort(key=lambda f: (f[2], float(f[3]), f[0]) if high else (-float(f[3]), f[0]))
            offers += [(rank.get(category, 999), category, k, f[0]) for k, f in enumerate(free[:2])]
        want = [(c, f) for _, c, _, f in sorted(offers)][:12]
        assert got.get(customer, []) == want
        assert not rented & {f for _, f in want}


def test_next_genre_films_are_unrented(ws):
    rented = {(r["customer"], r["film"]) for r in fact_rows()}
    rows = recommend.next_genre_films(ws).collect()
    assert rows and not rented & {(r["customer_id"], r["film_id"]) for r in rows}


def test_churn_band_edges(spark):
    scores = [(0.0, None), (0.001, "Low Churn Risk"), (0.33, "Low Churn Risk"),
              (0.331, "Medium Churn Risk"), (0.66, "Medium Churn Risk"), (1.0, "High Churn Risk")]
    df = spark.createDataFrame([(s,) for s, _ in scores], "s double")
    assert [r["b"] for r in df.select(churn.band(F.col("s")).alias("b")).collect()] == [b for _, b in scores]


def test_search(ws):
    find = lambda **q: [r["customer_id"] for r in segments.customer_search(ws, **q).collect()]
    assert find(name="ANN") == [1]
    assert find(name="^[bc]") == [2, 3]
    assert find(customer_id="4") == [4]
    assert find(name="ann", customer_id="4") == []
    assert find(customer_id="x") == [1, 2, 3, 4]
    with pytest.raises(Exception):
        find(name="(")


def test_every_customer_gets_a_card_per_tier(ws):
    rows = actions.customer_actions(ws).collect()
    assert {(r["customer_id"], r["tier"]) for r in rows} == {
        (c, t) for c in (1, 2, 3, 4) for t in labels.TIERS
    }
    assert not [r for r in rows if r["body"] is None]


def test_last_rental_breaks_ties_by_id(ws):
    rows = {r["customer_id"]: r for r in genres.last_rentals(ws).collect()}
    assert rows[4]["last_category"] == "Drama" and rows[4]["last_film"] == "Six"
    assert rows[1]["last_date"] == datetime(2020, 3, 5, 23, 30)


def test_amounts_with_more_than_two_decimals_are_refused(spark):
    from dataclasses import replace

    rel = relations(spark)
    fine = replace(rel, payment=rel.payment.withColumn("amount", F.lit("1.005").cast("decimal(9,3)")))
    with pytest.raises(ValueError):
        overview.dayofweek_stats(Workspace(spark, fine))


def test_missing_column_is_reported(spark):
    from dataclasses import replace

    rel = relations(spark)
    with pytest.raises(ValueError, match="payment"):
        replace(rel, payment=rel.payment.drop("amount"))


def test_parquet_round_trip(spark, tmp_path):
    from dataclasses import fields

    from rentlens.sources import from_parquet, write_result

    rel = relations(spark)
    for field in fields(rel):
        write_result(getattr(rel, field.name), str(tmp_path / field.name))
    again = Workspace(spark, from_parquet(spark, str(tmp_path)))
    again.relations.register_views()
    assert spark.sql("SELECT count(*) AS n FROM rental").first()["n"] == rel.rental.count()
    assert again.size.customers == 4
