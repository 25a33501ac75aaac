"""What is exchanged of rentals for the recommendations."""

from __future__ import annotations

from small import relations

from rentlens import Workspace
from rentlens.plans import recommend
from rentlens.plans.profiles import profiles


def test_a_rented_copy_goes_on_once_with_the_position_of_the_customers_class(spark, monkeypatch):
    seen, ws = [], Workspace(spark, relations(spark))
    given = recommend.taken_before
    monkeypatch.setattr(recommend, "taken_before", lambda rows, *args: seen.append(rows) or given(rows, *args))
    recommend.film_recommendations(ws, "preference").count()
    high = {r.customer_id: r.is_high_risk for r in profiles(ws).collect()}
    films = [f.asDict() for f in recommend.film_positions(ws).collect()]
    rented = {(r.customer_id, r.inventory_id // 10) for r in ws.rented_copies.collect() if r.customer_id in high}
    want = [(c, f["category"], high[c], f["cautious" if high[c] else "standard"]) for c, film in rented for f in films if f["film_id"] == film]
    assert len(set(high.values())) == 2
    assert sorted((r.customer_id, r.category, r.is_high_risk, r.place) for r in seen[0].collect()) == sorted(want)
