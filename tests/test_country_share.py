"""Genre mix of countries."""

from __future__ import annotations

from rentlens import Workspace
from rentlens.plans import regions
from rentlens.sources import from_star

ROOT = "/root/testdata/sf0.01"


def test_country_share_writes_no_rows_per_customer(spark):
    ws = Workspace(spark, from_star(spark, ROOT))
    alone = regions.country_genre_share(ws).collect()
    assert not ws._kept
    ws.customer_genre.count()
    assert sorted(map(tuple, regions.country_genre_share(ws).collect())) == sorted(map(tuple, alone))
