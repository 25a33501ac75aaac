"""Time the headline analyses and print one JSON line.

Every query gets a workspace of its own, so its time includes all derived
tables it needs; nothing is carried over from the query before. One query runs
before the clock starts, as the first one in a session compiles code for all.
"""

from __future__ import annotations

import json
import os
import time

from rentlens import Workspace, build_session
from rentlens.functions.scalar import tidy
from rentlens.registry import PLANS
from rentlens.sources import from_star

HEADLINE = [
    "monthly_trend", "category_stats", "dayofweek_stats", "snapshot_kpis", "rental_fact",
    "customer_profiles", "segment_overview", "top_risk", "customer_table_risk_desc",
    "customer_timeline", "genre_preferences", "genre_transitions", "next_genre",
    "next_genre_films", "film_recommendations", "genre_cooccurrence", "top_bundles",
    "country_summary", "country_genre_pivot", "churn_bands", "top_churn", "customer_actions",
    "logistic_metrics", "customer_rentals", "customer_search", "customer_page_risk",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{root}/nation.parquet").write.format("noop").mode("overwrite").save()
    tidy(PLANS["dayofweek_stats"](Workspace(spark, from_star(spark, root)))).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        workspace = Workspace(spark, from_star(spark, root))
        tidy(PLANS[name](workspace)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds, cold derived tables",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": root.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
