"""Names of the analyses, as offered by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from rentlens import increments
from rentlens.plans import (
    actions, churn, genres, models, overview, profiles, recommend, regions, risk, segments,
)
from rentlens.sources import write_result

Plan = Callable[..., DataFrame]


def written(ws, plan: Plan, folder: str, partition_by: list[str] | None = None) -> DataFrame:
    """What a reader finds after a result has been written."""
    path = f"{ws._folder}/written/{folder}"
    write_result(plan(ws), path, partition_by, mode="overwrite")
    return ws.spark.read.parquet(path)


PLANS: dict[str, Plan] = {
    "monthly_trend": overview.monthly_trend,
    "peak_month": overview.peak_month,
    "rental_fact": overview.rental_fact,
    "customer_rentals": partial(overview.customer_rentals, customer_id=42),
    "rentals_per_city": partial(overview.rentals_per_city, country="NATION_7"),
    "film_catalogue": overview.film_catalogue,
    "dataset_counts": overview.dataset_counts,
    "value_lists": overview.value_lists,
    "category_stats": overview.category_stats,
    "category_revenue": overview.category_revenue,
    "category_late_rate": overview.category_late_rate,
    "dayofweek_stats": overview.dayofweek_stats,
    "dayofweek_chart": overview.dayofweek_chart,
    "snapshot_kpis": overview.snapshot_kpis,
    "customer_profiles": profiles.profiles,
    "customer_profiles_noisy": partial(profiles.profiles, noise="hash"),
    "customer_profiles_plain": partial(profiles.profiles, noise="none"),
    "customer_profiles_by_parts": increments.profiles_by_parts,
    "segment_overview": segments.segment_overview,
    "customer_table_written": partial(
        written, plan=segments.customer_table, folder="customers", partition_by=["rfm_segment"]
    ),
    "tier_breakdown": segments.tier_breakdown,
    "tier_breakdown_filtered": partial(
        segments.tier_breakdown, segments=["Champions", "Loyal"], high_risk=True,
        countries=["NATION_1", "NATION_2", "NATION_3"],
    ),
    "segment_recency": segments.segment_recency,
    "segment_value": segments.segment_value,
    **{
        f"customer_table_{order}": partial(segments.customer_table, order=order)
        for order in segments.TABLE_ORDERS
    },
    "customer_search": partial(segments.customer_search, name="building customer#0000000.1"),
    "customer_search_segment": partial(segments.customer_search, name="^building "),
    "customer_search_either": partial(
        segments.customer_search, name="machinery customer#00000001.$|household.*#0000002"
    ),
    "customer_search_no_gram": partial(segments.customer_search, name="[be]u?.*1.$"),
    "customer_page_first": partial(segments.customer_page, page=0, size=40),
    "customer_page_risk": partial(segments.customer_page, page=2, size=50, order="risk_desc"),
    "customer_by_id": partial(segments.customer_search, customer_id="42"),
    "return_split": segments.return_split,
    "risk_split": risk.risk_split,
    "risk_by_segment": risk.risk_by_segment,
    "top_risk": risk.top_risk,
    "customer_timeline": genres.customer_timeline,
    "genre_preferences": genres.genre_preferences,
    "genre_spend": genres.genre_spend,
    "genre_transitions": genres.genre_transitions,
    "next_genre": genres.next_genre,
    "next_genre_preference": partial(genres.next_genre, rank_mode="preference"),
    "next_genre_films": recommend.next_genre_films,
    "film_recommendations": recommend.film_recommendations,
    "film_recommendations_preference": partial(
        recommend.film_recommendations, rank_mode="preference"
    ),
    "genre_cooccurrence": genres.cooccurrence_matrix,
    "top_bundles": genres.top_bundles,
    "country_summary": regions.country_summary,
    "country_genre_share": regions.country_genre_share,
    "country_genre_pivot": regions.country_genre_pivot,
    "country_top_genre": regions.country_top_genre,
    **{
        f"{name}{suffix}": partial(plan, variant=variant)
        for variant, suffix in (("observed", ""), ("intended", "_intended"))
        for name, plan in {
            "churn_scores": churn.churn_score_list,
            "churn_bands": churn.churn_bands,
            "churn_by_segment": churn.churn_by_segment,
            "churn_revenue_by_country": churn.churn_revenue_by_country,
            "top_churn": churn.top_churn,
            "revenue_at_risk": churn.revenue_at_risk,
        }.items()
    },
    "customer_actions": actions.customer_actions,
    "segment_actions": actions.segment_actions,
    "next_genre_actions": actions.next_genre_actions,
    "churn_actions": actions.churn_actions,
    "risk_model_metrics": models.model_metrics,
    "risk_feature_importance": models.feature_importance,
    "confusion_matrix": models.confusion_matrix,
    "classification_report": models.classification_report,
    "best_model": models.best_model,
    **{
        f"logistic_{name}": partial(plan, names=[models.DEFAULT_MODEL])
        for name, plan in {
            "metrics": models.model_metrics, "importance": models.feature_importance,
            "confusion": models.confusion_matrix, "report": models.classification_report,
            "scores": models.risk_scores, "contributions": models.risk_contributions,
        }.items()
    },
    "risk_scores": models.risk_scores,
    "risk_contributions": models.risk_contributions,
    "top_drivers": models.top_drivers,
    "risk_actions": models.risk_actions,
}
