"""The customer profile: measures, risk score, spending tier, RFM segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.functions.scalar import (
    DAY_US, clip, month_key, month_number, rint_to, seeded_normal, whole_days,
)
from rentlens.operators import fact
from rentlens.operators.quantiles import exact_quantiles

PROFILE_COLUMNS = [
    "customer_id", "full_name", "city", "country", "active", "total_rentals", "total_spending",
    "last_rental_date", "first_rental_date", "late_return_count", "avg_days_overdue",
    "weekend_rentals", "avg_spend_per_rental", "late_return_rate", "days_since_last_rental",
    "customer_tenure_days", "pct_weekend", "avg_rentals_per_month", "avg_rental_gap_days",
    "unique_genres", "top_genre", "genre_diversity", "risk_score", "is_high_risk",
    "spending_tier", "rfm_segment",
]
NOISE_SEED, NOISE_SIGMA = 42, 0.03


def customer_genre_measures(ws) -> DataFrame:
    """Reduce the fact to (customer, category) in one aggregation.

    Map-side combining makes a hot customer a handful of rows per task; names
    and places join afterwards, at the reduced grain. Every row is one customer of
    that category, so distinct customers are counted by counting rows.
    """
    sums = [F.sum(c).cast("decimal(38,0)" if name == "overdue_us" else "long").alias(name) for name, c in fact.summands().items()]
    return (
        ws.genre_rows
        .groupBy("customer_id", "category")
        .agg(*sums, F.min("rental_date").alias("first_date"), F.max("rental_date").alias("last_date"))
    )


def customer_month_measures(ws) -> DataFrame:
    """Reduce the rentals to (customer, month): every row is one customer of that month.

    ``genres`` is the number of the film's categories, that is, of fact rows of a rental.
    """
    rel = ws.relations
    genres = fact.copy_terms(rel).groupBy("inventory_id").agg(F.count(F.lit(1)).alias("genres"))
    copies = fact.copy_allowance(rel).join(genres, "inventory_id", "left").fillna(0, ["genres"])
    cents, late = F.coalesce("cents", F.lit(0)), fact.late_rows()
    return (
        ws.rentals.join(copies, "inventory_id")
        .groupBy("customer_id", month_key(F.col("rental_date")).alias("month"))
        .agg(
            F.sum("n_rows").alias("rentals"), F.sum("cents").alias("cents"), F.sum(late).alias("late"),
            F.sum(F.col("n_rows") * F.col("genres")).alias("fact_rows"),
            F.sum(cents * F.col("genres")).alias("fact_cents"),
            F.sum(late * F.col("genres")).alias("fact_late"),
        )
    )


def profile_measures(ws) -> DataFrame:
    """Everything in the profile that does not depend on other customers.

    The measures by category are added up before they meet the places: a row per customer
    is joined, not one per category. A customer with several places has its measures as
    often in ``customer_genre``, and so in these sums.
    """
    places = ws.places.drop("email").withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("customer_id")))
    totals = ws.every_customer_genre().groupBy("customer_id").agg(
        F.sum("rentals").alias("rentals"),
        F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        F.max("last_date").alias("last_rental_date"),
        F.min("first_date").alias("first_rental_date"),
        F.sum("late").alias("late"),
        F.sum("overdue_us").alias("overdue_us"),
        F.sum("weekend").alias("weekend"),
        F.count(F.lit(1)).alias("genres"),
        # Most rows first, then the alphabetically first category.
        F.min(F.struct((-F.col("rentals")).alias("n"), "category")).alias("top"),
    )
    gaps = ws.customer_gaps
    n = F.col("total_rentals")
    months = F.greatest(
        month_number(F.col("last_rental_date")) - month_number(F.col("first_rental_date")),
        F.lit(1),
    )
    times = F.col("times")
    overdue = (F.col("overdue_us") * times).cast("double")
    return (
        totals.join(places, "customer_id")
        .join(gaps, "customer_id", "left")
        .withColumns({
            "total_rentals": F.col("rentals") * times,
            "total_spending": fact.dollars(F.col("cents") * times),
            "late_return_count": F.col("late") * times,
            "avg_days_overdue": overdue / (F.col("rentals") * times) / F.lit(float(DAY_US)),
            "weekend_rentals": F.col("weekend") * times,
            "unique_genres": F.col("genres") * times,
        })
        .select(
            "customer_id", "full_name", "city", "country", "active", "total_rentals",
            "total_spending", "last_rental_date", "first_rental_date", "late_return_count",
            "avg_days_overdue", "weekend_rentals",
            (F.col("total_spending") / n).alias("avg_spend_per_rental"),
            rint_to(F.col("late_return_count") / n, 4).alias("late_return_rate"),
            rint_to(F.col("weekend_rentals") / n * 100, 1).alias("pct_weekend"),
            rint_to(n / months, 2).alias("avg_rentals_per_month"),
            F.when(n > 1, F.coalesce("gap_days", F.lit(0)) / (n - 1)).alias("gap"),
            "unique_genres",
            F.coalesce("top.category", F.lit("Unknown")).alias("top_genre"),
            rint_to(F.col("unique_genres") / n, 4).alias("genre_diversity"),
        )
    )


def _risk(noise: str) -> Column:
    score = (
        F.col("late_return_rate") * 0.5
        + clip(F.col("avg_days_overdue"), 0, 10) / 10 * 0.3
        + clip(F.coalesce("gap", F.lit(30.0)), 0, 60) / 60 * 0.2
    )
    if noise == "hash":
        score = score + seeded_normal(F.col("customer_id"), NOISE_SEED, NOISE_SIGMA)
    elif noise != "none":
        raise ValueError(f"noise must be 'none' or 'hash', not {noise!r}")
    return clip(score, 0, 1)


def _scored(ws, noise: str) -> DataFrame:
    today = ws.extent.today_column
    return ws.profile_base.select(
        "*",
        whole_days(F.col("last_rental_date"), today).alias("days_since_last_rental"),
        whole_days(F.col("first_rental_date"), today).alias("customer_tenure_days"),
        _risk(noise).alias("risk_score"),
    )


def thresholds(ws, noise: str | None = None) -> dict[tuple[str, float], float]:
    """Global cut-offs: scalars over all customers, computed once."""
    noise = noise or ws.noise
    key = ("thresholds", noise)
    if key not in ws.memo:
        ws.memo[key] = exact_quantiles(
            _scored(ws, noise),
            {
                "total_spending": [0.25, 0.5, 0.75],
                "days_since_last_rental": [0.5],
                "total_rentals": [0.5],
                "risk_score": [0.55],
            },
        )
    return ws.memo[key]


def profiles(ws, noise: str | None = None) -> DataFrame:
    """One row per customer with all profile columns; the risk score has the workspace's noise unless another is asked for."""
    noise = noise or ws.noise
    cut = thresholds(ws, noise)
    spend = F.col("total_spending")
    tier = F.lit(labels.TIER_ORDER[-1])
    for p, name in reversed(list(zip((0.25, 0.5, 0.75), labels.TIER_ORDER, strict=False))):
        tier = F.when(spend <= F.lit(cut[("total_spending", p)]), name).otherwise(tier)
    points = (
        (F.col("days_since_last_rental") <= F.lit(cut[("days_since_last_rental", 0.5)])).cast("int")
        + (F.col("total_rentals") >= F.lit(cut[("total_rentals", 0.5)])).cast("int")
        + (spend >= F.lit(cut[("total_spending", 0.5)])).cast("int")
    )
    segment = F.element_at(F.array(*[F.lit(s) for s in labels.SEGMENTS_BY_SCORE]), points + 1)
    return _scored(ws, noise).select(
        "*",
        F.coalesce("gap", F.lit(0.0)).alias("avg_rental_gap_days"),
        (F.col("risk_score") > F.lit(cut[("risk_score", 0.55)])).alias("is_high_risk"),
        tier.alias("spending_tier"),
        segment.alias("rfm_segment"),
    ).select(*PROFILE_COLUMNS)
