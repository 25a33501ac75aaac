"""Churn scores, bands and revenue at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.functions.scalar import clip, fixed_avg, named_rows, rint_to
from rentlens.plans.profiles import profiles

COUNTRIES_SHOWN, CUSTOMERS_SHOWN = 15, 10
BOTTOM_EDGE = 0.0


def churn_scores(ws, variant: str = "observed") -> DataFrame:
    """Profiles with churn score and band.

    ``observed`` subtracts only the scaled rental share from 1, which keeps
    every score high; ``intended`` scales the whole complement.
    """
    share = F.col("total_rentals") / F.lit(float(ws.extent.max_rentals))
    if variant == "observed":
        activity = F.lit(1.0) - share * 0.25
    elif variant == "intended":
        activity = (F.lit(1.0) - share) * 0.25
    else:
        raise ValueError(f"variant must be 'observed' or 'intended', not {variant!r}")
    weight = F.lit(None).cast("double")
    for segment, value in labels.CHURN_WEIGHTS.items():
        weight = F.when(F.col("rfm_segment") == segment, F.lit(value)).otherwise(weight)
    recency = F.try_divide(
        F.col("days_since_last_rental").cast("double"), F.lit(float(ws.extent.max_days_since))
    )
    score = rint_to(clip(recency * 0.6 + activity + weight * 0.15, 0, 1), 3)
    return profiles(ws).withColumn("churn_score", score).withColumn(
        "churn_risk_label", band(F.col("churn_score"))
    )


def band(score):
    """Intervals open at the lower end: the bottom edge itself has no band."""
    label = F.lit(None).cast("string")
    for upper, name in reversed(labels.CHURN_BANDS):
        label = F.when(score <= upper, name).otherwise(label)
    return F.when(score > BOTTOM_EDGE, label)


def _revenue():
    return F.sum(F.col("total_spending").cast("decimal(18,2)")).cast("double")


def churn_score_list(ws, variant: str = "observed") -> DataFrame:
    return churn_scores(ws, variant).select(
        "customer_id", "rfm_segment", "days_since_last_rental", "total_rentals",
        "churn_score", "churn_risk_label",
    )


def churn_bands(ws, variant: str = "observed") -> DataFrame:
    stats = churn_scores(ws, variant).groupBy("churn_risk_label").agg(
        F.count(F.lit(1)).alias("n"), _revenue().alias("spent")
    )
    return (
        named_rows(ws.spark, "churn_risk_label", labels.CHURN_ORDER)
        .join(stats, "churn_risk_label", "left")
        .select(
            "position", "churn_risk_label", F.coalesce("n", F.lit(0)).alias("customers"),
            F.coalesce("spent", F.lit(0.0)).alias("revenue"),
        )
        .orderBy("position")
    )


def churn_by_segment(ws, variant: str = "observed") -> DataFrame:
    return (
        churn_scores(ws, variant).groupBy("rfm_segment")
        .agg(fixed_avg("churn_score", 3).alias("avg_churn_score"))
        .orderBy(F.desc("avg_churn_score"), "rfm_segment")
    )


def _high(ws, variant: str) -> DataFrame:
    return churn_scores(ws, variant).where(F.col("churn_risk_label") == labels.CHURN_ORDER[0])


def churn_revenue_by_country(
    ws, variant: str = "observed", limit: int = COUNTRIES_SHOWN
) -> DataFrame:
    """The countries with most spending by high-churn customers."""
    largest = (
        _high(ws, variant).where(F.col("country").isNotNull())
        .groupBy("country").agg(_revenue().alias("revenue_at_risk"))
        .orderBy(F.desc("revenue_at_risk"), "country").limit(limit)
    )
    return largest.orderBy("revenue_at_risk", F.desc("country"))


def revenue_at_risk(ws, variant: str = "observed") -> DataFrame:
    return _high(ws, variant).agg(
        F.coalesce(_revenue(), F.lit(0.0)).alias("revenue_at_risk")
    )


def top_churn(ws, variant: str = "observed", limit: int = CUSTOMERS_SHOWN) -> DataFrame:
    return (
        churn_scores(ws, variant)
        .orderBy(F.desc("churn_score"), "customer_id").limit(limit)
        .select(
            "customer_id", "full_name", "city", "country", "rfm_segment",
            "days_since_last_rental", "total_rentals", "total_spending",
            "churn_score", "churn_risk_label",
        )
    )
