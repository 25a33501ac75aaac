"""Late-return risk read from the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions.scalar import rint_to
from rentlens.plans.profiles import profiles

CUSTOMERS_SHOWN = 10


def risk_split(ws) -> DataFrame:
    customers = profiles(ws).agg(
        F.count(F.when(F.col("is_high_risk"), 1)).alias("high_risk"),
        F.count(F.lit(1)).alias("customers"),
    )
    return customers.select(
        "high_risk", (F.col("customers") - F.col("high_risk")).alias("low_risk"),
        F.try_divide(F.col("high_risk") * 100.0, F.col("customers")).alias("high_risk_pct"),
    )


def risk_by_segment(ws) -> DataFrame:
    return (
        profiles(ws).groupBy("rfm_segment")
        .agg((F.avg(F.col("is_high_risk").cast("int")) * 100).alias("high_risk_pct"))
        .orderBy("high_risk_pct", "rfm_segment")
    )


def top_risk(ws, limit: int = CUSTOMERS_SHOWN) -> DataFrame:
    """The high-risk customers with the highest scores, rounded for display."""
    return (
        profiles(ws).where("is_high_risk")
        .orderBy(F.desc("risk_score"), "customer_id").limit(limit)
        .select(
            "customer_id", "full_name", "city", "country", "total_rentals", "late_return_count",
            rint_to(F.col("late_return_rate") * 100, 1).alias("late_return_pct"),
            rint_to(F.col("avg_days_overdue"), 1).alias("avg_days_overdue"),
            "total_spending", "rfm_segment", rint_to(F.col("risk_score"), 3).alias("risk_score"),
        )
    )
