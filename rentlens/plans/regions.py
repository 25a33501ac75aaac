"""Countries: customers, spending, genre mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions.scalar import fixed_avg, rint_to
from rentlens.plans.profiles import profiles


def country_summary(ws) -> DataFrame:
    return (
        profiles(ws).where(F.col("country").isNotNull()).groupBy("country")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            fixed_avg("total_spending", 2).alias("avg_spending"),
            fixed_avg("late_return_rate", 4).alias("avg_late"),
            F.count(F.when(F.col("is_high_risk"), 1)).alias("high_risk"),
        )
        .orderBy(F.desc("customers"), "country")
    )


def country_genre_share(ws) -> DataFrame:
    """Share of each category within a country's fact rows, in percent."""
    counts = (
        ws.customer_genre_rows.where(F.col("country").isNotNull())
        .groupBy("country", "category").agg(F.sum("rentals").alias("rentals"))
    )
    total = F.sum("rentals").over(Window.partitionBy("country"))
    return counts.withColumn("share", rint_to(F.col("rentals") / total * 100, 1))


def country_genre_pivot(ws) -> DataFrame:
    """One row per country, one column per category, absent ones 0.

    The category names become columns, so they are the one list that has to
    be known before the plan is built.
    """
    names = [
        row["category"]
        for row in ws.customer_genre.select("category").distinct().orderBy("category").collect()
    ]
    return (
        country_genre_share(ws).groupBy("country").pivot("category", names)
        .agg(F.first("share")).fillna(0.0, subset=names)
    )


def country_top_genre(ws) -> DataFrame:
    """The category with the largest rounded share, alphabetically first on ties."""
    best = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("share"), "category"))
    top = (
        country_genre_share(ws).withColumn("k", best).where("k = 1")
        .select("country", F.col("category").alias("top_genre"), "share")
    )
    return (
        top.join(country_summary(ws).select("country", "customers"), "country")
        .orderBy(F.desc("customers"), "country")
    )
