"""Business snapshot: counts, KPIs, trends by month, category and weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.functions.scalar import DAY_US, day_of_week, day_type, named_rows
from rentlens.operators import fact
from rentlens.workspace import customer_bucket


def rental_fact(ws) -> DataFrame:
    return fact.rental_fact(ws.relations)


def customer_rentals(ws, customer_id: int) -> DataFrame:
    """One customer's fact rows, in order of date, at the cost of that customer.

    Only the folder with the customer's bucket is read, and of its files the row groups
    that can hold the customer.
    """
    wanted = F.lit(customer_id).cast(ws.facts_by_customer.schema["customer_id"].dataType)
    own = ws.facts_by_customer.where((F.col("bucket") == customer_bucket(wanted)) & (F.col("customer_id") == wanted))
    return fact.described(ws.relations, own.drop("bucket")).orderBy("rental_date", "rental_id", "category")


def rentals_per_city(ws, country: str) -> DataFrame:
    """Rentals and renting customers per city of a country, stated in SQL."""
    return ws.query(
        """
        SELECT ci.city, count(*) AS rentals, count(DISTINCT r.customer_id) AS customers
        FROM rental r JOIN customer c ON r.customer_id = c.customer_id
        JOIN address a ON c.address_id = a.address_id
        JOIN city ci ON a.city_id = ci.city_id
        JOIN country co ON ci.country_id = co.country_id
        WHERE co.country = :country
        GROUP BY ci.city
        """,
        {"country": country},
    )


def film_catalogue(ws) -> DataFrame:
    return fact.film_catalogue(ws.relations).orderBy("film_id", "category")


def dataset_counts(ws) -> DataFrame:
    """Customers, catalogue rows and fact rows."""
    rel = ws.relations
    films = (
        rel.film.select("film_id").join(rel.film_category, "film_id")
        .join(rel.category.select("category_id"), "category_id")
        .agg(F.count(F.lit(1)).alias("films"))
    )
    return films.select(
        F.lit(ws.size.customers).cast("long").alias("customers"), "films",
        F.lit(ws.size.rows).cast("long").alias("rentals"),
    )


def value_lists(ws) -> DataFrame:
    """All categories and all countries that occur, for use as filter values."""
    genres = ws.customer_genre.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    places = (
        ws.customer_genre.where(F.col("country").isNotNull())
        .select(F.lit("country").alias("kind"), F.col("country").alias("value"))
    )
    return genres.unionByName(places).distinct().orderBy("kind", "value")


def snapshot_kpis(ws) -> DataFrame:
    totals = ws.customer_genre.agg(
        fact.dollars(F.sum("cents")).alias("total_revenue"),
        F.sum("rentals").alias("total_rentals"),
        F.sum("late").alias("late_returns"),
        F.sum("returned").alias("returned_rentals"),
    )
    active = (
        ws.places.join(ws.customer_genre, "customer_id", "left_semi")
        .agg(F.sum("active").alias("active_customers")).scalar()
    )
    customers = F.lit(ws.size.customers).cast("long")
    return totals.select(
        customers.alias("total_customers"), "total_revenue", "total_rentals",
        (F.col("total_revenue") / customers).alias("revenue_per_customer"),
        active.alias("active_customers"), "late_returns", "returned_rentals",
        F.when(
            F.col("returned_rentals") > 0,
            F.col("late_returns") / F.col("returned_rentals") * 100,
        ).otherwise(0.0).alias("late_return_pct"),
    )


def monthly_trend(ws) -> DataFrame:
    return (
        ws.customer_month.groupBy("month")
        .agg(
            F.sum("rentals").alias("rentals"),
            F.count("customer_id").alias("unique_customers"),
            fact.dollars(F.sum("cents")).alias("revenue"),
            F.sum("late").alias("late_returns"),
        )
        .orderBy("month")
    )


def peak_month(ws) -> DataFrame:
    """The month with most rentals, the earliest one on a tie."""
    return (
        monthly_trend(ws).select("month", "rentals")
        .orderBy(F.desc("rentals"), "month").limit(1)
    )


def category_stats(ws) -> DataFrame:
    return (
        ws.all_customer_genre.groupBy("category")
        .agg(
            F.sum("rentals").alias("rentals"),
            F.count("customer_id").alias("unique_customers"),
            fact.dollars(F.sum("cents")).alias("revenue"),
            F.try_divide(fact.dollars(F.sum("cents")), F.sum("paid")).alias("avg_payment"),
            F.sum("late").alias("late_count"),
            (F.sum("overdue_us").cast("double") / F.sum("rentals") / F.lit(float(DAY_US)))
            .alias("avg_overdue_days"),
        )
        .orderBy(F.desc("rentals"), "category")
    )


def category_revenue(ws) -> DataFrame:
    return category_stats(ws).select("category", "revenue").orderBy("revenue", "category")


def category_late_rate(ws) -> DataFrame:
    """Late rows as a share of all rows, not only of returned ones."""
    return category_stats(ws).select(
        "category", "rentals", "late_count",
        (F.col("late_count") / F.col("rentals") * 100).alias("late_rate"),
    ).orderBy("late_rate", "category")


def dayofweek_stats(ws) -> DataFrame:
    when = F.col("rental_date")
    return (
        ws.rentals
        .groupBy(
            day_of_week(when).alias("dow_num"),
            F.date_format(when, "EEE").alias("day_label"),
            day_type(when).alias("day_type"),
        )
        .agg(F.sum("n_rows").alias("rentals"), fact.dollars(F.sum("cents")).alias("revenue"))
        .orderBy("dow_num")
    )


def dayofweek_chart(ws) -> DataFrame:
    """Monday to Sunday; a weekday without rentals stays, with NULLs."""
    days = named_rows(ws.spark, "day_label", labels.DAY_ORDER)
    return (
        days.join(dayofweek_stats(ws), "day_label", "left")
        .select("position", "day_label", "day_type", "rentals", "revenue")
        .orderBy("position")
    )
