"""The rental fact, at two grains.

``rental_fact`` is the joined row set: one row per rental, category and
payment. ``weighted_rentals`` carries the same information with payments
folded into a row weight, so a rental with many payments stays one row and
the payment side is pre-aggregated before it meets the rentals.

No join carries a broadcast hint. Catalyst broadcasts a side only when
its size statistics (or, under AQE, its measured size) are below the session's
threshold, and splits skewed partitions of the larger side otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.functions.scalar import DAY_US, day_of_week, day_type, elapsed_us, month_key
from rentlens.sources.relations import Relations


def film_catalogue(rel: Relations) -> DataFrame:
    """Films with their category; a film in several categories repeats."""
    return (
        rel.film.join(rel.film_category, "film_id")
        .join(rel.category.withColumnRenamed("name", "category"), "category_id")
        .select(
            "film_id", "title", "description", "release_year", "rental_duration",
            F.col("rental_rate").cast("double").alias("rental_rate"), "length",
            F.col("rating").cast("string").alias("rating"),
            F.col("replacement_cost").cast("double").alias("replacement_cost"), "category",
        )
    )


def copy_terms(rel: Relations) -> DataFrame:
    """Per inventory copy and category: the film and the allowed days."""
    return (
        rel.inventory.join(rel.film.select("film_id", "rental_duration"), "film_id")
        .join(rel.film_category, "film_id")
        .join(rel.category, "category_id")
        .select(
            "inventory_id", "film_id",
            F.col("rental_duration").alias("allowed_days"), F.col("name").alias("category"),
        )
    )


def copy_allowance(rel: Relations) -> DataFrame:
    """Per inventory copy: the allowed days, without the category joins."""
    return rel.inventory.join(rel.film.select("film_id", "rental_duration"), "film_id").select(
        "inventory_id", F.col("rental_duration").alias("allowed_days")
    )


def customer_places(rel: Relations) -> DataFrame:
    """Customers with a complete address chain."""
    return (
        rel.customer.join(rel.address, "address_id")
        .join(rel.city, "city_id")
        .join(rel.country, "country_id")
        .select(
            "customer_id",
            F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
            "email", "active", "city", "country",
        )
    )


def payment_totals(rel: Relations) -> DataFrame:
    """Payments per rental, in whole cents: exact sums without big decimals."""
    kind = rel.payment.schema["amount"].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not whole and not (isinstance(kind, T.DecimalType) and kind.scale <= 2):
        raise ValueError(f"payment.amount must have two decimals at most, not {kind.simpleString()}: cast it first")
    cents = (F.col("amount").cast("decimal(16,2)") * 100).cast("long")
    return (
        rel.payment.select("rental_id", cents.alias("cents"))
        .groupBy("rental_id")
        .agg(
            F.count(F.lit(1)).alias("n_payments"),
            F.count("cents").alias("n_paid"),
            F.sum("cents").alias("cents"),
        )
    )


def dollars(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def weighted_rentals(rel: Relations) -> DataFrame:
    """Rentals with ``n_rows``, the number of joined rows each stands for.

    Both sides grow with the data, so the join is asked to sort and merge:
    it spills, splits under skew, and never builds a hash table of payments.
    """
    payments = payment_totals(rel).hint("merge")
    return rel.rental.join(payments, "rental_id", "left").select(
        *rel.rental.columns,
        F.coalesce("n_payments", F.lit(1)).alias("n_rows"),
        F.coalesce("n_paid", F.lit(0)).alias("n_paid"),
        "cents",
    )


def genre_rentals(rel: Relations, rentals: DataFrame) -> DataFrame:
    """Weighted rentals with the allowed days, a row for each category of their film."""
    return rentals.join(copy_terms(rel).drop("film_id"), "inventory_id")


def is_late() -> Column:
    """Three-valued: NULL while not returned, else strictly over the limit."""
    return F.when(
        F.col("return_date").isNotNull(),
        elapsed_us("rental_date", "return_date") > F.col("allowed_days") * F.lit(DAY_US),
    )


def overdue_us() -> Column:
    """Microseconds over the limit, 0 if in time or not returned.

    A whole decimal: its sums are exact, and so independent of the order of rows.
    """
    late_by = elapsed_us("rental_date", "return_date") - F.col("allowed_days") * F.lit(DAY_US)
    return F.greatest(late_by, F.lit(0)).cast("decimal(20,0)")


def late_rows() -> Column:
    """Weight of the row if late, else 0."""
    return F.when(is_late(), F.col("n_rows")).otherwise(F.lit(0))


def summands() -> dict[str, Column]:
    """What a weighted rental adds to the measures of its customer and category."""
    n = F.col("n_rows")
    weekend = day_of_week(F.col("rental_date")).isin(0, 6)
    return {
        "rentals": n,
        "paid": F.col("n_paid"),
        "cents": F.col("cents"),
        "late": late_rows(),
        "returned": F.when(F.col("return_date").isNotNull(), n).otherwise(0),
        "overdue_us": (overdue_us() * n).cast("decimal(38,0)"),
        "weekend": F.when(weekend, n).otherwise(0),
    }


def rental_fact(rel: Relations) -> DataFrame:
    """The full joined row set, one row per rental, category and payment."""
    return described(rel, rel.rental.join(rel.payment.hint("merge"), "rental_id", "left"))


def described(rel: Relations, rentals: DataFrame) -> DataFrame:
    """Rentals joined with payments, with all columns of the fact."""
    films = film_catalogue(rel).select(
        "film_id", "title", F.col("rental_duration").alias("allowed_days"), "rental_rate",
        F.col("length").alias("film_length_min"), "rating", "category",
    )
    rows = (
        rentals.join(rel.inventory, "inventory_id")
        .join(films, "film_id")
        .join(customer_places(rel), "customer_id")
    )
    when = F.col("rental_date")
    return rows.select(
        "rental_id", "rental_date", "return_date",
        day_of_week(when).alias("day_of_week_num"),
        F.date_format(when, "EEEE").alias("day_of_week"),
        day_type(when).alias("day_type"),
        month_key(when).alias("rental_month"),
        "customer_id", "full_name", "email", "active", "city", "country",
        "film_id", "title", "allowed_days", "rental_rate", "film_length_min", "rating",
        "category", F.col("amount").cast("double").alias("amount"),
        (elapsed_us("rental_date", "return_date") / F.lit(float(DAY_US))).alias(
            "rental_duration_actual"
        ),
        (overdue_us().cast("double") / F.lit(float(DAY_US))).alias("days_overdue"),
        is_late().alias("is_late_return"),
    )
