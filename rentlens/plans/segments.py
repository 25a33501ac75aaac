"""Customer segments, tiers, the customer table and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.functions.scalar import fixed_avg, named_rows
from rentlens.operators.grams import candidates
from rentlens.plans.profiles import profiles

# The offered orders of the customer table.
TABLE_ORDERS = {
    "name_asc": ("full_name", True),
    "name_desc": ("full_name", False),
    "spending_desc": ("total_spending", False),
    "spending_asc": ("total_spending", True),
    "rentals_desc": ("total_rentals", False),
    "rentals_asc": ("total_rentals", True),
    "risk_desc": ("risk_score", False),
}


def filtered(
    customers: DataFrame,
    segments: list[str] | None = None,
    high_risk: bool | None = None,
    countries: list[str] | None = None,
    tiers: list[str] | None = None,
) -> DataFrame:
    """Conjunction of the given filters; an empty one lets everything pass."""
    for column, wanted in (
        ("rfm_segment", segments), ("country", countries), ("spending_tier", tiers),
    ):
        if wanted:
            customers = customers.where(F.col(column).isin(wanted))
    if high_risk is not None:
        customers = customers.where(F.col("is_high_risk") == F.lit(high_risk))
    return customers


def segment_overview(ws) -> DataFrame:
    """The four segments with customers, revenue and share; absent ones are 0."""
    stats = profiles(ws).groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("total_spending").cast("decimal(18,2)")).cast("double").alias("spent"),
    )
    everyone = F.lit(float(max(ws.size.customers, 1)))
    return (
        named_rows(ws.spark, "rfm_segment", labels.SEGMENT_ORDER)
        .join(stats, "rfm_segment", "left")
        .select(
            "position", "rfm_segment",
            F.coalesce("n", F.lit(0)).alias("customers"),
            F.coalesce("spent", F.lit(0.0)).alias("revenue"),
            (F.coalesce("n", F.lit(0)) / everyone * 100).alias("pct_customers"),
        )
        .orderBy("position")
    )


def tier_breakdown(ws, **filters) -> DataFrame:
    """Customers per tier within the filters; absent tiers are 0."""
    stats = filtered(profiles(ws), **filters).groupBy("spending_tier").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        named_rows(ws.spark, "spending_tier", labels.TIER_ORDER)
        .join(stats, "spending_tier", "left")
        .select("position", "spending_tier", F.coalesce("n", F.lit(0)).alias("customers"))
        .orderBy("position")
    )


def segment_recency(ws) -> DataFrame:
    return (
        profiles(ws).groupBy("rfm_segment")
        .agg(F.avg("days_since_last_rental").alias("avg_days_since_last_rental"))
        .orderBy(F.desc("avg_days_since_last_rental"), "rfm_segment")
    )


def segment_value(ws) -> DataFrame:
    return (
        profiles(ws).groupBy("rfm_segment")
        .agg(
            fixed_avg("total_spending", 2).alias("avg_spending"),
            F.count(F.lit(1)).alias("customers"),
        )
        .orderBy(F.desc("avg_spending"), "rfm_segment")
    )


def at_most(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def customer_table(
    ws, order: str = "name_asc", limit: int | None = None, **filters
) -> DataFrame:
    """The customers within the filters in one of the offered orders; all unless fewer are asked for."""
    column, ascending = TABLE_ORDERS[order]
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return (
        at_most(filtered(profiles(ws), **filters).orderBy(key, "customer_id"), limit)
        .select(
            "customer_id", "full_name", "city", "country", "total_rentals", "total_spending",
            "late_return_rate", "rfm_segment", "risk_score", "is_high_risk", "spending_tier",
        )
    )


def _matches(name: str, customer_id: str) -> Column:
    found = F.lit(True)
    if name.strip():
        # A regular expression; a NULL name does not match.
        found = found & F.coalesce(
            F.col("full_name").rlike(f"(?i){name.strip()}"), F.lit(False)
        )
    if customer_id.strip().isdigit():
        found = found & (F.col("customer_id") == int(customer_id.strip()))
    return found


def customer_search(
    ws, name: str = "", customer_id: str = "", limit: int | None = None
) -> DataFrame:
    """The matches by name pattern and id, in id order; all unless fewer are asked for.

    Where the pattern requires a string of three characters or more, only customers
    from the posting lists of its rarest grams meet the pattern.
    """
    rows = profiles(ws)
    found = candidates(ws.name_grams, ws.name_gram_sizes, name.strip()) if name.strip() else None
    if found is not None:
        rows = rows.join(found.withColumnRenamed("id", "customer_id"), "customer_id", "left_semi")
    found = rows.where(_matches(name, customer_id)).orderBy("customer_id")
    return (
        at_most(found, limit)
        .select("customer_id", "full_name", "city", "country", "rfm_segment", "is_high_risk")
    )


def customer_page(ws, page: int, size: int = 50, order: str = "name_asc") -> DataFrame:
    """Page 0, 1, ... of the customer table in an order, at the cost of the page.

    The table is kept sorted in range partitions, a folder each, with a directory of
    their sizes (a number for each partition); a page is read from the one or two
    folders it lies in.
    """
    column, ascending = TABLE_ORDERS[order]
    key = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("customer_id").asc()]

    def build() -> DataFrame:
        table = customer_table(ws, order)
        return table.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.spark_partition_id())

    table = ws.keep(f"sorted_{order}", build, folders="place")
    sizes = ws.memo.get(("page_sizes", order))
    if sizes is None:
        sizes = sorted(tuple(r) for r in table.groupBy("place").agg(F.count(F.lit(1))).collect())
        ws.memo["page_sizes", order] = sizes
    first, start, places, skip = page * size, 0, [], 0
    for place, n in sizes:
        if start < first + size and first < start + n:
            skip = skip if places else first - start
            places.append(place)
        start += n
    found = table.where(F.col("place").isin(places) if places else F.lit(False)).drop("place")
    return found.orderBy(*key).offset(max(skip, 0)).limit(size)


def return_split(ws) -> DataFrame:
    """Late rows against the rest; not yet returned counts as on time."""
    return ws.profile_base.select(
        "customer_id",
        (F.col("total_rentals") - F.col("late_return_count")).alias("on_time"),
        F.col("late_return_count").alias("late"),
    )
