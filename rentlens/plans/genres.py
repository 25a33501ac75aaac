"""Genres: preferences, spending, transitions, co-rental, next genre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions.scalar import rint_to
from rentlens.operators import fact
from rentlens.operators.sequences import category_steps, last_rows

TRANSITIONS_CONSIDERED, TRANSITIONS_SHOWN = 8, 6
BOOST = 0.15
FILMS_SHOWN = 6
BUNDLES_SHOWN = 5


def _placed(ws) -> DataFrame:
    """Ids of the customers with a complete address."""
    return ws.places.select("customer_id")


def customer_timeline(ws) -> DataFrame:
    return (
        ws.customer_month.where("fact_rows > 0")
        .join(_placed(ws), "customer_id", "left_semi")
        .select(
            "customer_id", F.col("month").alias("rental_month"), F.col("fact_rows").alias("rentals"),
            fact.dollars(F.col("fact_cents")).alias("spending"), F.col("fact_late").alias("late"),
        )
    )


def genre_preferences(ws) -> DataFrame:
    """Rentals of each customer by category, the most rented ones first."""
    counts = ws.customer_genre.select("customer_id", "category", F.col("rentals").alias("count"))
    return counts.orderBy("customer_id", F.desc("count"), "category")


def genre_spend(ws) -> DataFrame:
    return ws.customer_genre.select(
        "customer_id", "category",
        fact.dollars(F.coalesce("cents", F.lit(0))).alias("amount"),
    )


def transitions(ws) -> DataFrame:
    """Category pairs with count and share; at most categories squared rows."""

    def build() -> DataFrame:
        steps = category_steps(ws.ordered_steps)
        share = F.col("count") / F.sum("count").over(Window.partitionBy("category"))
        return steps.withColumn("prob", share)

    return ws.keep("transitions", build)


def genre_transitions(ws) -> DataFrame:
    return transitions(ws)


def genre_lists(ws, rank_mode: str = "observed") -> DataFrame:
    """Per customer the rented categories, in rank order, as one array.

    ``observed`` ranks alphabetically, ``preference`` by rentals. An array
    holds each category once, so its length is bounded by the category list.
    """
    if rank_mode == "observed":
        genres = F.sort_array(F.collect_list("category"))
    elif rank_mode == "preference":
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("rentals")).alias("n"), "category")))
        genres = F.transform(ranked, lambda g: g["category"])
    else:
        raise ValueError(f"rank_mode must be 'observed' or 'preference', not {rank_mode!r}")
    return ws.customer_genre.groupBy("customer_id").agg(genres.alias("genres"))


def last_rentals(ws) -> DataFrame:
    """The latest fact row of each customer.

    The ordered scan finds the last row of a customer in each partition, so there is
    about one row per customer to compare, whatever the number of rentals.
    """
    rel = ws.relations
    last_dates = ws.customer_genre.groupBy("customer_id").agg(F.max("last_date").alias("last_date"))
    films = fact.copy_terms(rel).join(rel.film.select("film_id", "title"), "film_id").select(
        "inventory_id", F.col("category").alias("of"), "title"
    )
    rows = last_rows(ws.ordered_steps).join(films, "inventory_id").where(F.col("category").eqNullSafe(F.col("of")))
    return (
        rows.groupBy("customer_id")
        .agg(F.max(F.struct("at_us", "rental_id", "category", "title")).alias("last"))
        .join(last_dates, "customer_id")
        .select(
            "customer_id",
            F.col("last.category").alias("last_category"),
            F.col("last.title").alias("last_film"),
            "last_date",
        )
    )


def next_genre_candidates(ws, rank_mode: str = "observed") -> DataFrame:
    """The likeliest following categories of each customer, adjusted and ranked."""

    def build() -> DataFrame:
        # Rented films start from these; measures by category, last rows and steps are read from one scan of them.
        ws.genre_rentals  # noqa: B018
        ws.scan_once()
        likeliest = F.row_number().over(
            Window.partitionBy("category").orderBy(F.desc("prob"), "next_category")
        )
        follow = (
            transitions(ws).withColumn("k", likeliest)
            .where(F.col("k") <= TRANSITIONS_CONSIDERED).drop("k")
            .withColumnRenamed("category", "last_category")
        )
        place = F.array_position("genres", F.col("next_category"))
        size = F.size("genres")
        boost = F.when(place > 0, (size - place + 1) / size * BOOST).otherwise(0.0)
        own = Window.partitionBy("customer_id")
        return (
            last_rentals(ws)
            .join(genre_lists(ws, rank_mode), "customer_id")
            .join(follow, "last_category")
            .withColumn("raw", F.col("prob") + boost)
            .drop("genres")
            # Rounded, as the order of the summands must not decide a tie.
            .withColumn("adjusted_prob", rint_to(F.col("raw") / F.sum("raw").over(own), 12))
            .withColumn(
                "position",
                F.row_number().over(own.orderBy(F.desc("adjusted_prob"), "next_category")),
            )
        )

    return ws.keep(f"next_genre_{rank_mode}", build)


def next_genre(ws, rank_mode: str = "observed") -> DataFrame:
    return (
        next_genre_candidates(ws, rank_mode)
        .where(F.col("position") <= TRANSITIONS_SHOWN)
        .select(
            "customer_id", "last_category", "last_film", "last_date", "position",
            "next_category", "count", "prob", "adjusted_prob",
            ((F.col("adjusted_prob") - F.col("prob")) * 100).alias("boost_pct"),
        )
    )


def top_next_genre(ws, rank_mode: str = "observed") -> DataFrame:
    return next_genre_candidates(ws, rank_mode).where(F.col("position") == 1)


def genre_cooccurrence(ws) -> DataFrame:
    """Customers who rented both categories of a pair, in both directions.

    Customers with the same set of categories are counted together first; a
    set is then unfolded into its pairs in place and summed map-side, so no
    pair row crosses the network before it has been combined.
    """
    sets = (
        ws.customer_genre.groupBy("customer_id")
        .agg(F.sort_array(F.collect_list("category")).alias("genres"))
        .groupBy("genres").agg(F.count(F.lit(1)).alias("n"))
    )
    later = F.filter("genres", lambda g: g > F.col("genre_a"))
    half = (
        sets.select("n", "genres", F.explode("genres").alias("genre_a"))
        .select("n", "genre_a", F.explode(later).alias("genre_b"))
        .groupBy("genre_a", "genre_b").agg(F.sum("n").alias("customers"))
    )
    both_ways = F.array(
        F.struct(F.col("genre_a"), F.col("genre_b")),
        F.struct(F.col("genre_b").alias("genre_a"), F.col("genre_a").alias("genre_b")),
    )
    return half.select("customers", F.explode(both_ways).alias("p")).select("p.*", "customers")


def cooccurrence_matrix(ws) -> DataFrame:
    """The co-rental counts as a full square, diagonal and absent pairs 0."""
    pairs = _category_pairs(ws, lambda a, b: F.lit(True))
    return (
        pairs.join(genre_cooccurrence(ws), ["genre_a", "genre_b"], "left")
        .select("genre_a", "genre_b", F.coalesce("customers", F.lit(0)).alias("customers"))
    )


def _category_pairs(ws, keep) -> DataFrame:
    """All pairs of occurring categories, unfolded from the category list."""
    names = ws.customer_genre.select("category").distinct().agg(
        F.sort_array(F.collect_list("category")).alias("names")
    )
    return (
        names.select("names", F.explode("names").alias("genre_a"))
        .select(
            "genre_a",
            F.explode(F.filter("names", lambda b: keep(F.col("genre_a"), b))).alias("genre_b"),
        )
    )


def top_bundles(ws, limit: int = BUNDLES_SHOWN) -> DataFrame:
    """The most shared category pairs; pairs nobody shares take part as 0."""
    pairs = _category_pairs(ws, lambda a, b: a < b)
    everyone = F.lit(float(max(ws.size.customers, 1)))
    return (
        pairs.join(genre_cooccurrence(ws), ["genre_a", "genre_b"], "left")
        .select("genre_a", "genre_b", F.coalesce("customers", F.lit(0)).alias("customers"))
        .withColumn("pct_customers", F.col("customers") / everyone * 100)
        .orderBy(F.desc("customers"), "genre_a", "genre_b")
        .limit(limit)
    )
