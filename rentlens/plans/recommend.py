"""Film recommendations for every customer.

No customer is ever paired with the catalogue. Each category's films are
numbered once in the order in which they would be offered; for a customer the
numbers of the first films not rented yet follow from the bit sets of the rented
ones (see ``ranking.taken_before``). Customers want few different films, so those
are looked up once each and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions import labels
from rentlens.operators import fact
from rentlens.operators.ranking import sliced_row_number, spread_join, taken_before
from rentlens.plans.genres import FILMS_SHOWN, top_next_genre
from rentlens.plans.profiles import profiles

FILMS_PER_GENRE, FILMS_PER_CUSTOMER = 2, 12
UNRANKED = 999
SHORT_PERIOD, PREMIUM_RATE = 4, 2.99
ID_SLICE = 65_536
#: Customers who want the same film are dealt to a copy of it for each so many.
ROWS_PER_KEY = 1 << 20


def _number(films: DataFrame, leading: list[Column], name: str) -> DataFrame:
    """Number a category's films by the leading columns, then by film id."""
    slices = [*leading, F.floor(F.col("film_id") / ID_SLICE)]
    return sliced_row_number(films, ["category"], slices, [F.col("film_id")], name)


def film_positions(ws) -> DataFrame:
    """The catalogue with each film's position in its category, per order.

    ``cautious`` offers short rental periods, then low rates, first;
    ``standard`` offers high rates first.
    """

    def build() -> DataFrame:
        films = fact.film_catalogue(ws.relations).select(
            "film_id", "title", "rating", "rental_duration", "rental_rate", "category"
        )
        period = F.coalesce("rental_duration", F.lit(2**31 - 1))
        rate = F.coalesce("rental_rate", F.lit(float("inf")))
        films = _number(films, [period, rate], "cautious")
        return _number(films, [-F.coalesce("rental_rate", F.lit(float("-inf")))], "standard")

    return ws.keep("film_positions", build)


def category_sizes(ws) -> DataFrame:
    return film_positions(ws).groupBy("category").agg(F.count(F.lit(1)).alias("size"))


def _rented(ws, *names: str) -> DataFrame:
    """The positions of rented films in both orders, repeats included, and the named columns of the copies."""
    rel = ws.relations
    films = film_positions(ws).select("film_id", "category", "cautious", "standard")
    copies = rel.inventory.join(films, "film_id").drop("film_id")
    return (
        ws.rented_copies
        .join(copies, "inventory_id")
        .select("customer_id", *names, "category", "cautious", "standard")
    )


def _rented_in_own_order(ws) -> DataFrame:
    """The positions of rented films in the order of the customer's risk class, and how many profiles the customer has.

    Rentals meet the risk classes before they are grouped, so each is exchanged once, with one
    position; of repeats one goes on, so a customer has no more rows than there are copies.
    """
    customers = profiles(ws).select("customer_id", "is_high_risk").where("is_high_risk is not null")
    customers = customers.groupBy("customer_id", "is_high_risk").agg(F.count(F.lit(1)).alias("profiles"))
    place = F.when(F.col("is_high_risk"), F.col("cautious")).otherwise(F.col("standard"))
    rows = _rented(ws, "inventory_id").distinct().join(customers, "customer_id")
    return rows.select("customer_id", "category", "is_high_risk", "profiles", place.alias("place"))


def _by_order(rows: DataFrame, *names: str) -> DataFrame:
    """Each row for both risk classes, with the position in the order offered to them."""
    orders = F.array(
        F.struct(F.lit(True).alias("is_high_risk"), F.col("cautious").alias("place")),
        F.struct(F.lit(False).alias("is_high_risk"), F.col("standard").alias("place")),
    )
    return rows.select(*names, F.explode(orders).alias("order")).select(*names, "order.*")


def _offers(ws, wanted: DataFrame, name: str) -> DataFrame:
    """Look up films by category and position in the order of the risk class."""
    keys = ["category", "is_high_risk", "place"]
    wanted = ws.keep(name, lambda: wanted)
    details = ["category", "film_id", "title", "rating", "rental_duration", "rental_rate"]
    films = _by_order(film_positions(ws), *details).join(wanted.select(*keys).distinct(), keys, "left_semi")
    return spread_join(wanted, films, keys, "customer_id", ROWS_PER_KEY)


def next_genre_films(ws) -> DataFrame:
    """Up to six films not rented yet in each customer's leading next genre."""
    target = top_next_genre(ws).select("customer_id", F.col("next_category").alias("category"))
    taken = taken_before(
        _rented(ws), ["customer_id", "category"], "standard", FILMS_SHOWN,
    )
    nothing = F.array(*[F.lit(0).cast("long")] * FILMS_SHOWN)
    wanted = (
        target.join(taken, ["customer_id", "category"], "left")
        .select(
            "customer_id", "category",
            F.posexplode(F.coalesce("taken", nothing)).alias("k", "skipped"),
        )
        .select(
            "customer_id", "category", (F.col("k") + 1).alias("position"),
            (F.col("k") + 1 + F.col("skipped")).alias("place"),
            F.lit(False).alias("is_high_risk"),
        )
    )
    return _offers(ws, wanted, "wanted_next").select(
        "customer_id", "category", "position", "film_id", "title", "rating",
        "rental_duration", "rental_rate",
    )


def film_recommendations(ws, rank_mode: str = "observed") -> DataFrame:
    """Up to twelve films per customer, two per genre, best genres first."""
    keys = ["customer_id", "category", "is_high_risk"]
    rented = taken_before(_rented_in_own_order(ws), [*keys, "profiles"], "place", FILMS_PER_GENRE)
    each = F.explode(F.sequence(F.lit(1).cast("long"), "profiles")).alias("profile")
    rented = rented.select(*keys, "n_taken", "taken", each).drop("profile")

    own = Window.partitionBy("customer_id")
    if rank_mode == "observed":
        ranked = rented.withColumn("genre_rank", F.row_number().over(own.orderBy("category")) - 1)
    elif rank_mode == "preference":
        liked = F.row_number().over(own.orderBy(F.desc("rentals"), "category"))
        ranked = (
            rented.join(
                ws.customer_genre.select("customer_id", "category", "rentals"),
                ["customer_id", "category"],
            )
            .withColumn("genre_rank", liked - 1).drop("rentals")
        )
    else:
        raise ValueError(f"rank_mode must be 'observed' or 'preference', not {rank_mode!r}")

    def offer(size: Column, taken: Column) -> Column:
        return F.least(size - taken, F.lit(FILMS_PER_GENRE)).cast("int")

    # One row per customer with an entry per genre; if the own genres do not
    # fill the list, the genres never rented follow, alphabetically. Each has
    # at least one film, so as many as the list is long are always enough.
    sizes = category_sizes(ws)
    catalogue = sizes.agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("category", offer(F.col("size"), F.lit(0)))))
        )
    ).scalar()
    nothing = F.array(*[F.lit(0).cast("long")] * FILMS_PER_GENRE)
    entry = F.struct(
        F.col("genre_rank").alias("genre_rank"), "category",
        offer(F.col("size"), F.col("n_taken")).alias("offer"), "taken",
    )
    others = F.slice(
        F.array_except(F.map_keys("catalogue"), F.transform("own", lambda e: e["category"])),
        1, FILMS_PER_CUSTOMER,
    )
    fill = F.transform(
        others,
        lambda c: F.struct(
            F.lit(UNRANKED).alias("genre_rank"), c.alias("category"),
            F.element_at("catalogue", c).alias("offer"), nothing.alias("taken"),
        ),
    )
    offered = F.aggregate("own", F.lit(0), lambda total, e: total + e["offer"])
    genres = (
        ranked.join(sizes, "category")
        .groupBy("customer_id", "is_high_risk").agg(F.collect_list(entry).alias("own"))
        .withColumn("catalogue", catalogue)
        .select(
            "customer_id", "is_high_risk",
            F.explode(
                F.when(offered < FILMS_PER_CUSTOMER, F.concat("own", fill)).otherwise(F.col("own"))
            ).alias("entry"),
        )
        .select("customer_id", "is_high_risk", "entry.*")
    )
    before = F.coalesce(
        F.sum("offer").over(
            own.orderBy("genre_rank", "category").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    ).cast("int")
    room = F.least(F.col("offer"), F.lit(FILMS_PER_CUSTOMER) - F.col("before"))
    wanted = (
        genres.withColumn("before", before)
        .where(room > 0)
        .select(
            *keys, "genre_rank", "before",
            F.posexplode(F.slice("taken", F.lit(1), room)).alias("k", "skipped"),
        )
        .select(
            *keys, "genre_rank",
            (F.col("before") + F.col("k") + 1).alias("position"),
            (F.col("k") + 1 + F.col("skipped")).alias("place"),
        )
    )
    offers = _offers(ws, wanted, f"wanted_{rank_mode}")
    note = (
        F.when(
            F.col("is_high_risk") & (F.col("rental_duration") <= SHORT_PERIOD), labels.NOTE_SHORT
        )
        .when(~F.col("is_high_risk") & (F.col("rental_rate") >= PREMIUM_RATE), labels.NOTE_PREMIUM)
        .otherwise(labels.NOTE_MATCH)
    )
    return offers.select(
        "customer_id", "position", "genre_rank", "category", "film_id", "title", "rating",
        "rental_duration", "rental_rate", note.alias("note"),
    )
