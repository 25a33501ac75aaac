"""Rental relations derived from the star-schema test tables.

Follows the mapping in FIXTURES.md: a line item is a rental, its order gives
the customer and the date, its part is both the inventory copy and the film.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rentlens.sources.relations import Relations

# Fixed values of the mapping: the five market segments, numbered for city ids.
SEGMENT_IDS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}

STAR_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string",
}


def from_star(spark: SparkSession, root: str) -> Relations:
    def read(name: str):
        # A declared schema saves one footer-reading job per table.
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")

    nation, customer, part = read("nation"), read("customer"), read("part")
    orders, lineitem = read("orders"), read("lineitem")

    rental_id = (
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    ) * 10000 + F.col("l_suppkey")
    segment_no = F.expr(
        "CASE c_mktsegment "
        + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_IDS.items())
        + " END"
    )
    city_id = (F.col("c_nationkey") * 10 + segment_no).cast("long")

    rental = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            rental_id.alias("rental_id"),
            F.timestamp_add(
                "MINUTE",
                ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 101) % 1440).cast("int"),
                F.col("o_orderdate"),
            ).alias("rental_date"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("inventory_id"),
            F.when(
                ~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")),
                (1 + F.col("l_quantity").cast("int") % 10) * 24 + (F.col("l_suppkey") * 13) % 24,
            ).cast("int").alias("hours_out"),
        )
        .select(
            "rental_id", "rental_date",
            F.timestamp_add("HOUR", F.col("hours_out"), F.col("rental_date")).alias("return_date"),
            "customer_id", "inventory_id",
        )
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    payment = (
        lineitem.where(F.col("l_discount") > 0)
        .select(
            rental_id.alias("rental_id"),
            F.explode(
                F.when(
                    F.col("l_tax") == 0.08, F.array(price, F.lit("1.00").cast("decimal(12,2)"))
                ).otherwise(F.array(price))
            ).alias("amount"),
        )
    )
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return Relations(
        rental=rental,
        payment=payment,
        customer=customer.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("active"),
            F.col("c_custkey").alias("address_id"),
        ),
        address=customer.select(
            F.col("c_custkey").alias("address_id"), city_id.alias("city_id")
        ),
        city=places.select(
            city_id.alias("city_id"),
            F.concat_ws("-", "n_name", "c_mktsegment").alias("city"),
            F.col("n_nationkey").cast("long").alias("country_id"),
        ).distinct(),
        country=nation.select(
            F.col("n_nationkey").cast("long").alias("country_id"), F.col("n_name").alias("country")
        ),
        inventory=part.select(
            F.col("p_partkey").alias("inventory_id"), F.col("p_partkey").alias("film_id")
        ),
        film=part.select(
            F.col("p_partkey").alias("film_id"),
            F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("title"),
            F.col("p_type").alias("description"),
            F.lit(2006).alias("release_year"),
            (3 + F.col("p_size") % 5).alias("rental_duration"),
            F.element_at(
                F.array(*[F.lit(v).cast("decimal(4,2)") for v in ("0.99", "2.99", "4.99")]),
                (F.col("p_partkey") % 3 + 1).cast("int"),
            ).alias("rental_rate"),
            (46 + F.col("p_size") * 2).alias("length"),
            F.element_at(
                F.array(*[F.lit(v) for v in ("G", "PG", "PG-13", "R", "NC-17")]),
                (F.col("p_partkey") % 5 + 1).cast("int"),
            ).alias("rating"),
            (F.col("p_retailprice") / 50).cast("decimal(12,2)").alias("replacement_cost"),
        ),
        film_category=part.select(
            F.col("p_partkey").alias("film_id"),
            F.substring("p_brand", 7, 10).cast("long").alias("category_id"),
        ),
        category=part.select(
            F.substring("p_brand", 7, 10).cast("long").alias("category_id"),
            F.col("p_brand").alias("name"),
        ).distinct(),
    )
