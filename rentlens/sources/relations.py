"""The ten relations every plan starts from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

# The columns the plans use of each relation; a reader may offer more.
RELATION_COLUMNS = {
    "rental": ["rental_id", "rental_date", "return_date", "customer_id", "inventory_id"],
    "customer": ["customer_id", "first_name", "last_name", "email", "active", "address_id"],
    "address": ["address_id", "city_id"],
    "city": ["city_id", "city", "country_id"],
    "country": ["country_id", "country"],
    "inventory": ["inventory_id", "film_id"],
    "film": [
        "film_id", "title", "description", "release_year", "rental_duration",
        "rental_rate", "length", "rating", "replacement_cost",
    ],
    "film_category": ["film_id", "category_id"],
    "category": ["category_id", "name"],
    "payment": ["rental_id", "amount"],
}


@dataclass(frozen=True)
class Relations:
    rental: DataFrame
    customer: DataFrame
    address: DataFrame
    city: DataFrame
    country: DataFrame
    inventory: DataFrame
    film: DataFrame
    film_category: DataFrame
    category: DataFrame
    payment: DataFrame

    def __post_init__(self) -> None:
        for name, wanted in RELATION_COLUMNS.items():
            missing = set(wanted) - set(getattr(self, name).columns)
            if missing:
                raise ValueError(f"relation {name} lacks columns {sorted(missing)}")

    def register_views(self) -> None:
        """Temp views, so that ``spark.sql`` can be used on the relations."""
        for field in fields(self):
            getattr(self, field.name).createOrReplaceTempView(field.name)


def from_parquet(spark: SparkSession, root: str) -> Relations:
    """One parquet dataset per relation under ``root``."""
    return Relations(**{name: spark.read.parquet(f"{root}/{name}") for name in RELATION_COLUMNS})


# A wide key range splits into parallel reads on these columns.
_JDBC_KEYS = {
    "rental": "rental_id",
    "payment": "rental_id",
    "customer": "customer_id",
    "address": "address_id",
    "inventory": "inventory_id",
    "film": "film_id",
    "film_category": "film_id",
}


def from_jdbc(
    spark: SparkSession,
    url: str,
    options: dict[str, str] | None = None,
    partitions: int = 64,
    fetch_rows: int = 10_000,
) -> Relations:
    """Read the relations from a relational database.

    Tables with a numeric key are read as ``partitions`` key ranges whose ends
    come from one min/max query each; both run in the database. Column
    pruning and filters are pushed down by Spark's JDBC source.
    """
    base = {
        "url": url,
        "fetchsize": str(fetch_rows),
        "preferTimestampNTZ": "true",
        **(options or {}),
    }

    def table(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(**base)
        key = _JDBC_KEYS.get(name)
        if key is None:
            return reader.option("dbtable", name).load()
        ends = reader.option(
            "query", f"SELECT min({key}) AS lo, max({key}) AS hi FROM {name}"
        ).load().first()
        if ends is None or ends["lo"] is None:
            return reader.option("dbtable", name).load()
        return (
            spark.read.format("jdbc").options(**base)
            .option("dbtable", name)
            .option("partitionColumn", key)
            .option("lowerBound", str(ends["lo"]))
            .option("upperBound", str(int(ends["hi"]) + 1))
            .option("numPartitions", str(partitions))
            .load()
        )

    return Relations(**{name: table(name) for name in RELATION_COLUMNS})
