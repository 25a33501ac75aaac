"""One set of relations and the tables derived from it.

A plan function takes a ``Workspace`` and returns a DataFrame. Tables that
several plans start from are computed once, written as parquet to the shared
folder and read back: the lineage is cut, a lost executor costs a re-read, and
Catalyst plans later joins from true sizes instead of estimates.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.functions.scalar import whole_days
from rentlens.operators import fact
from rentlens.operators.grams import postings
from rentlens.session import shared_dir, ship_package
from rentlens.sources import Relations, from_star
from rentlens.store import Store, code_version


CUSTOMER_BUCKETS = 256


def customer_bucket(customer: Column) -> Column:
    return F.pmod(F.xxhash64(customer), F.lit(CUSTOMER_BUCKETS)).cast("int")


@dataclass(frozen=True)
class Size:
    """Customers and fact rows."""

    customers: int
    rows: int


@dataclass(frozen=True)
class Extent:
    """Scalars over all profiles: one row, read once."""

    today: str
    date_type: str
    max_rentals: int
    max_days_since: int

    @property
    def today_column(self) -> Column:
        return F.lit(self.today).cast(self.date_type)


class Workspace:
    def __init__(
        self, spark: SparkSession, relations: Relations, noise: str = "hash", store: Store | None = None
    ) -> None:
        """With a store, derived tables are shared with other sessions over the same files."""
        self.spark = spark
        self.store = store
        #: Noise of the risk score ("hash" or "none"), the same for all that follows from it.
        self.noise = noise
        self.relations = relations
        self.created = time.monotonic()
        self._folder = f"{shared_dir(spark)}/rentlens-{uuid.uuid4().hex}"
        self._kept: dict[str, DataFrame] = {}
        self.memo: dict = {}

    def close(self) -> None:
        """Removes this workspace's folder; tables read from it cannot be used any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self._kept.clear()
        if self.store:
            self.store.release()

    def query(self, sql: str, params: dict | list | None = None) -> DataFrame:
        """SQL over the ten relations by name, with bound parameters."""
        self.relations.register_views()
        return self.spark.sql(sql, args=params)

    @cached_property
    def snapshot(self) -> str | None:
        """What derived tables depend on: the sources' files, the code, and the settings."""
        files = self.store.snapshot(dict(vars(self.relations))) if self.store else None
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        return files and hashlib.sha256(f"{files} {code_version()} {self.noise} {zone}".encode()).hexdigest()

    def keep(self, name: str, build, folders: str | None = None) -> DataFrame:
        """The table ``name``, built and written on first use, in a folder for each value of a column if one is named."""
        if name not in self._kept:
            key = self.snapshot and f"{name}-{self.snapshot}"
            found = self.store.find(key) if key else None
            if found is None and key:
                found = self.store.put(key, build(), folders)
            elif found is None:
                path, df = f"{self._folder}/{name}", build()
                # Own folder: what a failed attempt left behind may go.
                writer = df.write.mode("overwrite")
                (writer.partitionBy(folders) if folders else writer).parquet(path)
                found = self.spark.read.schema(df.schema).parquet(path)
            self._kept[name] = found
            # The exchanges of a plan stay on the disks of the executors until the driver's JVM finds the plan unreachable.
            self.spark._jvm.System.gc()
        return self._kept[name]

    @cached_property
    def places(self) -> DataFrame:
        return fact.customer_places(self.relations)

    @property
    def customer_genre(self) -> DataFrame:
        """Per customer with a complete address and category: the additive measures of the fact, and the country."""
        return self.keep("customer_genre", lambda: self._placed_genre())

    @property
    def customer_genre_rows(self) -> DataFrame:
        """The same as it is there: written, or computed, as far as it is read, by the one reader that asks."""
        return self.customer_genre if "customer_genre" in self._kept else self._placed_genre()

    def _placed_genre(self) -> DataFrame:
        return self.every_customer_genre().join(self.places.select("customer_id", "country"), "customer_id")

    def every_customer_genre(self) -> DataFrame:
        """The measures of all customers, if they or the scan have been written; else they are computed for the one that reads them."""
        from rentlens.operators.sequences import category_measures
        from rentlens.plans.profiles import customer_genre_measures

        if "all_customer_genre" in self._kept:
            return self.all_customer_genre
        if "measured_steps" not in self._kept:
            return customer_genre_measures(self)
        kind = self.relations.rental.schema["customer_id"].dataType
        measures = category_measures(self.measured_steps)
        return measures.withColumn("customer_id", F.col("customer_id").cast(kind))

    @property
    def all_customer_genre(self) -> DataFrame:
        """The same of all customers, with or without an address."""
        from rentlens.plans.profiles import customer_genre_measures

        return self.keep("all_customer_genre", lambda: customer_genre_measures(self))

    @property
    def customer_month(self) -> DataFrame:
        """Per customer and month: the additive measures of the rentals, and those of the fact."""
        from rentlens.plans.profiles import customer_month_measures

        return self.keep("customer_month", lambda: customer_month_measures(self))

    @property
    def name_grams(self) -> DataFrame:
        """Posting lists of the grams of customers' names, a folder for each bucket of grams."""
        return self.keep("name_grams", lambda: postings(self.places, "customer_id", "full_name"), folders="folder")

    @property
    def name_gram_sizes(self) -> DataFrame:
        build = lambda: self.name_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("gram")
        return self.keep("name_gram_sizes", build)

    @property
    def facts_by_customer(self) -> DataFrame:
        """Rentals with their payments, laid out so that one customer's are read alone.

        A folder holds the customers of one bucket in order, so files and row groups
        have narrow ranges of customers. Range partitions split a customer with very
        many rows, as the order goes on by date and rental.
        """

        def build() -> DataFrame:
            rel = self.relations
            rows = rel.rental.join(rel.payment.hint("merge"), "rental_id", "left")
            order = ["bucket", "customer_id", "rental_date", "rental_id"]
            rows = rows.withColumn("bucket", customer_bucket(F.col("customer_id")))
            return rows.repartitionByRange(*order).sortWithinPartitions(*order)

        return self.keep("facts_by_customer", build, folders="bucket")

    @property
    def _ordered_rows(self) -> DataFrame:
        return self.genre_rows.where(F.col("customer_id").isNotNull())

    @property
    def measured_steps(self) -> DataFrame:
        """The ordered scan of all customers with their measures by category: the rows are in order of customers once, for both."""
        from rentlens.operators.sequences import neighbour_scan

        ship_package(self.spark)
        return self.keep("measured_steps", lambda: neighbour_scan(self._ordered_rows, fact.summands()))

    def scan_once(self) -> None:
        """For what reads the ordered scan and the measures by category: writes the scan with the measures."""
        self.measured_steps  # noqa: B018

    @property
    def ordered_steps(self) -> DataFrame:
        """Gaps, category steps and last rows of the ordered rows of customers with a complete address.

        Few customers lack one, so all rows are scanned first and the customers found are
        compared with the places; only if some are missing there, the others are scanned again.
        """
        from rentlens.operators.sequences import neighbour_scan, scanned_customers

        if "ordered_steps" not in self._kept:
            ship_package(self.spark)
            measured = "measured_steps" in self._kept
            scan = self.measured_steps if measured else self.keep("ordered_steps_all", lambda: neighbour_scan(self._ordered_rows))
            strays = scanned_customers(scan).join(self.places, "customer_id", "left_anti")
            if strays.isEmpty():
                self._kept["ordered_steps"] = scan
            else:
                self.keep("ordered_steps", lambda: neighbour_scan(self._ordered_rows.join(strays, "customer_id", "left_anti")))
        return self._kept["ordered_steps"]

    @property
    def customer_gaps(self) -> DataFrame:
        """Per customer the sum of whole-day gaps between rentals, where it is above 0."""
        from rentlens.operators.sequences import rental_gaps

        return rental_gaps(self.ordered_steps)

    @property
    def weighted_rentals(self) -> DataFrame:
        """Rentals with their payments folded in, written: for what reads them more than once."""
        return self.keep("weighted_rentals", lambda: fact.weighted_rentals(self.relations))

    @property
    def rentals(self) -> DataFrame:
        """The same as it is there: written, or computed by the one reader that asks."""
        return self.weighted_rentals if "weighted_rentals" in self._kept else fact.weighted_rentals(self.relations)

    @property
    def genre_rentals(self) -> DataFrame:
        """Weighted rentals with the terms of their film, a row for each category, written: for what reads them more than once."""
        return self.keep("genre_rentals", lambda: fact.genre_rentals(self.relations, self.rentals))

    @property
    def genre_rows(self) -> DataFrame:
        """The same as it is there: written, or computed by the one reader that asks."""
        return self.genre_rentals if "genre_rentals" in self._kept else fact.genre_rentals(self.relations, self.rentals)

    @property
    def rented_copies(self) -> DataFrame:
        """Customers and the copies of categorised films that they rented, with repeats, from the table at hand."""
        rows = self.genre_rentals if "genre_rentals" in self._kept else self.relations.rental
        return rows.select("customer_id", "inventory_id")

    @property
    def profile_base(self) -> DataFrame:
        """Per customer: all profile columns that need no global threshold."""
        from rentlens.plans.profiles import profile_measures

        def build() -> DataFrame:
            self.scan_once()
            return profile_measures(self)

        return self.keep("profile_base", build)

    @cached_property
    def size(self) -> Size:
        row = self.customer_genre.agg(
            F.count_distinct("customer_id").alias("customers"),
            F.coalesce(F.sum("rentals"), F.lit(0)).alias("rows"),
        ).first()
        return Size(**row.asDict())

    @cached_property
    def extent(self) -> Extent:
        base = self.profile_base
        last = F.col("last_rental_date")
        row = base.agg(
            F.max(last).cast("string").alias("today"),
            F.max("total_rentals").alias("max_rentals"),
            whole_days(F.min(last), F.max(last)).alias("max_days_since"),
        ).first()
        return Extent(date_type=base.schema["last_rental_date"].dataType.simpleString(), **row.asDict())


_open: dict[tuple[str, str], Workspace] = {}


def workspace_for(spark: SparkSession, root: str, ttl_seconds: float = 300.0) -> Workspace:
    """The workspace over the star tables in ``root``, reused for a while.

    Derived tables are shared between calls for ``ttl_seconds``; after that a
    new workspace reads the sources again. The folder of the old one goes when another
    ``ttl_seconds`` have passed, so that results handed out before can still be read.
    """
    key, now = (spark.sparkContext.applicationId, root), time.monotonic()
    for waiting in [w for w in _retired if now - w.created > 2 * ttl_seconds]:
        _retired.remove(waiting)
        waiting.close()
    current = _open.get(key)
    if current is None or now - current.created > ttl_seconds:
        if current is not None:
            _retired.append(current)
        current = _open[key] = Workspace(spark, from_star(spark, root))
    return current


_retired: list[Workspace] = []
