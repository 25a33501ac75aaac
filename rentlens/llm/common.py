"""Shared folders and stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.session import ship_package


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder the cluster names; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rentlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, path: str) -> DataFrame:
    """frame, written once and read again: it has no lineage left to recompute."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that a later table has taken the place of."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: No more keys than this can have more than one row in as many.
HEAVY = 1000


def joined_by(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows with the columns of keyed, which has one row per key and the key's number of rows n.

    Keys with more than a HEAVY-th of all rows are HEAVY at most, whatever the data, so they
    are broadcast and their rows stay where they are; the rest is shuffled by key.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    heavy = keyed.where(F.col("n") > max(total // HEAVY, 1))
    light = keyed.where(F.col("n") <= max(total // HEAVY, 1)).drop("n")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy.drop("n")), key).unionByName(rest)


ship = ship_package
