"""Connected components of links that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import removed, stored


def are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour and no other, or larger ones only; edges are (u, v) with u > v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("end"))
    nodes = ends.groupBy("end.id").agg(F.sum("end.up").alias("up"), F.count("*").alias("n"))
    return not nodes.agg(F.max(F.expr("up > 1 or up = 1 and n > 1"))).first()[0]


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, label) of every linked id, label the smallest id of its component; links are (a, b).

    Large-star and small-star steps in turn: each node's neighbours are linked to the
    smallest of them, until only stars are left. Rows never outgrow the links, and a hot
    node's neighbours are only compared with their minimum, never collected.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{folder}/links")
    turn, last = 0, f"{folder}/links"
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.where("u != v").distinct(), f"{folder}/large{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        edges = stored(small, f"{folder}/small{turn}")
        removed(links.sparkSession, last, f"{folder}/large{turn}")
        turn, last = turn + 1, f"{folder}/small{turn}"
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
