"""From buckets of similar things to verified components, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.components import components
from rentlens.llm.common import removed, stored

#: Of buckets up to this size, all pairs across components are compared at once.
SMALL_BUCKET = 8
#: Factor by which the share of larger buckets grows from round to round.
GROWTH = 16


def shared(members: DataFrame) -> DataFrame:
    """Members (bucket, id) of buckets with two ids or more."""
    many = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    return members.join(many, "bucket", "left_semi").distinct()


def star_pairs(members: DataFrame, bound: str | None = None) -> DataFrame:
    """Every member of a bucket with its smallest one, as far as they can be a link at all."""
    own = [c for c in members.columns if c != "bucket"] if bound else ["id"]
    least = members.groupBy("bucket").agg(F.min(F.struct(*own)).alias("least"))
    least = least.select("bucket", *[F.col("least").getField(c).alias(f"{c}2") for c in own])
    pairs = members.join(least, "bucket").where("id > id2")
    pairs = pairs.where(bound) if bound else pairs
    return pairs.select(F.col("id2").alias("a"), F.col("id").alias("b")).distinct()


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, label, n, and what members have besides) of the members of buckets that span components, n the bucket's size."""
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return labelled.join(sizes.select("bucket", "n"), "bucket")


def further_pairs(left: DataFrame, share: int, bound: str | None) -> DataFrame:
    """Pairs across components of mixed buckets' members with about `share` of each bucket."""
    place = F.pmod(F.xxhash64("id", "bucket"), F.lit(1 << 30)) * F.col("n")
    picked = left.where((F.col("n") <= SMALL_BUCKET) | (place < F.lit(share).cast("long") * (1 << 30)))
    names = [c for c in left.columns if c not in ("bucket", "n")]
    picked = picked.select("bucket", *[F.col(c).alias(f"{c}2") for c in names])
    pairs = left.join(picked, "bucket").where("label != label2")
    if bound:
        pairs = pairs.where(bound)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """labels after new links: components of the components that these join, so work follows the new links."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}"))
    ends = [F.coalesce(f"label_{x}", x).alias(x) for x in ("a", "b")]
    joins = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*ends)
    changed = stored(components(joins, folder), f"{folder}/changed")
    now = changed.select(F.col("id").alias("label"), F.col("label").alias("now"))
    old = labels.join(now, "label", "left").select("id", F.coalesce("now", "label").alias("label"))
    return old.unionByName(changed.join(labels, "id", "left_anti"))


def linked(members: DataFrame, verified: Callable[[DataFrame], DataFrame], folder: str, finer: Callable[[DataFrame], DataFrame] | None = None, bound: str | None = None) -> DataFrame:
    """(id, label) of every id that has a verified link, label the smallest id of its component.

    verified takes pairs (a, b) and returns those that hold. First each member meets
    the smallest of its bucket. Then, in rounds, buckets that still span components are
    compared across them with a share of their members that grows by GROWTH, up to all:
    in the end each pair of a bucket is in one component or has been compared. Tables of a
    round are removed when the next has been written.

    finer takes (id) and returns further members (bucket, id) such that ids with a link
    always share one of these buckets. Where given, larger buckets that still span
    components are replaced by them, so that a large bucket of unlike members
    is not compared pair by pair. They may have further columns, by which bound, a
    condition on them and their twins ending in 2, tells what can be a link at all;
    without finer, the members themselves have these columns.
    """
    spark = members.sparkSession
    tried = stored(star_pairs(members, None if finer else bound), f"{folder}/pairs0")
    links = stored(verified(tried), f"{folder}/links0")
    labels = stored(components(links, f"{folder}/labels0"), f"{folder}/components0")
    removed(spark, f"{folder}/links0", f"{folder}/labels0")
    if finer:
        left = stored(mixed(members, labels), f"{folder}/spanning")
        large = finer(left.where(F.col("n") > SMALL_BUCKET).select("id").distinct())
        small = left.where(F.col("n") <= SMALL_BUCKET).select("bucket", "id")
        members = small.unionByName(shared(stored(large, f"{folder}/finer")), allowMissingColumns=True)
    share, turn = 1, 0
    while True:
        left = stored(mixed(members, labels), f"{folder}/members{turn}")
        removed(spark, *([f"{folder}/members{turn - 1}"] if turn else [f"{folder}/spanning", f"{folder}/finer"]))
        most = left.agg(F.max("n")).first()[0]
        if most is None:
            return labels
        pairs = stored(further_pairs(left, share, bound).join(tried, ["a", "b"], "left_anti"), f"{folder}/pairs{turn + 1}")
        links = stored(verified(pairs), f"{folder}/links{turn + 1}")
        if not links.isEmpty():
            labels = stored(merged(labels, links, f"{folder}/labels{turn + 1}"), f"{folder}/components{turn + 1}")
        removed(spark, f"{folder}/links{turn + 1}", f"{folder}/labels{turn + 1}")
        if max(share, SMALL_BUCKET) >= most:
            return labels
        members, tried = left.drop("label", "n"), tried.unionByName(pairs)
        share, turn = share * GROWTH, turn + 1
