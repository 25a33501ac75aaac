"""Row numbers within large groups, and positions not yet taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced_row_number(
    df: DataFrame, group: list[str], slice_by: list[Column], order: list[Column], name: str
) -> DataFrame:
    """``row_number`` per group for groups too large for one task.

    ``slice_by`` must be the leading part of the order, as non-null values: a
    group is numbered slice by slice, and each slice starts after the rows
    counted in the slices before it.
    """
    keys = [f"__slice_{i}" for i in range(len(slice_by))]
    sliced = df.select("*", *[c.alias(k) for c, k in zip(slice_by, keys, strict=True)])
    counts = sliced.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(
        *group, *keys,
        F.coalesce(
            F.sum("__n").over(
                Window.partitionBy(*group)
                .orderBy(*keys)
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("__start"),
    )
    within = F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*order))
    return (
        sliced.withColumn("__row", within)
        .join(starts, [*group, *keys])
        .withColumn(name, F.col("__start") + F.col("__row"))
        .drop(*keys, "__row", "__start")
    )


def taken_before(seen: DataFrame, keys: list[str], position: str, k: int) -> DataFrame:
    """For each key, how many taken positions precede the first k free ones.

    ``seen`` holds the 1-based positions taken under each key; repeats do no harm. Each
    64 positions make a word of bits, so what tasks exchange is one word per key and 64
    positions, whatever the rows: the words are united by ``bit_or`` before and after
    the exchange. The words of a key, in order, give the free positions before each of
    them; only words with fewer than k are looked into. There the i-th taken position
    p has p - i free ones below it, so the j-th free position is j plus the number of
    taken ones with p - i < j. The counts come back as the array ``taken`` (entry j for
    the j-th free one), the number of all taken positions as ``n_taken``.
    """
    place = F.col(position).cast("long") - 1
    words = (
        seen.select(*keys, F.floor(place / 64).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
        .groupBy(*keys, "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    sets = words.groupBy(*keys).agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_taken"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )
    taken = "array<bigint>"
    positions = F.aggregate(
        "words",
        F.struct(F.lit(0).cast("long").alias("ones"), F.expr(f"cast(array() as {taken})").alias("at")),
        lambda done, w: F.struct(
            (done["ones"] + F.bit_count(w["bits"])).alias("ones"),
            # Free positions before the word: all places before it less the taken ones.
            F.when(w["word"] * 64 - done["ones"] < k, F.concat(done["at"], _places(w))).otherwise(done["at"]).alias("at"),
        ),
        lambda done: done["at"],
    )
    below = F.transform("at", lambda p, i: p - (i + 1))
    counts = F.array(*[F.size(F.filter("below", _less_than(j))).cast("long") for j in range(1, k + 1)])
    return (
        sets.select(*keys, "n_taken", positions.alias("at"))
        .select(*keys, "n_taken", below.alias("below"))
        .select(*keys, "n_taken", counts.alias("taken"))
    )


def _less_than(j: int):
    return lambda free: free < j


def _places(word: Column) -> Column:
    """The 1-based positions whose bits are set in a word."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(word["bits"], b) == 1)
    return F.transform(bits, lambda b: word["word"] * 64 + b + 1)


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], spread_by: str, most: int) -> DataFrame:
    """Join many rows with one row per key, no join key holding much more than ``most`` of them.

    Keys are few and rows many, so a key's rows are dealt over as many copies of its
    ``found`` row as the largest key needs; which copy follows from a hash of ``spread_by``.
    """
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    copies = F.coalesce(F.floor(largest / most), F.lit(0)) + 1
    copied = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("__copy"))
    dealt = rows.withColumn("__copy", F.pmod(F.xxhash64(spread_by), copies))
    return dealt.join(copied, [*keys, "__copy"]).drop("__copy")
