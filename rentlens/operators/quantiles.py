"""Exact quantiles without bringing a column into one task.

The built-in exact ``percentile`` merges all distinct values into a single
buffer. Here values are first reduced to a frequency table, approximate
quantiles cut it into slices, exact slice sizes locate the slice that holds
each wanted rank, and only those slices are sorted. The cut points influence
how even the slices are, never the answer. They depend on the order in which
tasks' sketches are merged, so they are computed once and are constants after that.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed(cuts: DataFrame) -> DataFrame:
    """The same few rows as constants: a second evaluation could give other cut points."""
    return cuts.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], width: int = 32
) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles of several numeric columns at once.

    Returns ``{(column, p): value}``; None where a column has no values. A
    column is cut into ``width`` squared slices; a value finds its slice in
    two steps of about ``width`` comparisons.
    """
    slices = width * width
    columns = list(wanted)
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("metric"), F.col(c).cast("double").alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("m")
    ).select("m.*").where(F.col("value").isNotNull())
    freq = long.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        cuts = fixed(
            freq.groupBy("metric").agg(
                F.percentile_approx("value", [k / slices for k in range(1, slices)], 10_000).alias(
                    "cuts"
                )
            )
        )
        # One row per column of `wanted`, so the hint has a fixed bound.
        steps = cuts.withColumn(
            "coarse", F.filter("cuts", lambda c, i: i % width == width - 1)
        )

        def below(array):
            return F.size(F.filter(array, lambda c: c < F.col("value")))

        placed = (
            freq.join(F.broadcast(steps), "metric")
            .withColumn("step", below("coarse") * width)
            .select(
                "metric", "value", "n",
                (F.col("step") + below(F.slice("cuts", F.col("step") + 1, width - 1))).alias(
                    "slice"
                ),
            )
        )
        # At most `slices` rows per column of `wanted`, whatever the data.
        sizes = {}
        for row in placed.groupBy("metric", "slice").agg(F.sum("n").alias("n")).collect():
            sizes.setdefault(row["metric"], {})[row["slice"]] = row["n"]

        targets = []
        for i, c in enumerate(columns):
            total = sum(sizes.get(i, {}).values())
            for p in wanted[c] if total else []:
                position = (total - 1) * p
                for rank in {math.floor(position), math.ceil(position)}:
                    before = 0
                    for piece, n in sorted(sizes[i].items()):
                        if before <= rank < before + n:
                            targets.append((i, piece, rank, rank - before))
                        before += n
        values = {}
        if targets:
            rows = ", ".join(str(t) for t in sorted(set(targets)))
            wanted_ranks = F.broadcast(
                df.sparkSession.sql(
                    f"SELECT * FROM VALUES {rows} AS t(metric, slice, rank, offset)"
                )
            )
            up_to = F.sum("n").over(
                Window.partitionBy("metric", "slice")
                .orderBy("value")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            located = (
                placed.join(
                    wanted_ranks.select("metric", "slice").distinct(), ["metric", "slice"],
                    "left_semi",
                )
                .withColumn("end", up_to)
                .join(wanted_ranks, ["metric", "slice"])
                .where((F.col("offset") < F.col("end")) & (F.col("offset") >= F.col("end") - F.col("n")))
                .select("metric", "rank", "value")
            )
            values = {(r["metric"], r["rank"]): r["value"] for r in located.collect()}
    finally:
        freq.unpersist()

    result: dict[tuple[str, float], float | None] = {}
    for i, c in enumerate(columns):
        total = sum(sizes.get(i, {}).values())
        for p in wanted[c]:
            if not total:
                result[(c, p)] = None
                continue
            position = (total - 1) * p
            low, high = values[(i, math.floor(position))], values[(i, math.ceil(position))]
            result[(c, p)] = low + (high - low) * (position - math.floor(position))
    return result
