"""Column expressions: rounding, elapsed time, calendar keys, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def rint_to(col: Column, places: int) -> Column:
    """Round half to even after scaling, which is how the source rounds."""
    scale = float(10**places)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double for output, so that results compare across runs."""
    return df.select(
        *[
            rint_to(F.col(f.name), places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def fixed_avg(column: str, places: int) -> Column:
    """Mean of a column that has a fixed number of places.

    Sums decimals, so the result does not depend on the order of rows.
    """
    exact = F.sum(F.col(column).cast(f"decimal(18,{places})")).cast("double")
    return exact / F.count(column)


def elapsed_us(start: str, end: str) -> Column:
    """Whole microseconds between two timestamps, NULL if either is.

    Subtraction compares wall-clock times. ``timestamp_diff`` would convert
    timestamps without a zone to the session's zone first, and so count an
    hour more or less across a clock change.
    """
    seconds = (F.col(end) - F.col(start)).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("long")


def wall_clock_us(column: str) -> Column:
    """Microseconds of wall-clock time since 1970, whatever the session's zone."""
    since = F.col(column).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods of wall-clock time, not calendar days."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def month_number(col: Column) -> Column:
    return F.year(col) * 12 + F.month(col)


def clip(col: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (least/greatest skip NULL)."""
    return F.when(
        col.isNotNull(), F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))
    )


def day_of_week(col: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(col) - 1).cast("int")


def day_type(col: Column) -> Column:
    return F.when(day_of_week(col).isin(0, 6), F.lit("Weekend")).otherwise(F.lit("Weekday"))


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def seeded_normal(key: Column, seed: int, sigma: float) -> Column:
    """A normal deviate that depends only on the key and the seed.

    Box-Muller on two 32-bit slices of md5, so every task computes the same
    value for the same key whatever the partitioning or the retries.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    slices = [
        F.conv(F.substring(digest, start, 8), 16, 10).cast("double") for start in (1, 9)
    ]
    u1 = (slices[0] + F.lit(1.0)) / F.lit(4294967296.0)
    u2 = slices[1] / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2) * F.lit(sigma)


def named_rows(spark: SparkSession, column: str, names: list[str]) -> DataFrame:
    """A DataFrame holding a fixed list of labels with their position.

    SQL VALUES becomes a local relation, whose size the planner knows.
    """
    rows = ", ".join(f"('{name}', {i})" for i, name in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({column}, position)")
