"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Write one result as parquet. Overwriting has to be asked for."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
