"""Result sinks: every report is a DataFrame written by Spark, never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a report, one file a task."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
