"""Parquet tables of a data folder (``<dir>/<table>.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.sources.layout import is_layout, layout_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Lazy scan; Catalyst prunes columns and pushes filters into it.

    The files are listed at each call: files that land later are in the next one.  A folder
    written by ``layout.write_layout`` gives its bucketed tables.
    """
    if is_layout(data_dir):
        return layout_table(spark, data_dir, name)
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
