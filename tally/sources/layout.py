"""Orders and their lines laid out by order key, so that the two join without a shuffle.

``write_layout`` stores lineitem and orders as Parquet bucketed on the order key, into equally
many buckets and sorted within each.  A bucket of lines then meets its bucket of orders in one task, and
neither table is exchanged.  A bucket holds all rows of its keys, so keys too large for
that (more lines than an average bucket; at most as many keys as buckets) are stored
apart with their orders, few enough to broadcast.

A layout is a folder whose name ends in ``.layout``; it serves as a data folder.  Its other tables
are those of the folder it was made from.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import ensure_checkpoint_dir

SUFFIX = ".layout"
#: The tables of a layout and their bucketing key.
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
_MANIFEST = "name string, schema string, buckets int, hot boolean, source string"


@dataclass(frozen=True)
class Layout:
    source: str
    buckets: int
    schemas: dict
    hot: bool


_opened: dict[tuple[str, str], Layout] = {}


def is_layout(data_dir: str) -> bool:
    return data_dir.rstrip("/").endswith(SUFFIX)


def _table_name(folder: str, table: str) -> str:
    return f"tally_{hashlib.sha1(folder.encode()).hexdigest()[:16]}_{table}"


def write_layout(spark: SparkSession, data_dir: str, folder: str, buckets: int | None = None) -> str:
    """Store ``data_dir``'s lines and orders in ``folder`` (named ``*.layout``), and return it.

    ``buckets`` (the session's shuffle partitions unless given) should leave a bucket of lines fit for one
    task's sort, some 128 MB or a few of that.  The rows are shuffled once, here; each bucket becomes one file.
    """
    folder = folder.rstrip("/")
    if not is_layout(folder):
        raise ValueError(f"a layout's folder ends in {SUFFIX}: {folder}")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = {t: spark.read.parquet(f"{data_dir.rstrip('/')}/{t}.parquet") for t in KEYS}
    lines = frames["lineitem"]
    rows = lines.count()
    lines.groupBy(F.col(KEYS["lineitem"]).alias("key")).count().where(F.col("count") * n > F.lit(rows)).select("key") \
        .coalesce(1).write.mode("overwrite").parquet(f"{folder}/hot_keys")
    keys = spark.read.parquet(f"{folder}/hot_keys")  # fewer than n rows: their lines are over rows / n each
    hot = keys.count() > 0
    for table, key in KEYS.items():
        df, large = frames[table], F.broadcast(keys)
        same = df[key].eqNullSafe(large["key"])
        if hot:
            df.join(large, same, "left_semi").write.mode("overwrite").parquet(f"{folder}/hot_{table}")
            df = df.join(large, same, "left_anti")
        name = _table_name(folder, table)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (df.repartition(n, key).write.mode("overwrite").format("parquet").option("path", f"{folder}/{table}")
         .bucketBy(n, key).sortBy(key).saveAsTable(name))
    known = [(t, frames[t].schema.toDDL(), n, hot, data_dir) for t in KEYS]
    spark.createDataFrame(known, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    _opened.pop((spark.sparkContext.applicationId, folder), None)
    return folder


def open_layout(spark: SparkSession, folder: str) -> Layout:
    """The layout of a folder; its bucketed tables are made known to the session's catalog."""
    folder = folder.rstrip("/")
    at = spark.sparkContext.applicationId, folder
    if at not in _opened:
        rows = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").collect()  # one row a table
        for r in rows:
            key = KEYS[r.name]
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_table_name(folder, r.name)} ({r.schema}) USING parquet "
                      f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {r.buckets} BUCKETS LOCATION '{folder}/{r.name}'")
        _opened[at] = Layout(rows[0].source, rows[0].buckets, {r.name: r.schema for r in rows}, rows[0].hot)
    return _opened[at]


def _hot(spark: SparkSession, folder: str, layout: Layout, table: str) -> DataFrame:
    return spark.read.schema(layout.schemas[table]).parquet(f"{folder}/hot_{table}")


def layout_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows of a table: of the layout, or of the folder that it was made from."""
    folder = folder.rstrip("/")
    layout = open_layout(spark, folder)
    if name not in KEYS:
        return spark.read.parquet(f"{layout.source.rstrip('/')}/{name}.parquet")
    df = spark.table(_table_name(folder, name))
    return df.unionByName(_hot(spark, folder, layout, name)) if layout.hot else df


def order_parts(spark: SparkSession, folder: str) -> list[tuple[DataFrame, DataFrame, bool]]:
    """(lines, orders, bucketed alike?) of each part of a layout; no key is in two parts."""
    folder = folder.rstrip("/")
    layout = open_layout(spark, folder)
    parts = [(*(spark.table(_table_name(folder, t)) for t in KEYS), True)]
    if layout.hot:
        parts.append((*(_hot(spark, folder, layout, t) for t in KEYS), False))
    return parts


def derived_layout(spark: SparkSession, data_dir: str) -> str:
    """``data_dir`` laid out in the session's shared checkpoint folder: written when first asked for, and
    again once its files differ."""
    frames = [spark.read.parquet(f"{data_dir.rstrip('/')}/{t}.parquet") for t in KEYS]
    files = [(sorted(f.inputFiles()), str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for f in frames]
    n = spark.conf.get("spark.sql.shuffle.partitions")
    name = hashlib.sha1(repr((data_dir, n, files)).encode()).hexdigest()[:16]
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}{SUFFIX}"
    if (spark.sparkContext.applicationId, folder) not in _opened:
        open_layout(spark, write_layout(spark, data_dir, folder))
    return folder


__all__ = ["Layout", "write_layout", "open_layout", "layout_table", "order_parts", "derived_layout", "is_layout"]
