"""The additive reports kept up to date over a stream of new order-line files.

New Parquet files landing in a folder are read as a stream; each report that is
a sum or a line count per key (monthly sales and profit, sales by category,
units by category, the size pivot's cells) is maintained by Spark's stateful
streaming aggregation.  State and progress live under ``checkpoint`` (shared
storage on a cluster), so a restarted or partly lost query resumes where it
stopped.  Results go to a ``foreachBatch`` writer, one Parquet folder per epoch and
report; ``latest`` reads the last complete one, so that there always is an answer.
In tests they may go to a memory table.

Distinct orders per key do not add up over files: ``distinct_reports`` keeps each (key, order) seen
in the state store, so that an order counts once however many files, or repeats of a file, hold
its lines.  With an event time, ids are forgotten once they are older than the watermark: bounded state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tally.functions.calendar import month_name, month_number, weekday_name
from tally.operators.aggregate import sum_by

StreamReport = Callable[[DataFrame], DataFrame]


def additive_reports(date_col: str = "order_date") -> dict[str, StreamReport]:
    """Reports over a stream of canonical sales lines (``sources.adapters`` names)."""
    return {
        "sales_by_month": lambda s: sum_by(s.withColumn("order_month", month_number(date_col)),
                                           "order_month", {"sales": "sales"}),
        "profit_by_month": lambda s: sum_by(s.withColumn("order_month", month_number(date_col)),
                                            "order_month", {"profit": "profit"}),
        "sales_by_category": lambda s: sum_by(s, "category", {"sales": "sales"}),
        "quantity_by_category": lambda s: sum_by(s, "category", {"quantity": "quantity"}),
        "category_size_cells": lambda s: sum_by(s, ["category", "size"], {"revenue": "sales"}),
    }


def distinct_reports(date_col: str = "order_date", id_col: str = "order_id", expiry: tuple[str, str] | None = None
                     ) -> dict[str, StreamReport]:
    """Distinct orders by weekday and by month over a stream of sales lines, exact across batches and restarts.

    The state holds one row a (key, id), dealt by their hash: a key that holds a third of all lines spreads
    over its ids.  ``expiry`` (timestamp column, delay as in ``"30 days"``) bounds it: an id is forgotten that long after
    it was first seen, and one that comes back later counts again; lines later than the watermark are left out.
    """
    def counted(key: str, of: Callable) -> StreamReport:
        def report(s: DataFrame) -> DataFrame:
            extra = []
            if expiry:
                extra = [expiry[0]]
                s = s.withWatermark(*expiry)
            keyed = s.withColumn(key, of(date_col)).select(key, id_col, *extra)
            keyed = keyed.where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
            once = keyed.dropDuplicatesWithinWatermark([key, id_col]) if expiry else keyed.dropDuplicates([key, id_col])
            return once.groupBy(key).agg(F.count(F.lit(1)).alias("orders"))
        return report

    return {"orders_by_weekday": counted("weekday", weekday_name), "orders_by_month": counted("month_name", month_name)}


def read_line_stream(spark: SparkSession, folder: str, schema: T.StructType,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


KEPT_EPOCHS = 2


def _folders(spark: SparkSession, path: str) -> dict[int, object]:
    """Complete epoch folders (those with a success marker) under a report's folder."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return {}
    found = {}
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("epoch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found[int(name[6:])] = f.getPath()
    return found


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete answer of a report."""
    folders = _folders(spark, path)
    if not folders:
        raise FileNotFoundError(f"no complete epoch under {path}")
    return spark.read.parquet(folders[max(folders)].toString())


def _write_epochs(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch_id: int) -> None:
        # Complete mode hands over the whole current answer; a repeated epoch replaces its own folder.
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/epoch-{epoch_id}")
        folders = _folders(spark, path)
        for old in sorted(folders)[:-KEPT_EPOCHS]:
            folders[old].getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folders[old], True)
    return write


def start_reports(lines: DataFrame, out_dir: str | None, checkpoint: str,
                  reports: Mapping[str, StreamReport] | None = None,
                  names: Sequence[str] | None = None, memory: bool = False,
                  trigger_once: bool = False) -> dict[str, StreamingQuery]:
    """Start one streaming aggregation per report; returns the running queries.

    ``memory=True`` writes to in-memory tables named after the reports (tests).
    """
    reports = dict(reports or additive_reports())
    queries = {}
    for name in names or list(reports):
        agg = reports[name](lines)
        w = (agg.writeStream.outputMode("complete")
             .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
             .queryName(name))
        if trigger_once:
            w = w.trigger(availableNow=True)
        if memory:
            w = w.format("memory")
        else:
            w = w.foreachBatch(_write_epochs(f"{out_dir.rstrip('/')}/{name}"))
        queries[name] = w.start()
    return queries


def finish(queries: Mapping[str, StreamingQuery]) -> None:
    """Process everything available, then stop."""
    for q in queries.values():
        q.processAllAvailable()
        q.stop()


__all__ = ["additive_reports", "distinct_reports", "read_line_stream", "start_reports", "finish", "latest"]
