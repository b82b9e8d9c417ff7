"""Streaming reports over sales lines arriving as files equal the batch reports."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tally.plans import reports
from tally.sources.adapters import sales_lines
from tally.streaming import additive_reports, distinct_reports, finish, latest, read_line_stream, start_reports

DATA = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    lines = sales_lines(spark, DATA, ["order_id", "order_date", "sales", "profit", "category", "size",
                                      "quantity"])
    src = str(tmp_path / "incoming")
    # Land the lines as four files, as an upstream job would.
    lines.repartition(4, "order_id").write.parquet(src)
    stream = read_line_stream(spark, src, lines.schema, max_files_per_trigger=1)
    qs = start_reports(stream, None, str(tmp_path / "ckpt"), memory=True,
                       names=["sales_by_month", "quantity_by_category"])
    finish(qs)
    got = {r.order_month: float(r.sales) for r in spark.table("sales_by_month").collect()}
    want = {r.order_month: r.sales for r in reports.sales_by_month(spark, DATA).collect()}
    assert got == want
    got_q = {r.category: r.quantity for r in spark.table("quantity_by_category").collect()}
    want_q = {r.category: r.quantity for r in reports.quantity_by_category(spark, DATA).collect()}
    assert got_q == want_q


def test_stream_to_parquet_sink(spark, tmp_path):
    lines = sales_lines(spark, DATA, ["order_id", "order_date", "sales", "profit", "category", "size",
                                      "quantity"])
    src = str(tmp_path / "incoming")
    lines.repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    stream = read_line_stream(spark, src, lines.schema)
    finish(start_reports(stream, out, str(tmp_path / "ckpt"), names=["category_size_cells"],
                         trigger_once=True))
    cells = latest(spark, f"{out}/category_size_cells")
    total = cells.agg(F.sum("revenue")).first()[0]
    assert total == lines.agg(F.sum("sales")).first()[0]
    assert set(additive_reports()) >= {"sales_by_month", "category_size_cells"}


def test_stream_resumes_from_checkpoint(spark, tmp_path):
    """Stop after the first files, land more, restart on the same checkpoint: no line counted twice."""
    lines = sales_lines(spark, DATA, ["order_id", "order_date", "sales", "profit", "category", "size",
                                      "quantity"])
    src = tmp_path / "incoming"
    parts = lines.randomSplit([0.5, 0.5], seed=7)
    parts[0].write.parquet(str(src / "a"))
    schema = lines.schema
    ckpt, out = str(tmp_path / "ckpt"), str(tmp_path / "out")

    def run():
        stream = read_line_stream(spark, str(src / "*"), schema)
        finish(start_reports(stream, out, ckpt, names=["sales_by_category"], trigger_once=True))
        return {r.category: r.sales for r in latest(spark, f"{out}/sales_by_category").collect()}

    first = run()
    parts[1].write.parquet(str(src / "b"))
    second = run()
    want = {r.category: r.sales for r in lines.groupBy("category").agg(F.sum("sales").alias("sales")).collect()}
    assert second == want and first != second


def land(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    import glob
    import shutil
    os.makedirs(folder, exist_ok=True)
    shutil.copy(glob.glob(f"{folder}-{name}/*.parquet")[0], f"{folder}/{name}.parquet")


def orders_of(df, key):
    return {r[key]: r.orders for r in df.collect()}


def test_distinct_orders_over_restarts_and_repeated_files(spark, tmp_path):
    """An order whose lines come in several files, or in a file that lands twice, counts once."""
    lines = sales_lines(spark, DATA, ["order_id", "line_number", "order_date"])
    src, out, ckpt = (str(tmp_path / x) for x in ("incoming", "out", "ckpt"))
    parts = [lines.where(F.pmod(F.xxhash64("order_id", "line_number"), F.lit(3)) == k) for k in range(3)]
    for turn, files in enumerate(([(0, "a"), (0, "again")], [(1, "b"), (0, "later"), (None, "hot")], [(2, "c")])):
        for k, name in files:
            # many lines of one order
            land(parts[k] if k is not None else parts[0].limit(1).crossJoin(spark.range(3000)).drop("id"), src, name)
        stream = read_line_stream(spark, src, lines.schema, max_files_per_trigger=1)
        finish(start_reports(stream, out, ckpt, reports=distinct_reports(), trigger_once=True))  # a restart each turn
        seen = parts[0] if turn == 0 else parts[0].unionByName(parts[1])
        if turn < 2:
            want = seen.groupBy(F.date_format("order_date", "EEEE").alias("weekday")).agg(F.count_distinct("order_id").alias("orders"))
            assert orders_of(latest(spark, f"{out}/orders_by_weekday"), "weekday") == orders_of(want, "weekday")
    batch = {r.weekday: r.orders for r in reports.orders_by_weekday(spark, DATA).collect()}
    assert orders_of(latest(spark, f"{out}/orders_by_weekday"), "weekday") == batch
    batch = {r.month_name: r.orders for r in reports.orders_by_month(spark, DATA).collect() if r.orders}
    assert orders_of(latest(spark, f"{out}/orders_by_month"), "month_name") == batch


def test_distinct_orders_with_bounded_state(spark, tmp_path):
    """Within the delay an id counts once; state older than the watermark is dropped."""
    rows = [(1, "2024-01-01", "2024-01-01 10:00:00"), (1, "2024-01-01", "2024-01-01 10:05:00"), (2, "2024-01-01", "2024-01-01 10:06:00"),
            (None, "2024-01-01", "2024-01-01 10:06:00")]
    later = [(3, "2024-01-08", "2024-01-08 09:00:00"), (4, "2024-01-02", "2024-01-08 09:00:00")]
    frame = lambda r: spark.createDataFrame(r, "order_id long, day string, seen string").select(
        "order_id", F.to_date("day").alias("order_date"), F.to_timestamp("seen").alias("seen"))
    src = str(tmp_path / "incoming")
    schema = frame(rows).schema
    for name, part in (("a", rows), ("b", later), ("c", later[:1])):
        land(frame(part), src, name)
        stream = read_line_stream(spark, src, schema, max_files_per_trigger=1)
        qs = start_reports(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), reports=distinct_reports(expiry=("seen", "1 hour")),
                           names=["orders_by_weekday"], trigger_once=True)
        finish(qs)
    assert orders_of(latest(spark, f"{tmp_path}/out/orders_by_weekday"), "weekday") == {"Monday": 3, "Tuesday": 1}
    held = qs["orders_by_weekday"].lastProgress["stateOperators"]
    assert min(s["numRowsTotal"] for s in held) <= 3
