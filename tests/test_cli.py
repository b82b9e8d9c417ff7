"""The command-line runner writes one result per report."""

from __future__ import annotations

from tally.__main__ import main


def test_runner_writes_reports(spark, tmp_path):
    out = tmp_path / "res"
    assert main(["--data", "/root/testdata/sf0.001", "--out", str(out), "kpi_summary", "top5_by_revenue"]) == 0
    assert spark.read.parquet(str(out / "kpi_summary")).count() == 1
    assert spark.read.parquet(str(out / "top5_by_revenue")).count() == 5


def test_runner_reads_a_restaurant_csv(spark, tmp_path):
    from tests.test_notebook import PIZZA_CSV
    src = tmp_path / "orders.csv"
    src.write_text(PIZZA_CSV)
    out = tmp_path / "res"
    assert main(["--restaurant-csv", str(src), "--sizes", "S,M,L", "--out", str(out),
                 "kpi_summary", "orders_by_weekday", "category_size_pivot"]) == 0
    assert spark.read.parquet(str(out / "orders_by_weekday")).count() == 7
    assert spark.read.parquet(str(out / "category_size_pivot")).columns == ["category", "L", "M", "S"]


def test_runner_explains_cluster_plans(spark, capsys):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert main(["--data", "/root/testdata/sf0.001", "--explain", "--no-broadcast", "sales_by_category"]) == 0
    finally:  # --no-broadcast changes the shared session's settings
        spark.conf.unset("tally.broadcast.maxBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    out = capsys.readouterr().out
    assert "### sales_by_category" in out and "SortMergeJoin" in out and "BroadcastHashJoin" not in out
