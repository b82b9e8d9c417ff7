"""Lines and orders bucketed by order: same rows, and no exchange below their join."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tally.plans import reports
from tally.sources import layout
from tally.sources.parquet import read_table

SRC = "/root/testdata/sf0.001"
ORDER_REPORTS = ("sales_by_month", "profit_by_month", "revenue_by_weekday", "orders_by_weekday", "orders_by_month",
                 "weekday_revenue_labels")


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    return layout.write_layout(spark, SRC, str(tmp_path_factory.mktemp("laid") / "sf.layout"), buckets=6)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of the lines on one order, and lines without an order; as plain tables and laid out."""
    src = str(tmp_path_factory.mktemp("skewed"))
    for t in ("orders", "part", "customer", "events"):
        spark.read.parquet(f"{SRC}/{t}.parquet").write.parquet(f"{src}/{t}.parquet")
    lines = spark.read.parquet(f"{SRC}/lineitem.parquet")
    hot = lines.agg(F.min("l_orderkey")).first()[0]
    key = F.when(F.col("l_linenumber") % 3 == 1, F.lit(hot)).when(F.col("l_quantity") == 7, None).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", key).write.parquet(f"{src}/lineitem.parquet")
    return src, layout.write_layout(spark, src, f"{src}.layout", buckets=8)


def rows(spark, name, folder):
    return [tuple(r) for r in reports.REPORTS[name](spark, folder).collect()]


def plan_text(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def below_join(text: str) -> str:
    """The lines of a plan's tree below its line-with-order join."""
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if re.search(r"SortMergeJoin \[l_orderkey", x))
    depth = len(re.match(r"[\s:|+*()\d-]*", lines[at]).group())
    return "\n".join(x for x in lines[at + 1:] if len(re.match(r"[\s:|+*()\d-]*", x).group()) > depth)


@pytest.mark.parametrize("name", [*ORDER_REPORTS, "calendar_parts", "kpi_summary", "sales_by_category",
                                  "sales_profit_by_segment", "top5_by_orders", "orders_by_hour"])
def test_same_rows(spark, laid_out, name):
    assert sorted(rows(spark, name, laid_out), key=repr) == sorted(rows(spark, name, SRC), key=repr)


@pytest.mark.parametrize("name", ORDER_REPORTS)
def test_no_exchange_below_the_order_join(spark, laid_out, name):
    below = below_join(plan_text(reports.REPORTS[name](spark, laid_out)))
    assert below.count("FileScan parquet") >= 2 and "Bucketed: true" in below
    assert not re.search(r"(?<!Broadcast)Exchange", below), below


def test_no_exchange_at_line_grain(no_broadcast, laid_out):
    """With a large part table the profit's lines meet their orders at line grain, bucket by bucket."""
    below = below_join(plan_text(reports.profit_by_month(no_broadcast, laid_out)))
    assert "Exchange" not in below
    assert rows(no_broadcast, "profit_by_month", laid_out) == rows(no_broadcast, "profit_by_month", SRC)


@pytest.mark.parametrize("name", [*ORDER_REPORTS, "kpi_summary", "calendar_parts", "first_rows"])
def test_hot_orders_are_stored_apart(spark, skewed, name):
    src, folder = skewed
    assert layout.open_layout(spark, folder).hot
    assert sorted(rows(spark, name, folder), key=repr) == sorted(rows(spark, name, src), key=repr)


def test_hot_keys_are_few_and_in_one_part(spark, skewed):
    src, folder = skewed
    (cold, _, alike), (hot, orders, apart) = layout.order_parts(spark, folder)
    assert alike and not apart and 1 <= orders.count() < 8
    n = spark.read.parquet(f"{src}/lineitem.parquet").count()
    assert hot.count() >= n / 4 and cold.count() + hot.count() == n
    assert cold.select("l_orderkey").intersect(hot.select("l_orderkey")).count() == 0
    files = spark.read.parquet(f"{folder}/lineitem").select(F.input_file_name()).distinct().count()
    assert files <= 8  # one a bucket


def test_opened_in_another_session(spark, laid_out):
    """A session that did not write the layout makes its tables known from the manifest."""
    for t in layout.KEYS:
        spark.sql(f"DROP TABLE {layout._table_name(laid_out, t)}")
    layout._opened.clear()
    assert layout.open_layout(spark, laid_out).buckets == 6
    assert read_table(spark, laid_out, "lineitem").count() == read_table(spark, SRC, "lineitem").count()
    assert "Bucketed: true" in plan_text(reports.sales_by_month(spark, laid_out))


def test_folder_name(spark, tmp_path):
    with pytest.raises(ValueError):
        layout.write_layout(spark, SRC, str(tmp_path / "plain"))
