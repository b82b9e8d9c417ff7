"""Hot keys: a third of all lines on one order and one part.

The tables are derived by Spark from the sf0.01 tables and written once; every
report runs on the shuffle-only plan (no broadcast) and is compared with DuckDB
on the same files.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SRC = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    for t in ("orders", "part", "customer", "events"):
        spark.read.parquet(f"{SRC}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    li = spark.read.parquet(f"{SRC}/lineitem.parquet")
    hot = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey") % 3 == 0
    skewed = li.select(*[F.when(hot, F.lit(7).cast("bigint")).otherwise(F.col(c)).alias(c)
                         if c in ("l_orderkey", "l_partkey") else F.col(c) for c in li.columns])
    skewed.write.parquet(f"{out}/lineitem.parquet")
    return str(out)


def test_fixture_is_skewed(spark, skewed_dir):
    li = spark.read.parquet(f"{skewed_dir}/lineitem.parquet")
    top = li.groupBy("l_orderkey").count().orderBy(F.desc("count")).first()
    assert top["count"] > li.count() / 4


NAMES = ["sales_by_month", "profit_by_month", "orders_by_weekday", "orders_by_month", "sales_by_category",
         "profit_by_subcategory", "ingredient_counts", "sales_profit_by_segment", "kpi_summary",
         "category_size_pivot", "brand_size_pivot_filled", "top5_by_orders", "bottom5_by_quantity",
         "numeric_describe", "first_rows", "top5_by_orders_pruned", "bottom5_by_orders_pruned", "ingredient_top10_certified",
         "sales_by_month_laid_out", "orders_by_weekday_laid_out", "orders_by_weekday_sketched"]


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_no_broadcast(no_broadcast, skewed_dir, name):
    con = duck(skewed_dir)
    problems, _ = compare(no_broadcast, con, name, entry.queries()[name], entry.oracle_sql()[name], skewed_dir)
    assert not problems, problems
