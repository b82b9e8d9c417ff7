"""The additive reports from one stored roll-up equal those from the lines."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tally.__main__ import main
from tally.plans import cube, reports

SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rolled(spark, tmp_path_factory):
    stored = cube.build_cube(spark, SRC, str(tmp_path_factory.mktemp("cube") / "cube"))
    return cube.cube_reports(spark, SRC, stored)


def text(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


NAMES = sorted(cube.cube_reports(None, "", None))


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_the_direct_report(spark, rolled, name):
    got, want = rolled[name], reports.REPORTS[name](spark, SRC)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect()))
    assert "lineitem" not in text(got) and "l_extendedprice" not in text(got)


def test_what_does_not_add_up_is_refused(spark, tmp_path):
    stored = cube.build_cube(spark, SRC, str(tmp_path / "c"))
    for keys, measures in ((["order_month"], ["orders"]), (["order_day"], ["sales"])):
        with pytest.raises(cube.NotDerivable):
            cube.derive(spark, SRC, stored, keys, measures)
    with pytest.raises(cube.NotDerivable):
        cube.derive(spark, SRC, stored.drop("qty"), ["segment"], ["profit"])


def test_lines_without_order_and_repeated_keys(spark, tmp_path):
    src = str(tmp_path)
    for t in ("part", "customer"):
        spark.read.parquet(f"{SRC}/{t}.parquet").write.parquet(f"{src}/{t}.parquet")
    orders, lines = (spark.read.parquet(f"{SRC}/{t}.parquet") for t in ("orders", "lineitem"))
    some = orders.where(F.col("o_orderkey") % 2 == 0)
    some.write.parquet(f"{src}/orders.parquet")
    lines.withColumn("l_quantity", F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_quantity"))).write.parquet(f"{src}/lineitem.parquet")
    rolled = cube.cube_reports(spark, src, cube.build_cube(spark, src, f"{src}/cube"))
    for name in ("sales_by_month", "profit_by_month", "sales_by_category", "profit_by_category", "sales_profit_by_segment", "ingredient_top10"):
        assert list(map(tuple, rolled[name].collect())) == list(map(tuple, reports.REPORTS[name](spark, src).collect())), name
    some.unionByName(some.limit(3)).write.mode("overwrite").parquet(f"{src}/twice")
    doubled = spark.read.parquet(f"{src}/twice").cache()
    doubled.count()
    doubled.write.mode("overwrite").parquet(f"{src}/orders.parquet")
    with pytest.raises(ValueError, match="not unique"):
        cube.build_cube(spark, src, f"{src}/cube2")


def test_runner(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert main(["--data", SRC, "--out", out, "--cube", "--layout", "sales_by_month", "top5_by_revenue"]) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{out}/sales_by_month").orderBy("order_month").collect()] == [
        tuple(r) for r in reports.sales_by_month(spark, SRC).collect()]
    with pytest.raises(SystemExit):
        main(["--data", SRC, "--out", out, "--cube", "orders_by_hour"])
