"""Physical-plan checks: no Python in the plan, no cartesian products, pruned scans,
top-k without a global sort, and the shuffle shapes of the large-dimension path."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from tally.plans import reports

D = "/root/testdata/sf0.01"
NAMES = sorted(reports.REPORTS)
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_jvm_only_and_pair_free(spark, name):
    text = plan(entry.queries()[name](spark, D))
    for node in FORBIDDEN:
        assert node not in text, f"{name}: {node}"


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith(("top5", "bottom5")) or n == "ingredient_top10"])
def test_top_k_is_take_ordered(spark, name):
    text = plan(entry.queries()[name](spark, D))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_scan_is_pruned_and_joins_only_what_is_needed(spark):
    text = plan(entry.queries()["sales_by_month"](spark, D))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in text
    assert "part.parquet" not in text and "customer.parquet" not in text


def test_small_dimension_is_broadcast(spark):
    text = plan(entry.queries()["sales_by_category"](spark, D))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_large_dimension_meets_pre_aggregated_lines(no_broadcast):
    text = plan(entry.queries()["sales_by_category"](no_broadcast, D))
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text
    # lines are summed per part key on both sides of the shuffle before the join
    assert text.count("Keys [1]: [l_partkey") >= 2


def test_distinct_after_join_reuses_join_partitioning(no_broadcast):
    text = plan(entry.queries()["orders_by_weekday"](no_broadcast, D))
    assert "SortMergeJoin" in text
    # Lines shrink to distinct order keys on the shuffle the join needs anyway; the
    # (weekday, order) dedupe of the distinct count reuses that partitioning.
    assert len(re.findall(r"hashpartitioning\(l_orderkey#\d+L?, \d+\)", text)) == 1
    assert not re.search(r"hashpartitioning\((weekday#\d+, l_orderkey|l_orderkey#\d+L?, weekday)", text)


def test_describe_uses_no_single_task_percentile(spark):
    text = plan(entry.queries()["numeric_describe"](spark, D))
    assert "percentile(" not in text.lower().replace("percentile_approx", "")


@pytest.mark.parametrize("name", ["profit_by_month", "sales_profit_by_segment", "sales_to_profit_ratio"])
def test_profit_shuffles_lines_once(no_broadcast, name):
    """Orders cost the one line-grain shuffle: lines meet part only folded to (group, part)."""
    text = plan(entry.queries()[name](no_broadcast, D))
    assert len(re.findall(r"hashpartitioning\(l_orderkey#\d+L?, \d+\)", text)) == 1
    # the shuffle by part comes after a partial aggregate that holds the group
    assert re.search(r"Keys \[2\]: \[(order_month|segment)#\d+, l_partkey#\d+L?\]", text)


def _mixed(spark):
    """Lines of which a third hold one part, and a part table."""
    from pyspark.sql import functions as F
    lines = spark.range(0, 16000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 999).cast("long").alias("l_partkey"),
                                               F.col("id").alias("order_id"))
    return lines, spark.range(1000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("p_name"))


def test_lines_of_a_hot_part_are_not_shuffled(spark, no_broadcast):
    """The hot part's row goes to its lines; the others are joined by a shuffle, of both sides once."""
    from pyspark.sql import functions as F
    from tally.plans import star
    lines, part = _mixed(spark)
    joined = star.split_join(lines, part, "l_partkey", "p_partkey")
    want = lines.join(part, lines.l_partkey == part.p_partkey)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, want.collect()))
    text = plan(joined)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text and "Generate" not in text
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 16000 and max(sizes) < 3500
    assert [r.key for r in star.hot_keys(lines, "l_partkey").collect()] == [7]


def test_no_hot_part_and_repeated_keys_join_plainly(spark, no_broadcast):
    from tally.plans import star
    lines, part = _mixed(spark)
    even = lines.where("l_partkey <> 7")
    assert star.hot_keys(even, "l_partkey") is None
    assert "BroadcastHashJoin" not in plan(star.split_join(even, part, "l_partkey", "p_partkey"))
    twice = part.unionByName(part)
    assert star.split_join(lines, twice, "l_partkey", "p_partkey").count() == 32000


def test_describe_scans_twice(spark):
    """One scan sketches, one counts: the plan of each reads the table once, and the result reads it no more."""
    from tally.operators import quantiles
    from tally.operators.profiling import DESCRIBE_PROBS, numeric_columns
    lines = spark.read.parquet(f"{D}/lineitem.parquet")
    cols = numeric_columns(lines)
    counts, state = quantiles.bracketed_counts(lines, cols, DESCRIBE_PROBS)
    assert plan(quantiles._counted(lines, cols, state)).count("Scan parquet") <= 2  # tree and details
    assert counts.count() < lines.count() / 2  # of the insides alone
    assert "Scan parquet" not in plan(entry.queries()["numeric_describe"](spark, D))


def test_share_total_reuses_the_aggregate(spark):
    df = entry.queries()["sales_share_by_category"](spark, D)
    df.collect()
    text = plan(df)  # final adaptive plan after execution
    assert "ReusedExchange" in text


def test_profit_of_lines_without_a_measure_is_the_same_in_both_plans(spark, tmp_path, request):
    """A line with a null or NaN price, discount or quantity has no profit, whatever the part table's size."""
    from tally.plans import reports
    src = "/root/testdata/sf0.001"
    for t in ("orders", "part", "customer"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    li = spark.read.parquet(f"{src}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(8)
    rows = [r.asDict() for r in li.collect()]
    gaps = [(c, v) for c in ("l_quantity", "l_extendedprice", "l_discount") for v in (None, float("nan"))]
    for r, (c, v) in zip(rows, gaps):
        r[c] = v
    spark.createDataFrame(rows, li.schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    price = {r.p_partkey: r.p_retailprice for r in spark.read.parquet(f"{src}/part.parquet").collect()}
    want = sum(r["l_extendedprice"] * (1 - r["l_discount"]) - r["l_quantity"] * price[r["l_partkey"]] for r in rows[len(gaps):])
    names = ("profit_by_month", "sales_profit_by_segment", "profit_by_category", "profit_by_subcategory")
    run = lambda: {n: sorted(map(tuple, reports.REPORTS[n](spark, str(tmp_path)).collect()), key=repr) for n in names}
    small = run()
    request.getfixturevalue("no_broadcast")
    assert run() == small
    for n in names:
        assert abs(sum(r[-1] for r in small[n]) - float(want)) < 1e-6, n


@pytest.mark.parametrize("name", ["sales_profit_by_segment", "sales_to_profit_ratio"])
def test_lines_are_not_shuffled_by_customer(no_broadcast, name):
    """Orders meet customers before lines: two exchanges are at line grain, by order and by (segment, part)."""
    text = plan(entry.queries()[name](no_broadcast, D))
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+)\((.*?), \d+\)", text)
    by = {re.sub(r"#\d+L?", "", keys): re.sub(r"#\d+L?", "", columns).split(", ") for columns, _, keys in exchanges}
    assert by["o_custkey"] == ["o_orderkey", "o_custkey"] and by["o_orderkey"] == ["o_orderkey", "segment"]
    assert by["l_orderkey"] == ["l_orderkey", "l_partkey", "price", "discount", "units"]
    assert set(by) == {"o_custkey", "c_custkey", "o_orderkey", "l_orderkey", "segment, l_partkey", "l_partkey", "p_partkey", "segment",
                       "segment ASC NULLS FIRST"}


def test_segments_with_repeated_and_missing_keys(spark, tmp_path, request):
    """Every match of a line counts, whatever the part table's size; rows without a key or a segment have none."""
    from collections import defaultdict
    part = [(1, 10.5), (2, 0.25), (2, 3.0), (None, 9.0), (4, None), (5, float("nan")), *((k, 1.0) for k in range(10, 40))]
    customers = [(1, "A"), (1, "B"), (2, "A"), (3, None), (None, "C"), (4, "D")]
    orders = [(1, 1), (1, 2), (2, 2), (3, 3), (4, None), (None, 1), (5, 4), (6, 99)]
    lines = [(o, p, q, x, y) for o in (1, 2, 3, 4, 5, 6, 7, None) for p in (1, 2, 4, 5, 6, None)
             for q, x, y in ((3.0, 100.25, 0.05), (None, 7.0, 0.1), (2.0, 5.5, None), (1.0, None, 0.0))]
    for name, rows, schema in (("part", part, "p_partkey long, p_retailprice double"), ("customer", customers, "c_custkey long, c_mktsegment string"),
                               ("orders", orders, "o_orderkey long, o_custkey long"),
                               ("lineitem", lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sales, profit = defaultdict(int), defaultdict(int)
    for o, p, q, x, y in lines:
        for seg in (s for k, c in orders if k == o is not None for c2, s in customers if c2 == c is not None and s):
            for price in (r for k, r in part if k == p is not None):
                sales[seg] += round((x or 0) * 100)
                if None not in (q, x, y, price) and price == price:
                    profit[seg] += round(x * 100) * (100 - round(y * 100)) - round(q * 100) * round(price * 100)
    want = sorted((s, sales[s] / 100, profit[s] / 10000) for s in sales)
    run = lambda: [tuple(r) for r in reports.sales_profit_by_segment(spark, str(tmp_path)).collect()]
    small = run()
    request.getfixturevalue("no_broadcast")
    large = run()
    spark.conf.set("tally.broadcast.maxBytes", "1000")  # the orders fit, the parts do not; the fixture unsets it
    assert "BroadcastHashJoin" in plan(reports.sales_profit_by_segment(spark, str(tmp_path)))
    between = run()
    assert [r[0] for r in want] == ["A", "B", "D"]
    assert [(s, pytest.approx(a), pytest.approx(b)) for s, a, b in want] == small
    assert small == large == between
