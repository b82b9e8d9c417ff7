"""pandas-vs-Spark semantic traps, one test per trap, on toy rows."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tally.functions import (
    format_fixed, hour_of_time, month_name, parse_date, safe_ratio, split_literal,
    strip_whitespace, weekday_name, weekday_number,
)
from tally.operators import (
    count_distinct_by, describe_numeric, over_domain, pivot_sum, sum_by, token_counts, top_k,
)
from tally.sources.csv import read_csv_text, read_csv_typed

ERRORS = (PySparkException, Py4JJavaError)


def _csv(tmp_path, text, name="in.csv", encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_t1_quotes_and_newlines(spark, tmp_path):
    path = _csv(tmp_path, 'id,txt\n1,"x ""q"" y"\n2,"line one\nline two"\n')
    rows = read_csv_text(spark, path, multiline=True).orderBy("id").collect()
    assert [r.txt for r in rows] == ['x "q" y', "line one\nline two"]


def test_t2_null_tokens(spark, tmp_path):
    path = _csv(tmp_path, "k,v\na,NA\nb,N/A\nc,None\nd,null\ne,\nf,-\ng,na\n")
    rows = dict(read_csv_typed(spark, path, {"k": None, "v": None}).collect())
    assert rows == {"a": None, "b": None, "c": None, "d": None, "e": None, "f": "-", "g": "na"}


def test_latin1_source(spark, tmp_path):
    path = _csv(tmp_path, "Category,Sales\nCafé,1.50\n", encoding="latin-1")
    df = read_csv_typed(spark, path, {"Category": None, "Sales": "decimal(18,2)"}, encoding="ISO-8859-1")
    r = df.first()
    assert df.columns == ["category", "sales"] and r.category == "Café" and float(r.sales) == 1.5


def test_t3_t5_null_keys_and_empty_sums(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 5.0), ("c", None), ("b", 2.0)], "k string, v double")
    got = {r.k: r.v for r in sum_by(df, "k", {"v": "v"}).collect()}
    assert got == {"a": 0.0, "b": 3.0, "c": 0.0}


def test_t5_nan_is_skipped(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "k string, v double")
    got = {r.k: r.v for r in sum_by(df, "k", {"v": "v"}).collect()}
    assert got == {"a": 2.0, "b": 0.0}


def test_t4_division_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = [r.x for r in df.select(safe_ratio("a", "b").alias("x")).collect()]
    assert got[0] == math.inf and math.isnan(got[1]) and got[2] == -math.inf and got[3] == 1.5
    nulls = [r.x for r in df.select(safe_ratio("a", "b", on_zero="null").alias("x")).collect()]
    assert nulls[:3] == [None, None, None]


def test_t6_day_first_dates(spark):
    df = spark.createDataFrame([("02-01-2015",), ("13-01-2015",)], "s string")
    got = [r.d for r in df.select(parse_date("s", "d-M-yyyy").alias("d")).collect()]
    assert got == [date(2015, 1, 2), date(2015, 1, 13)]


def test_t6_unparseable_raises_or_nulls(spark):
    df = spark.createDataFrame([("02-01-2015",), ("13/1/2015",)], "s string")
    with pytest.raises(ERRORS):
        df.select(parse_date("s", "d-M-yyyy").alias("d")).collect()
    got = [r.d for r in df.select(parse_date("s", "d-M-yyyy", on_error="null").alias("d")).collect()]
    assert got == [date(2015, 1, 2), None]
    both = [r.d for r in df.select(parse_date("s", ["d-M-yyyy", "d/M/yyyy"]).alias("d")).collect()]
    assert both == [date(2015, 1, 2), date(2015, 1, 13)]


def test_t6_month_first_dates(spark):
    df = spark.createDataFrame([("11/8/2016",), ("6/12/2016",)], "s string")
    got = [r.d for r in df.select(parse_date("s", "M/d/yyyy").alias("d")).collect()]
    assert got == [date(2016, 11, 8), date(2016, 6, 12)]


def test_t7_hour_of_time(spark):
    df = spark.createDataFrame([("9:05:03",), ("23:59:59",), (None,)], "s string")
    assert [r.h for r in df.select(hour_of_time("s").alias("h")).collect()] == [9, 23, None]
    bad = spark.createDataFrame([("24:00:00",)], "s string")
    with pytest.raises(ERRORS):
        bad.select(hour_of_time("s").alias("h")).collect()


def test_t8_token_counts(spark):
    df = spark.createDataFrame([("a, b ,c",), ("b,\ta",), (None,), ("",), ("a,,",)], "s string")
    got = {r.token: r.n for r in token_counts(df, "s").collect()}
    assert got == {"a": 3, "": 3, "b": 2, "c": 1}
    dropped = {r.token: r.n for r in token_counts(df, "s", drop_empty=True).collect()}
    assert dropped == {"a": 3, "b": 2, "c": 1}


def test_t8_delimiter_is_literal_and_unicode_strip(spark):
    df = spark.createDataFrame([("x|y",), (" a ",)], "s string")
    pieces = df.select(split_literal("s", "|").alias("p")).collect()
    assert pieces[0].p == ["x", "y"]
    assert df.select(strip_whitespace("s").alias("t")).collect()[1].t == "a"


def test_t9_describe(spark):
    df = spark.createDataFrame([(1.0,), (None,), (10.0,), (4.0,)], "x double")
    r = describe_numeric(df, ["x"]).first()
    assert r.n == 3 and r.mean == 5.0 and r.min == 1.0 and r.max == 10.0
    assert abs(r.std - 4.58257569495584) < 1e-12
    assert (r.p25, r.p50, r.p75) == (2.5, 4.0, 7.0)


def test_t11_top_k_ties(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 3), ("e", 2), ("f", 3)], "k string, v int")
    assert [r.k for r in top_k(df, "v", 3, tie="k").collect()] == ["b", "c", "d"]
    assert [r.k for r in top_k(df, "v", 2, tie="k", ascending=True).collect()] == ["a", "e"]


def test_t13_zero_filled_domain(spark):
    from tally.functions.calendar import _dimension
    dom = _dimension(spark, ["Mon", "Tue", "Wed"], "day", "ordinal", 0)
    df = spark.createDataFrame([("Mon", "id1", 1.5), ("Zzz", "id2", 2.0), ("Tue", "id3", 3.0), ("Mon", "id1", 4.0)],
                               "day string, id string, v double")
    ids = over_domain(count_distinct_by(df, "day", "id", "n"), dom, "day", {"n": 0}, order_by="ordinal")
    assert [(r.day, r.n) for r in ids.collect()] == [("Mon", 1), ("Tue", 1), ("Wed", 0)]
    sums = over_domain(sum_by(df, "day", {"v": "v"}), dom, "day", {"v": 0.0}, order_by="ordinal")
    assert [r.v for r in sums.collect()] == [5.5, 3.0, 0.0]


def test_t15_pivot_fill(spark):
    df = spark.createDataFrame([("x", "S", 1), ("x", "L", 2), ("y", "S", 3), (None, "M", 9)], "i string, c string, v int")
    p = pivot_sum(df, "i", "c", "v")
    assert p.columns == ["i", "L", "S"]
    assert sorted(tuple(r) for r in p.collect()) == [("x", 2, 1), ("y", 0, 3)]


def test_d6_d8_calendar_names(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),)], "d date")
    r = df.select(weekday_number("d").alias("n"), weekday_name("d").alias("w"), month_name("d").alias("m")).first()
    assert (r.n, r.w, r.m) == (0, "Monday", "January")


def test_f1_f2_labels(spark):
    df = spark.createDataFrame([(1234567.125,), (2.675,), (12.25,), (float("inf"),)], "x double")
    money = [r.s for r in df.select(format_fixed("x", 2).alias("s")).collect()]
    assert money[:2] == ["1,234,567.12", "2.67"] and money[3] == "inf"
    pct = df.select(format_fixed("x", 1, thousands=False, suffix="%").alias("s")).collect()[2].s
    assert pct == "12.2%"
    assert df.select(format_fixed(F.lit(-5.0), 2, prefix="$").alias("s")).first().s == "$-5.00"


def test_whole_cents_and_split_units_are_exact(spark):
    from decimal import Decimal

    from tally.functions.measures import cents, from_cents, join_units, split_units
    df = spark.createDataFrame([(104949.50,), (-12.34,), (0.07,), (None,)], "x double")
    got = [r.d for r in df.select(from_cents(cents("x")).alias("d")).collect()]
    assert got == [Decimal("104949.50"), Decimal("-12.34"), Decimal("0.07"), None]
    units = spark.createDataFrame([(-123456789,), (987654321,), (5,)], "u bigint")
    whole, rem = split_units("u", 4)
    rows = units.select(whole.alias("w"), rem.alias("r"), join_units(whole, rem, 4).alias("v")).collect()
    assert [(r.w, r.r) for r in rows] == [(-12346, 3211), (98765, 4321), (0, 5)]
    assert [r.v for r in rows] == [Decimal("-12345.6789"), Decimal("98765.4321"), Decimal("0.0005")]
    sums = units.agg(F.sum(whole).alias("w"), F.sum(rem).alias("r")).select(join_units("w", "r", 4).alias("v"))
    assert sums.first().v == Decimal(-123456789 + 987654321 + 5) / 10000


def test_a2_approximate_distinct_is_opt_in(spark):
    from tally.operators import kpis
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    exact = count_distinct_by(lines, "l_returnflag", "l_orderkey", "n").collect()
    approx = count_distinct_by(lines, "l_returnflag", "l_orderkey", "n", rsd=0.02).collect()
    e, a = {r[0]: r.n for r in exact}, {r[0]: r.n for r in approx}
    assert e.keys() == a.keys() and all(abs(a[k] - e[k]) <= 0.1 * e[k] for k in e)
    k = kpis(lines, "l_extendedprice", "l_quantity", "l_orderkey", rsd=0.02).first()
    assert abs(k.total_orders - lines.select("l_orderkey").distinct().count()) <= 0.1 * k.total_orders


def test_fractional_units_and_nan_price_at_report_level(spark, tmp_path):
    """Units are not cut to whole numbers, and a NaN price is skipped, in the registered reports."""
    from tally.plans import reports
    src = "/root/testdata/sf0.001"
    for t in ("orders", "part", "customer"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    li = spark.read.parquet(f"{src}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(4)
    rows = [r.asDict() for r in li.collect()]
    for r, q, p in zip(rows, (1.5, 1.0, 2.7, 0.125), (10.0, float("nan"), 20.25, 1.0)):
        r["l_quantity"], r["l_extendedprice"] = q, p
    spark.createDataFrame(rows, li.schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = str(tmp_path)
    k = reports.kpi_summary(spark, d).first()
    assert k.total_quantity == 5.325 and k.total_revenue == 31.25
    assert k.avg_quantity_per_order == 5.325 / k.total_orders
    assert sum(r.quantity for r in reports.quantity_by_category(spark, d).collect()) == pytest.approx(5.325)
    assert sum(r.sales for r in reports.sales_by_month(spark, d).collect()) == 31.25
    assert sum(r.quantity for r in reports.top5_by_quantity(spark, d).collect()) == pytest.approx(5.325)


def test_cents_fails_beyond_its_range(spark):
    from tally.functions.measures import cents
    df = spark.createDataFrame([(1e15,)], "x double")
    with pytest.raises(ERRORS):
        df.select(cents("x")).collect()


def test_f3_plain_text(spark):
    from tally.functions.measures import to_text
    df = spark.createDataFrame([(12345678.9,), (100.0,), (-0.25,), (0.0,), (float("nan"),), (None,), (1e20,)], "x double")
    got = [r.s for r in df.select(to_text("x").alias("s")).collect()]
    assert got == ["12345678.9", "100.0", "-0.25", "0.0", "nan", None, "1.0E20"]
    assert spark.range(1).select(to_text("id").alias("s")).first().s == "0"


def test_describe_does_not_depend_on_partitions(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("2", "4", "8", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(tuple(r) for r in describe_numeric(lines).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1
