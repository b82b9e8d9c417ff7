"""Splittable quoted newlines and rejected rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tally.sources.csv import read_csv_text
from tally.sources.records import csv_records, read_csv_checked, read_csv_records, reject_counts


@pytest.fixture()
def small_splits(spark):
    """Files of some KB fall into many splits."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "700")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, seed, n=300, end="\n", encoding="utf-8"):
    rnd = random.Random(seed)
    cell = lambda: rnd.choice([
        "plain", "", '"quoted, comma"', '"a ""quote"""', f'"two{end}lines"', f'"{end}{end}deep {rnd.random()}{end}"', '"é"', '""', str(rnd.random())])
    rows = ["id,b,c", *[f"{i},{cell()},{cell()}" for i in range(n)]]
    path.write_bytes((end.join(rows) + (end if seed % 2 else "")).encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_records_equal_a_multiline_read(small_splits, tmp_path, encoding):
    spark = small_splits
    for seed in range(4):
        write(tmp_path / f"f{seed}.csv", seed, 40 if seed == 2 else 300, encoding=encoding)
    got = read_csv_records(spark, str(tmp_path), encoding)
    want = read_csv_text(spark, str(tmp_path), encoding=encoding, multiline=True)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert csv_records(spark, str(tmp_path), encoding).select("_file", "_record").distinct().count() == 3 * 301 + 41
    lines = spark.read.text(str(tmp_path / "f1.csv"))
    assert lines.rdd.getNumPartitions() > 5  # and one file is read by several tasks


def test_windows_line_ends_and_no_rows(small_splits, tmp_path):
    spark = small_splits
    path = write(tmp_path / "w.csv", 1, end="\r\n")
    got, want = read_csv_records(spark, path), read_csv_text(spark, path, multiline=True)
    clean = lambda df: sorted(repr(tuple((v or "").replace("\r", "") for v in r)) for r in df.collect())
    assert clean(got) == clean(want)
    (tmp_path / "h.csv").write_text("a,b\n\n")
    assert read_csv_records(spark, str(tmp_path / "h.csv")).count() == 0


def test_an_open_quote_takes_the_rest(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,x\n2,"open\n3,y\n')
    got = [(r._record, r.record) for r in csv_records(spark, str(tmp_path / "o.csv")).orderBy("_record").collect()]
    assert got[:2] == [(1, "a,b"), (2, "1,x")] and got[2][1].startswith('2,"open\n3,y')


LINES = ["Order Date,Sales,Units,Note", "1/2/2015,10.50,3,ok", "13/45/2015,1,2,bad date", "2/3/2015,ten,2,bad number", "NA,,NaN,all missing",
         "4/5/2015,1,2", '5/6/2015,1,2,"open', "6/7/2015,x,y,two bad", '7/8/2015,"1",2,"quoted, fine"', "8/9/2015,1,2,3,4", "Order Date,Sales,Units,Note", ""]


def test_good_and_rejected_are_all_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("\n".join(LINES))
    good, rejected = read_csv_checked(spark, str(tmp_path / "r.csv"), {"Sales": "decimal(10,2)", "Units": "bigint", "Note": None},
                                      {"Order Date": ["M/d/yyyy"]})
    assert good.columns == ["sales", "units", "note", "order_date"]
    assert [(str(r.sales), r.units, str(r.order_date)) for r in good.orderBy("order_date").collect()] == [
        ("None", None, "None"), ("10.50", 3, "2015-01-02"), ("1.00", 2, "2015-07-08")]
    bad = {r.line: {(e.column, e.reason, e.value) for e in r.errors} for r in rejected.collect()}
    whole = {(None, "broken quotes or number of fields", None)}
    assert bad == {LINES[2]: {("Order Date", "not a date", "13/45/2015")}, LINES[3]: {("Sales", "not a decimal(10,2)", "ten")},
                   LINES[5]: whole, LINES[6]: whole, LINES[9]: whole,
                   LINES[7]: {("Sales", "not a decimal(10,2)", "x"), ("Units", "not a bigint", "y")}}
    assert good.count() + rejected.count() == len(LINES) - 3  # without headers and the blank line
    counts = {(r.column, r.reason): r.n for r in reject_counts(rejected).collect()}
    assert counts == {("Order Date", "not a date"): 1, ("Sales", "not a decimal(10,2)"): 2, ("Units", "not a bigint"): 1,
                      (None, "broken quotes or number of fields"): 3}


def test_checked_read_of_records(small_splits, tmp_path):
    spark = small_splits
    path = write(tmp_path / "q.csv", 5)
    good, rejected = read_csv_checked(spark, path, {"id": "bigint", "b": "double"}, quoted_newlines=True)
    assert good.count() + rejected.count() == 300 and good.agg(F.max("id")).first()[0] <= 299
    assert {e.column for r in rejected.collect() for e in r.errors} == {"b"}
    with pytest.raises(ValueError):
        read_csv_checked(spark, path, {"none": "bigint"})


def test_runner_with_rejects(spark, tmp_path):
    """The reports over the good lines, the rejected ones beside them."""
    from tally.__main__ import main
    (tmp_path / "s.csv").write_bytes("""Order Date,Ship Date,Category,Sub-Category,Segment,Sales,Profit,Quantity
1/2/2015,1/3/2015,A,a,Home,10.5,1.25,1
31/2/2015,1/3/2015,A,a,Home,99,9,1
2/2/2015,2/3/2015,B,b,Caf\u00e9,4.5,-1,2
2/5/2015,,B,b,Home,much,1,x
""".encode("latin-1"))
    out = str(tmp_path / "out")
    assert main(["--store-csv", str(tmp_path / "s.csv"), "--out", out, "--rejects", "sales_by_month", "sales_profit_by_segment"]) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{out}/sales_by_month").orderBy("order_month").collect()] == [(1, 10.5), (2, 4.5)]
    assert {r.segment for r in spark.read.parquet(f"{out}/sales_profit_by_segment").collect()} == {"Home", "Caf\u00e9"}
    counts = {(r.column, r.reason): r.n for r in spark.read.json(f"{out}/reject_counts").collect()}
    assert counts == {("Order Date", "not a date"): 1, ("Sales", "not a decimal(22,6)"): 1, ("Quantity", "not a bigint"): 1}
    (tmp_path / "r.csv").write_text("""order_id,quantity,order_date,order_time,total_price,pizza_category,pizza_size,pizza_name,pizza_ingredients
1,1,13-02-2015,9:05:03,10.0,V,S,x,"a, b"
2,1,13-02-2015,24:00:00,10.0,V,S,x,"a, b"
""")
    assert main(["--restaurant-csv", str(tmp_path / "r.csv"), "--out", out, "--rejects", "--sizes", "S", "orders_by_hour"]) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{out}/orders_by_hour").collect()] == [(9, 1)]
    assert [e.reason for r in spark.read.json(f"{out}/rejected").collect() for e in r.errors] == ["not a time"]
