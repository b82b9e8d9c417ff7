"""Flat-frame reports: against pandas on toy CSVs, and against the star-schema reports."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tally.functions.calendar import WEEKDAY_NAMES
from tally.operators.pivot import pivot_sum
from tally.plans import reports
from tally.plans.notebook import RestaurantColumns, StoreColumns, restaurant_reports, store_reports
from tally.sources.adapters import sales_lines
from tally.sources.csv import (
    read_csv_text, read_restaurant_raw, read_restaurant_sales, read_store_raw, read_store_sales, restaurant_lines, store_lines,
    to_parquet,
)

STORE_CSV = """Row ID,Order Date,Ship Date,Segment,Category,Sub-Category,Sales,Profit
1,11/8/2016,11/11/2016,Consumer,Furniture,Bookcases,261.96,41.9136
2,11/8/2016,11/11/2016,Consumer,Furniture,Chairs,731.94,219.582
3,6/12/2016,6/16/2016,Corporate,Office Supplies,Labels,14.62,6.8714
4,10/11/2015,10/18/2015,Consumer,Furniture,Tables,957.5775,-383.031
5,10/11/2015,10/18/2015,Home Office,Office Supplies,Storage,22.368,2.5164
6,6/9/2014,6/14/2014,Consumer,Technology,Phones,907.152,90.7152
"""

PIZZA_CSV = """pizza_id,order_id,pizza_name_id,quantity,order_date,order_time,unit_price,total_price,pizza_size,pizza_category,pizza_ingredients,pizza_name
1,1,hawaiian_m,1,1/1/2015,11:38:36,13.25,13.25,M,Classic,"Sliced Ham, Pineapple, Mozzarella Cheese",The Hawaiian Pizza
2,2,classic_dlx_m,1,1/1/2015,11:57:40,16,16,M,Classic,"Pepperoni, Mushrooms, Red Onions, Red Peppers, Bacon",The Classic Deluxe Pizza
3,2,five_cheese_l,2,1/1/2015,11:57:40,18.5,37,L,Veggie,"Mozzarella Cheese, Provolone Cheese",The Five Cheese Pizza
4,3,ital_supr_l,1,13/1/2015,9:05:03,20.75,20.75,L,Supreme,"Calabrese Salami, Capocollo, Tomatoes",The Italian Supreme Pizza
5,4,hawaiian_s,1,02-02-2015,23:10:00,10.5,10.5,S,Classic,"Sliced Ham, Pineapple, Mozzarella Cheese",The Hawaiian Pizza
6,5,thai_ckn_l,3,7/3/2015,17:00:00,20.75,62.25,L,Chicken,"Chicken, Pineapple, Tomatoes",The Thai Chicken Pizza
"""


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("store") / "store.csv"
    p.write_bytes(STORE_CSV.encode("latin-1"))
    return read_store_sales(spark, str(p)), pd.read_csv(p, encoding="latin-1")


@pytest.fixture(scope="module")
def pizza(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("pizza") / "pizza.csv"
    p.write_text(PIZZA_CSV)
    return read_restaurant_sales(spark, str(p)), pd.read_csv(p)


def _close(a, b):
    return all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9) for x, y in zip(a, b)) and len(a) == len(b)


def test_store_against_pandas(store):
    df, pdf = store
    out = store_reports(df)
    pdf["month"] = pd.to_datetime(pdf["Order Date"], format="%m/%d/%Y").dt.month
    by_month = pdf.groupby("month")["Sales"].sum()
    got = out["sales_by_month"].collect()
    assert [r.order_month for r in got] == list(by_month.index)
    assert _close([r.sales for r in got], list(by_month.values))
    prof = pdf.groupby("Category")["Profit"].sum()
    shares = out["profit_share_by_category"].collect()
    assert _close([r.share_pct for r in shares], list(prof / prof.sum() * 100))
    seg = pdf.groupby("Segment").agg({"Sales": "sum", "Profit": "sum"})
    ratio = out["sales_to_profit_ratio"].collect()
    assert _close([r.sales_to_profit_ratio for r in ratio], list(seg["Sales"] / seg["Profit"]))
    assert [r.sub_category for r in out["sales_by_subcategory"].collect()] == sorted(pdf["Sub-Category"].unique())


def test_restaurant_against_pandas(pizza):
    df, pdf = pizza
    out = restaurant_reports(df, sizes=["L", "M", "S"])
    k = out["kpi_summary"].first()
    assert math.isclose(k.total_revenue, pdf["total_price"].sum())
    assert k.total_quantity == pdf["quantity"].sum() and k.total_orders == pdf["order_id"].nunique()
    got = {r.ingredient: r.n for r in out["ingredient_counts"].collect()}
    assert got == {"Sliced Ham": 2, "Pineapple": 3, "Mozzarella Cheese": 3, "Pepperoni": 1, "Mushrooms": 1,
                   "Red Onions": 1, "Red Peppers": 1, "Bacon": 1, "Provolone Cheese": 1, "Calabrese Salami": 1,
                   "Capocollo": 1, "Tomatoes": 2, "Chicken": 1}
    wd = [(r.weekday, r.orders) for r in out["orders_by_weekday"].collect()]
    assert [w for w, _ in wd] == list(WEEKDAY_NAMES)
    # day-first dates: 1 Jan, 13 Jan, 2 Feb, 7 Mar 2015 (Thu, Tue, Mon, Sat)
    assert dict(wd) == {"Monday": 1, "Tuesday": 1, "Wednesday": 0, "Thursday": 2, "Friday": 0,
                        "Saturday": 1, "Sunday": 0}
    months = {r.month_name: r.orders for r in out["orders_by_month"].collect()}
    assert months["January"] == 3 and months["February"] == 1 and months["March"] == 1 and months["May"] == 0
    assert [(r.order_hour, r.orders) for r in out["orders_by_hour"].collect()] == [(9, 1), (11, 2), (17, 1), (23, 1)]
    piv = {r.category: (r.L, r.M, r.S) for r in out["category_size_pivot"].collect()}
    assert piv == {"Classic": (0.0, 29.25, 10.5), "Veggie": (37.0, 0.0, 0.0), "Supreme": (20.75, 0.0, 0.0),
                   "Chicken": (62.25, 0.0, 0.0)}
    labels = {r.weekday: r.revenue_label for r in out["weekday_revenue_labels"].collect()}
    assert labels["Thursday"] == "$66.25" and labels["Wednesday"] == "$0.00"
    text = {r.category: (r.revenue_text, r.share_label) for r in out["share_labels"].collect()}
    assert text["Veggie"] == ("37.0", "23.2%") and text["Classic"] == ("39.75", "24.9%")
    top = [r.product for r in out["top5_by_revenue"].collect()]
    assert top == list(pdf.groupby("pizza_name")["total_price"].sum().sort_values(ascending=False).head(5).index)
    d = {r.column_name: r for r in out["numeric_describe"].collect()}
    assert d["quantity"].n == 6 and d["quantity"].p50 == pdf["quantity"].describe()["50%"]


def test_flat_reports_equal_star_reports(spark):
    """The flat path over the joined view gives the rollup-join reports' answers."""
    d = "/root/testdata/sf0.01"
    flat = sales_lines(spark, d, ["order_id", "quantity", "sales", "order_date", "category", "size",
                                  "product", "ingredients", "profit", "sub_category", "segment"])
    rest = restaurant_reports(flat, RestaurantColumns(total_price="sales", order_hour="order_id",
                                                      category="category", size="size", name="product",
                                                      ingredients="ingredients"), sizes=["A", "N", "R"])
    store = store_reports(flat, StoreColumns())
    pairs = [(rest, "orders_by_weekday"), (rest, "revenue_by_weekday"), (rest, "orders_by_month"),
             (rest, "ingredient_counts"), (rest, "category_size_share"), (rest, "top5_by_orders"),
             (rest, "bottom5_by_revenue"), (rest, "kpi_summary"), (store, "sales_by_month"),
             (store, "profit_by_subcategory"), (store, "profit_share_by_category"),
             (store, "sales_to_profit_ratio")]
    for frames, name in pairs:
        a = sorted(tuple(r) for r in frames[name].collect())
        b = sorted(tuple(r) for r in reports.REPORTS[name](spark, d).collect())
        assert a == b, name


def _jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy"))


def test_reports_run_no_job_before_they_are_asked_for(spark, pizza):
    df, _ = pizza
    spark.sparkContext.setJobGroup("lazy", "reports")
    try:
        out = restaurant_reports(df)
        assert len(out) > 20 and "numeric_describe" in out
        assert _jobs(spark) == 0
        out["kpi_summary"].collect()
        assert _jobs(spark) > 0
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_raw_inspection_of_a_csv(spark, tmp_path):
    src = tmp_path / "pizza.csv"
    src.write_text(PIZZA_CSV)
    pdf = pd.read_csv(src)
    raw = to_parquet(read_restaurant_raw(spark, str(src)), str(tmp_path / "lines"))
    out = restaurant_reports(restaurant_lines(raw), raw=raw)
    assert [r.column_name for r in out["dataset_profile"].orderBy("ordinal").collect()] == list(pdf.columns)
    assert tuple(out["dataset_shape"].first()) == pdf.shape
    d = {r.column_name: r for r in out["numeric_describe"].collect()}
    want = pdf.describe()
    assert set(d) == set(want.columns)
    for c in want.columns:
        assert math.isclose(d[c]["mean"], want[c]["mean"]) and math.isclose(d[c]["std"], want[c]["std"])
    assert [r.pizza_id for r in out["first_rows"].collect()] == list(pdf.head(5).pizza_id)
    assert [r.pizza_id for r in out["last_rows"].collect()] == list(pdf.tail(5).pizza_id)
    store = tmp_path / "store.csv"
    store.write_bytes(STORE_CSV.encode("latin-1"))
    raw = read_store_raw(spark, str(store))
    assert [r.row_id for r in store_reports(store_lines(raw), raw=raw)["first_rows"].collect()] == [1, 2, 3, 4, 5]


def test_large_csv_is_split(spark, tmp_path):
    src = tmp_path / "big.csv"
    header, *rows = PIZZA_CSV.strip().split("\n")
    src.write_text("\n".join([header, *(rows * 2000)]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        assert read_restaurant_sales(spark, str(src)).rdd.getNumPartitions() > 4
        assert read_restaurant_sales(spark, str(src), multiline=True).rdd.getNumPartitions() == 1
        tail = store_reports(read_restaurant_raw(spark, str(src)).withColumnsRenamed(
            {"total_price": "sales", "unit_price": "profit", "pizza_category": "category", "pizza_size": "sub_category",
             "pizza_name": "segment"}).withColumn("order_date", F.to_date(F.lit("2015-01-01"))))["last_rows"]
        assert [r.pizza_id for r in tail.collect()] == [2, 3, 4, 5, 6]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_newline_fails_without_multiline(spark, tmp_path):
    src = tmp_path / "broken.csv"
    src.write_text('a,b,c\n1,"x\ny",2\n3,z,4\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_csv_text(spark, str(src)).select("a").collect()
    assert read_csv_text(spark, str(src), multiline=True).count() == 2


def test_pivot_shows_every_size(spark, pizza):
    """An unlisted size fails; without a list the matrix holds all revenue, and shares divide by it."""
    df, pdf = pizza
    out = restaurant_reports(df)
    cells = out["category_size_pivot"]
    total = sum(sum(r[c] for c in cells.columns if c != "category") for r in cells.collect())
    assert math.isclose(total, out["kpi_summary"].first().total_revenue)
    shares = out["category_size_share"].collect()
    assert math.isclose(sum(r.L + r.M + r.S for r in shares), 100.0)
    with pytest.raises(Exception, match="not listed"):
        restaurant_reports(df, sizes=["L", "M"])["category_size_pivot"].collect()
    toy = spark.createDataFrame([("x", "A", 10), ("x", "B", 30)], "i string, c string, v int")
    with pytest.raises(Exception, match="not listed"):
        pivot_sum(toy, "i", "c", "v", ["A"]).collect()
    assert pivot_sum(toy, "i", "c", "v", ["A", "B", "C"]).collect()[0] == ("x", 10, 30, 0)
