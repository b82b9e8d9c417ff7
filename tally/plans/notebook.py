"""The reports over one flat order-line frame, as the two notebooks compute them.

``store_reports`` expects the retail columns (``read_store_sales`` output) and
``restaurant_reports`` the restaurant columns (``read_restaurant_sales``
output); either takes a column map so any flat order-line frame works,
including ``sources.adapters.sales_lines``.  Each returns a mapping from report name to
DataFrame, built when it is asked for: no job runs before.  (Asking for a pivot without
``sizes`` then finds its columns, and for the describe checkpoints its counts.)  ``raw``, the
file as read, is what the inspection reports are about; without it they show the
given frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.calendar import month_dim, month_name, month_number, weekday_dim, weekday_name
from tally.functions.measures import format_fixed, to_text
from tally.operators.aggregate import count_distinct_by, kpis, over_domain, sum_by
from tally.operators.pivot import pivot_sum
from tally.operators.profiling import describe_numeric, profile, shape
from tally.operators.ranking import first_rows, last_rows, top_k
from tally.operators.shares import cells_share_of_total, grand_total, ratio_column, share_of_total
from tally.operators.tokens import token_counts
from tally.sources.csv import FILE_ORDER


@dataclass(frozen=True)
class StoreColumns:
    order_date: str = "order_date"
    sales: str = "sales"
    profit: str = "profit"
    category: str = "category"
    sub_category: str = "sub_category"
    segment: str = "segment"


@dataclass(frozen=True)
class RestaurantColumns:
    order_id: str = "order_id"
    quantity: str = "quantity"
    total_price: str = "total_price"
    order_date: str = "order_date"
    order_hour: str = "order_hour"
    category: str = "pizza_category"
    size: str = "pizza_size"
    name: str = "pizza_name"
    ingredients: str = "pizza_ingredients"


class Reports(Mapping[str, DataFrame]):
    """Reports by name, each built on first use."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:  # without building it
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def _inspection(raw: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Columns, types, shape, numeric summary, head and tail of a frame.

    Rows are in file order where the frame carries it, else ordered by all columns.
    """
    order = [c for c in FILE_ORDER if c in raw.columns]
    shown = [c for c in raw.columns if c not in FILE_ORDER]
    plain = raw.select(*[f"`{c}`" for c in shown])
    return {
        "dataset_profile": lambda: profile(plain),
        "dataset_shape": lambda: shape(plain),
        "numeric_describe": lambda: describe_numeric(plain),
        "first_rows": lambda: first_rows(raw, order or shown, 5).select(*[f"`{c}`" for c in shown]),
        "last_rows": lambda: last_rows(raw, order or shown, 5).select(*[f"`{c}`" for c in shown]),
    }


def _dbl(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def store_reports(df: DataFrame, c: StoreColumns = StoreColumns(), raw: DataFrame | None = None) -> Reports:
    """Monthly, category, sub-category and segment sales/profit, shares and ratio."""
    lines = df.select(month_number(c.order_date).alias("order_month"),
                      F.col(c.sales).alias("sales"), F.col(c.profit).alias("profit"),
                      F.col(c.category).alias("category"), F.col(c.sub_category).alias("sub_category"),
                      F.col(c.segment).alias("segment"))

    def by(key: str, measure: str, share: bool = False) -> DataFrame:
        agg = sum_by(lines, key, {measure: measure})
        if share:
            agg = share_of_total(agg, measure)
        return _dbl(agg, measure).orderBy(key)

    segment = sum_by(lines, "segment", {"sales": "sales", "profit": "profit"})
    seg_dbl = _dbl(segment, "sales", "profit")
    return Reports({
        "sales_by_month": lambda: by("order_month", "sales"),
        "sales_by_category": lambda: by("category", "sales"),
        "sales_share_by_category": lambda: by("category", "sales", share=True),
        "sales_by_subcategory": lambda: by("sub_category", "sales"),
        "profit_by_month": lambda: by("order_month", "profit"),
        "profit_by_category": lambda: by("category", "profit"),
        "profit_share_by_category": lambda: by("category", "profit", share=True),
        "profit_by_subcategory": lambda: by("sub_category", "profit"),
        "sales_profit_by_segment": lambda: seg_dbl.orderBy("segment"),
        "sales_to_profit_ratio": lambda: ratio_column(seg_dbl, "sales", "profit", "sales_to_profit_ratio")
        .select("segment", "sales_to_profit_ratio").orderBy("segment"),
        **_inspection(df if raw is None else raw),
    })


def restaurant_reports(df: DataFrame, c: RestaurantColumns = RestaurantColumns(),
                       sizes: list[str] | None = None, raw: DataFrame | None = None) -> Reports:
    """KPIs, calendar trends, ingredient counts, category shares and pivot, rankings.

    The pivot's columns are the sizes present, found by one extra distinct query;
    ``sizes`` fixes them instead, and a line of another size then fails the pivot.
    """
    spark = df.sparkSession
    spark_kpis = kpis(df, c.total_price, c.quantity, c.order_id)
    dated = df.select(F.col(c.order_id).alias("order_id"), F.col(c.total_price).alias("revenue"),
                      weekday_name(c.order_date).alias("weekday"), month_name(c.order_date).alias("month_name"))

    def by_weekday(measure: str) -> DataFrame:
        agg = (count_distinct_by(dated, "weekday", "order_id", "orders") if measure == "orders"
               else _dbl(sum_by(dated, "weekday", {"revenue": "revenue"}), "revenue"))
        return over_domain(agg, weekday_dim(spark), "weekday", {measure: 0}, order_by="weekday_ordinal")

    def orders_by_month() -> DataFrame:
        return over_domain(count_distinct_by(dated, "month_name", "order_id", "orders"),
                           month_dim(spark), "month_name", {"orders": 0}, order_by="month_ordinal")

    orders_by_hour = count_distinct_by(df.select(F.col(c.order_hour).alias("order_hour"), c.order_id),
                                       "order_hour", c.order_id, "orders").orderBy("order_hour")
    cat = df.select(F.col(c.category).alias("category"), F.col(c.size).alias("size"),
                    F.col(c.total_price).alias("revenue"), F.col(c.quantity).alias("quantity"))
    cat_rev = sum_by(cat, "category", {"revenue": "revenue"})
    ingredients = token_counts(df, c.ingredients, ",", token="ingredient", out="n")
    products = df.where(F.col(c.name).isNotNull()).groupBy(F.col(c.name).alias("product")).agg(
        F.coalesce(F.sum(c.quantity), F.lit(0)).alias("quantity"),
        F.coalesce(F.sum(c.total_price), F.lit(0)).cast("double").alias("revenue"),
        F.count_distinct(c.order_id).alias("orders"))

    def rank(measure: str, ascending: bool) -> DataFrame:
        return top_k(products.select("product", measure), measure, 5, tie="product", ascending=ascending)

    def matrix(share: bool) -> DataFrame:
        cells = pivot_sum(cat, "category", "size", "revenue", sizes)
        cols = [x for x in cells.columns if x != "category"]
        if not share:
            return _dbl(cells, *cols).orderBy("category")
        grand = grand_total(cat, ["category", "size"], "revenue")
        return cells_share_of_total(cells, cols, grand).orderBy("category")

    category_share = _dbl(share_of_total(cat_rev, "revenue"), "revenue").orderBy("category")
    return Reports({
        "kpi_summary": lambda: spark_kpis,
        "kpi_labels": lambda: spark_kpis.select(
            format_fixed("total_revenue", 2, prefix="$").alias("total_revenue"),
            *[format_fixed(x, 2).alias(x) for x in
              ("total_quantity", "total_orders", "avg_order_value", "avg_quantity_per_order")]),
        "ingredient_counts": lambda: ingredients.orderBy(F.desc("n"), "ingredient"),
        "ingredient_top10": lambda: top_k(ingredients, "n", 10, tie="ingredient"),
        "orders_by_weekday": lambda: by_weekday("orders"),
        "revenue_by_weekday": lambda: by_weekday("revenue"),
        "weekday_revenue_labels": lambda: by_weekday("revenue").select(
            "weekday", "weekday_ordinal", format_fixed("revenue", 2, prefix="$").alias("revenue_label"))
        .orderBy("weekday_ordinal"),
        "orders_by_hour": lambda: orders_by_hour,
        "orders_by_month": orders_by_month,
        "category_share": lambda: category_share,
        "share_labels": lambda: category_share.select(
            "category", to_text("revenue").alias("revenue_text"),
            format_fixed("share_pct", 1, thousands=False, suffix="%").alias("share_label")).orderBy("category"),
        "category_size_pivot": lambda: matrix(False),
        "category_size_share": lambda: matrix(True),
        "quantity_by_category": lambda: sum_by(cat, "category", {"quantity": "quantity"}).orderBy("category"),
        "top5_by_quantity": lambda: rank("quantity", False),
        "top5_by_orders": lambda: rank("orders", False),
        "top5_by_revenue": lambda: rank("revenue", False),
        "bottom5_by_revenue": lambda: rank("revenue", True),
        "bottom5_by_quantity": lambda: rank("quantity", True),
        "bottom5_by_orders": lambda: rank("orders", True),
        **_inspection(df if raw is None else raw),
    })
