"""The named reports, composed from the operators over the star-schema tables.

Each report is ``f(spark, data_dir) -> DataFrame``.  Building one runs no job over the
lines, but for the pivots' column values and the describe's checkpoint; dimensions are
counted for the broadcast check.  Reports that group line measures by an order, part or customer attribute use
``rollup_join``: the dimension is broadcast when its size is checked small,
otherwise the lines are summed to the join key before the sort-merge join.

Stand-ins: revenue/sales = l_extendedprice, units = l_quantity,
order = l_orderkey, category = p_type, sub-category = p_brand,
product = p_name, size = l_returnflag, segment = c_mktsegment,
ingredients = the words of p_name joined by ', ', order time = events.ts.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.calendar import (
    hour_of_time, month_dim, month_name, month_number, parse_date, weekday_dim, weekday_name,
    weekday_number, year_number,
)
from tally.functions.measures import (
    cents, format_fixed, from_cents, join_units, split_units, to_text,
)
from tally.operators.aggregate import count_distinct_by, kpis, over_domain, sum_by
from tally.operators.pivot import pivot_cells, stored_cells
from tally.operators.profiling import describe_numeric, profile, shape
from tally.functions.text import split_literal, strip_whitespace
from tally.operators import ranking
from tally.operators.heavy import heavy_values
from tally.operators.ranking import top_k
from tally.operators.shares import cells_share_of_total, grand_total, ratio_column, share_of_total
from tally.operators.sketches import checked_counts, distinct_sketches, merged_counts, ranked_by_distinct
from tally.operators.tokens import token_counts
from tally.plans.star import fits_broadcast, join_dim, rollup_join, split_join
from tally.sources.adapters import event_lines, sales_lines
from tally.sources.layout import derived_layout, is_layout, order_parts
from tally.sources.parquet import read_table

Report = Callable[[SparkSession, str], DataFrame]
QUANTITY_SCALE = 4  # decimals of units that sums carry exactly


def _double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _dollars(df: DataFrame, *cols: str, as_double: bool = True) -> DataFrame:
    """Whole-cent totals to exact decimals (and to double for output)."""
    out = {c: from_cents(c) for c in cols}
    return df.withColumns({c: e.cast("double") for c, e in out.items()} if as_double else out)


def _units(df: DataFrame) -> DataFrame:
    """Unit totals, summed exactly in whole 1/10^QUANTITY_SCALE units, as doubles."""
    return df.withColumn("quantity", from_cents("quantity", QUANTITY_SCALE).cast("double"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


LINE_CENTS = {"price": "l_extendedprice", "discount": "l_discount", "units": "l_quantity"}


def _net_units(price=None, discount=None):
    """A line's net price, price x (1 - discount), in whole 1/10,000 units (bigint)."""
    price, discount = (c if c is not None else cents(n) for c, n in ((price, "l_extendedprice"), (discount, "l_discount")))
    return price * (F.lit(100) - discount)


def _profit_units():
    """A line's profit, net price minus units at list price, in 1/10,000 units."""
    return _net_units() - cents("l_quantity") * cents("p_retailprice")


def _profit_parts(units) -> dict:
    whole, rem = split_units(units, 4)
    return {"profit_whole": whole, "profit_rem": rem}


def _profit_total(df: DataFrame, as_double: bool = True) -> DataFrame:
    """Recombine summed profit parts into an exact decimal (double for output)."""
    total = join_units("profit_whole", "profit_rem", 4)
    df = df.withColumn("profit", total.cast("double") if as_double else total)
    return df.drop("profit_whole", "profit_rem")


# ---------------------------------------------------------------- order attributes
def _order_parts(spark: SparkSession, d: str) -> list[tuple[DataFrame, DataFrame, bool]]:
    """(lines, orders, bucketed alike?): one part, or those of a folder laid out by order."""
    if is_layout(d):
        return order_parts(spark, d)
    return [(_lines(spark, d), read_table(spark, d, "orders"), False)]


def _order_rollup(spark: SparkSession, d: str, sums, prepare: Callable[[DataFrame], DataFrame] = lambda lines: lines,
                  **attrs) -> DataFrame:
    """Lines (after ``prepare``) with attributes of their order, folded to the order where that pays.

    The lines of an order are in one part, so sums and distinct orders add up over the parts."""
    folded = [rollup_join(prepare(lines), "l_orderkey", orders.select("o_orderkey", *[e.alias(n) for n, e in attrs.items()]),
                          "o_orderkey", sums, co_located=alike)
              for lines, orders, alike in _order_parts(spark, d)]
    return reduce(DataFrame.unionByName, folded)


def _order_join(spark: SparkSession, d: str, prepare: Callable[[DataFrame], DataFrame], **attrs) -> DataFrame:
    """The same at line grain."""
    joined = []
    for lines, orders, alike in _order_parts(spark, d):
        fact, side = prepare(lines), orders.select("o_orderkey", *[e.alias(n) for n, e in attrs.items()])
        joined.append(fact.join(side.hint("merge"), fact["l_orderkey"] == side["o_orderkey"]) if alike
                      else join_dim(fact, side, "l_orderkey", "o_orderkey"))
    return reduce(DataFrame.unionByName, joined)


def _line_profit(lines: DataFrame, part: DataFrame) -> DataFrame:
    """Lines with exact profit parts (needs the part's list price)."""
    lines = join_dim(lines, part, "l_partkey", "p_partkey")
    parts = _profit_parts(_profit_units())
    return lines.select("l_orderkey", cents("l_extendedprice").alias("sales"), *[e.alias(n) for n, e in parts.items()])


# Profit of the lines of one part = sum(net) - sum(units) * list price: exact, and decomposable
# over any set of lines, so lines fold to (group, part) before they meet a large part table.
NET_PARTS = {"net_whole": "net_whole", "net_rem": "net_rem", "qty": "qty"}


def _net_parts(price=None, discount=None, units=None) -> dict:
    """A line without a net price or without units has no profit: neither part of it counts.

    Of raw lines, or of lines whose price, discount and units are whole cents (``LINE_CENTS``) already."""
    net, qty = _net_units(price, discount), units if units is not None else cents("l_quantity")
    whole, rem = split_units(F.when(qty.isNotNull(), net), 4)
    return {"net_whole": whole, "net_rem": rem, "qty": F.when(net.isNotNull(), qty)}


def _priced_profit():
    """Exact profit of folded lines: their net total less their units at the part's list price."""
    cost = (F.col("qty").cast("decimal(38,0)") * cents("p_retailprice").cast("decimal(38,0)")
            * F.lit(Decimal("0.0001")))
    return (join_units("net_whole", "net_rem", 4) - cost).cast("decimal(38,4)")


def sales_by_month(spark: SparkSession, d: str) -> DataFrame:
    j = _order_rollup(spark, d, {"sales": cents("l_extendedprice")},
                      order_month=month_number("o_orderdate"))
    return _dollars(sum_by(j, "order_month", {"sales": "sales"}), "sales").orderBy("order_month")


PROFIT_PARTS = {"profit_whole": "profit_whole", "profit_rem": "profit_rem"}


def profit_by_month(spark: SparkSession, d: str) -> DataFrame:
    """A small part table prices the lines at once.  A large one is met only after the lines
    are folded to (month, part): orders cost the one line-grain shuffle."""
    part = _part(spark, d, "p_retailprice")
    month = month_number("o_orderdate")
    if fits_broadcast(part):
        j = _order_rollup(spark, d, PROFIT_PARTS, lambda lines: _line_profit(lines, part), order_month=month)
        return _profit_total(sum_by(j, "order_month", PROFIT_PARTS)).orderBy("order_month")
    dated = _order_join(spark, d, lambda lines: lines.select(
        "l_orderkey", "l_partkey", *[e.alias(n) for n, e in _net_parts().items()]), order_month=month)
    folded = sum_by(dated, ["order_month", "l_partkey"], NET_PARTS)
    priced = folded.join(part, folded["l_partkey"] == part["p_partkey"])
    profit = priced.select("order_month", _priced_profit().alias("profit"))
    return _double(sum_by(profit, "order_month", {"profit": "profit"}), "profit").orderBy("order_month")


def _weekday_orders(spark: SparkSession, d: str) -> DataFrame:
    # Distinct orders: the lines reduce to their order keys before meeting orders.
    return _order_rollup(spark, d, None, weekday=weekday_name("o_orderdate"))


def orders_by_weekday(spark: SparkSession, d: str) -> DataFrame:
    agg = count_distinct_by(_weekday_orders(spark, d), "weekday", "l_orderkey", "orders")
    return over_domain(agg, weekday_dim(spark), "weekday", {"orders": 0}, order_by="weekday_ordinal")


def revenue_by_weekday(spark: SparkSession, d: str) -> DataFrame:
    j = _order_rollup(spark, d, {"revenue": cents("l_extendedprice")},
                      weekday=weekday_name("o_orderdate"))
    agg = _dollars(sum_by(j, "weekday", {"revenue": "revenue"}), "revenue")
    return over_domain(agg, weekday_dim(spark), "weekday", {"revenue": 0.0}, order_by="weekday_ordinal")


def orders_by_month(spark: SparkSession, d: str) -> DataFrame:
    j = _order_rollup(spark, d, None, month_name=month_name("o_orderdate"))
    agg = count_distinct_by(j, "month_name", "l_orderkey", "orders")
    return over_domain(agg, month_dim(spark), "month_name", {"orders": 0}, order_by="month_ordinal")


def orders_by_month_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Distinct event users per month over January-December; empty months show 0."""
    ev = event_lines(spark, d).withColumn("month_name", month_name("order_date"))
    agg = count_distinct_by(ev, "month_name", "order_id", "orders")
    return over_domain(agg, month_dim(spark), "month_name", {"orders": 0}, order_by="month_ordinal")


def orders_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders per hour of day, parsed from 'H:m:s' text; only hours that occur."""
    ev = event_lines(spark, d).withColumn("order_hour", hour_of_time("order_time"))
    return count_distinct_by(ev, "order_hour", "order_id", "orders").orderBy("order_hour")


def calendar_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its order date's month, year and weekday number (Monday = 0)."""
    j = sales_lines(spark, d, ["order_id", "line_number", "order_date"])
    return j.select("order_id", "line_number", "order_date",
                    month_number("order_date").alias("order_month"),
                    year_number("order_date").alias("order_year"),
                    weekday_number("order_date").alias("order_day_of_week"))


def parse_day_first(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written day-first ('dd-MM-yyyy') and parsed back."""
    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("order_date_text"))
    return o.withColumn("order_date", parse_date("order_date_text", ("d-M-yyyy", "d/M/yyyy")))


def parse_month_first(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written month-first without padding ('M/d/yyyy') and parsed back."""
    o = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("order_date_text"))
    return o.withColumn("order_date", parse_date("order_date_text", "M/d/yyyy"))


# ---------------------------------------------------------------- part attributes
def _part(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", *cols)


def _by_part_attr(spark: SparkSession, d: str, attr: str, out: str, measure: str,
                  as_double: bool = True) -> DataFrame:
    sums = {"sales": {"sales": cents("l_extendedprice")},
            "quantity": {"quantity": cents("l_quantity", QUANTITY_SCALE)}}[measure]
    j = rollup_join(_lines(spark, d), "l_partkey", _part(spark, d, attr), "p_partkey", sums)
    agg = sum_by(j.withColumnRenamed(attr, out), out, {measure: measure})
    if measure == "sales":
        agg = _dollars(agg, measure, as_double=as_double)
    else:
        agg = _units(agg)
    return agg.orderBy(out)


def _profit_by_part_attr(spark: SparkSession, d: str, attr: str, out: str,
                         as_double: bool = True) -> DataFrame:
    j = rollup_join(_lines(spark, d), "l_partkey", _part(spark, d, attr, "p_retailprice"), "p_partkey",
                    _net_parts())
    j = j.select(F.col(attr).alias(out), _priced_profit().alias("profit"))
    agg = sum_by(j, out, {"profit": "profit"})
    return (_double(agg, "profit") if as_double else agg).orderBy(out)


def sales_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _by_part_attr(spark, d, "p_type", "category", "sales")


def sales_by_subcategory(spark: SparkSession, d: str) -> DataFrame:
    return _by_part_attr(spark, d, "p_brand", "sub_category", "sales")


def quantity_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _by_part_attr(spark, d, "p_type", "category", "quantity")


def profit_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _profit_by_part_attr(spark, d, "p_type", "category")


def profit_by_subcategory(spark: SparkSession, d: str) -> DataFrame:
    return _profit_by_part_attr(spark, d, "p_brand", "sub_category")


def _share(agg: DataFrame, measure: str, key: str) -> DataFrame:
    # Shares are taken on the exact decimal sums; the measure becomes double afterwards.
    return _double(share_of_total(agg, measure), measure).orderBy(key)


def sales_share_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _share(_by_part_attr(spark, d, "p_type", "category", "sales", False), "sales", "category")


def profit_share_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _share(_profit_by_part_attr(spark, d, "p_type", "category", False), "profit", "category")


def category_share(spark: SparkSession, d: str) -> DataFrame:
    rev = _by_part_attr(spark, d, "p_type", "category", "sales", False).withColumnRenamed("sales", "revenue")
    return _share(rev, "revenue", "category")


def _category_size_lines(spark: SparkSession, d: str) -> DataFrame:
    j = rollup_join(_lines(spark, d), "l_partkey", _part(spark, d, "p_type"), "p_partkey",
                    {"revenue": cents("l_extendedprice")}, fact_keys=["l_returnflag"])
    return j.select(F.col("p_type").alias("category"), F.col("l_returnflag").alias("size"), "revenue")


def category_size_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by category x size; the columns are the sizes that occur."""
    cells = stored_cells(_category_size_lines(spark, d), "category", "size", "revenue")
    return pivot_cells(cells, "category", "size", "revenue", finish=from_cents, cast_to="double").orderBy("category")


def category_size_share(spark: SparkSession, d: str) -> DataFrame:
    """The same in percent of the grand total; columns, body and total come from the same stored cells."""
    cells = stored_cells(_category_size_lines(spark, d), "category", "size", "revenue")
    body = pivot_cells(cells, "category", "size", "revenue", finish=from_cents)
    sizes = [c for c in body.columns if c != "category"]
    grand = grand_total(cells.withColumn("revenue", from_cents("revenue")), ["category", "size"], "revenue")
    return cells_share_of_total(body, sizes, grand).orderBy("category")


def brand_size_pivot_filled(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by brand x the part sizes that occur; cells without lines are 0."""
    j = rollup_join(_lines(spark, d), "l_partkey", _part(spark, d, "p_brand", "p_size"), "p_partkey",
                    {"revenue": cents("l_extendedprice")})
    j = j.select(F.col("p_brand").alias("sub_category"), "p_size", "revenue")
    cells = stored_cells(j, "sub_category", "p_size", "revenue")
    return pivot_cells(cells, "sub_category", "p_size", "revenue", finish=from_cents, cast_to="double").orderBy("sub_category")


def ingredient_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ingredient occurrences over all lines: each part's text is split once, weighted by its lines."""
    ingredients = F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("ingredients")
    j = rollup_join(_lines(spark, d), "l_partkey",
                    read_table(spark, d, "part").select("p_partkey", ingredients), "p_partkey",
                    count_as="lines", pre_aggregate=True)
    counts = token_counts(j, "ingredients", ",", weight="lines", token="ingredient", out="n")
    return counts.orderBy(F.desc("n"), "ingredient")


def ingredient_top10(spark: SparkSession, d: str) -> DataFrame:
    return top_k(ingredient_counts(spark, d), "n", 10, tie="ingredient")


# ---------------------------------------------------------------- products
def _product_lines(spark: SparkSession, d: str, **measures) -> DataFrame:
    """Lines with their product name.  Lines of hot parts meet a large part table where they are; the
    (product, order) dedupe that follows regroups them anyway."""
    lines = _lines(spark, d).select("l_partkey", F.col("l_orderkey").alias("order_id"),
                                    *[e.alias(n) for n, e in measures.items()])
    j = split_join(lines, _part(spark, d, "p_name"), "l_partkey", "p_partkey")
    return j.select(F.col("p_name").alias("product"), "order_id", *measures)


def _product_measure(spark: SparkSession, d: str, measure: str) -> DataFrame:
    """(product, measure).  Sums fold the lines per part before the part join;
    distinct orders need the line-grain join."""
    if measure == "orders":
        return count_distinct_by(_product_lines(spark, d), "product", "order_id", "orders")
    line = {"quantity": cents("l_quantity", QUANTITY_SCALE), "revenue": cents("l_extendedprice")}[measure]
    j = rollup_join(_lines(spark, d), "l_partkey", _part(spark, d, "p_name"), "p_partkey", {measure: line})
    agg = sum_by(j.withColumnRenamed("p_name", "product"), "product", {measure: measure})
    return _dollars(agg, measure) if measure == "revenue" else _units(agg)


def _ranked(measure: str, ascending: bool) -> Report:
    def report(spark: SparkSession, d: str) -> DataFrame:
        return top_k(_product_measure(spark, d, measure), measure, 5, tie="product", ascending=ascending)
    report.__name__ = f"{'bottom' if ascending else 'top'}5_by_{measure}"
    return report


top5_by_quantity = _ranked("quantity", False)
top5_by_orders = _ranked("orders", False)
top5_by_revenue = _ranked("revenue", False)
bottom5_by_revenue = _ranked("revenue", True)
bottom5_by_quantity = _ranked("quantity", True)
bottom5_by_orders = _ranked("orders", True)


def _ranked_by_orders(ascending: bool) -> Report:
    def report(spark: SparkSession, d: str) -> DataFrame:
        """Sketch bounds choose the products that can be among the five; only theirs are deduplicated."""
        return ranked_by_distinct(_product_lines(spark, d), "product", "order_id", 5, ascending, "orders")
    report.__name__ = f"{'bottom' if ascending else 'top'}5_by_orders_pruned"
    return report


top5_by_orders_pruned = _ranked_by_orders(False)
bottom5_by_orders_pruned = _ranked_by_orders(True)


def ingredient_top10_certified(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent ingredients by a bounded summary and an exact recount of its candidates."""
    lines = split_join(_lines(spark, d).select("l_partkey"), _part(spark, d, "p_name"), "l_partkey", "p_partkey")
    ingredients = F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))
    tokens = lines.select(F.explode(split_literal(ingredients, ",")).alias("piece"))
    return heavy_values(tokens.select(strip_whitespace("piece").alias("ingredient")), "ingredient", 10)


def orders_by_weekday_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders per weekday, and whether the merged sketches of its days agree within their bound."""
    dated = _order_rollup(spark, d, None, day=F.to_date("o_orderdate"))
    table = distinct_sketches(dated, "day", "l_orderkey")
    approx = merged_counts(table, {"weekday": weekday_name("day")})
    return checked_counts(orders_by_weekday(spark, d), "weekday", "orders", approx).orderBy("weekday_ordinal")


def orders_by_hour_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users per hour, and whether the sketches of its (day, hour) cells agree within their bound."""
    events = event_lines(spark, d).select("order_id", F.col("order_date").alias("day"), hour_of_time("order_time").alias("order_hour"))
    approx = merged_counts(distinct_sketches(events, ["day", "order_hour"], "order_id"), "order_hour")
    return checked_counts(orders_by_hour(spark, d), "order_hour", "orders", approx).orderBy("order_hour")


def _laid_out(name: str) -> Report:
    def report(spark: SparkSession, d: str) -> DataFrame:
        """The report over the data folder laid out by order: lines and orders join without an exchange."""
        return REPORTS[name](spark, derived_layout(spark, d))
    report.__name__ = f"{name}_laid_out"
    return report


LAID_OUT = ("sales_by_month", "revenue_by_weekday", "orders_by_weekday")


# ---------------------------------------------------------------- segments and KPIs
def _segment_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sales and profit per segment.

    With a small part table: priced lines -> orders -> customers, summed at each grain.
    With a large one: orders -> customers, so that lines meet their segment with their order
    (the one line-grain shuffle), as three narrow numbers; folded to (segment, part), -> part.
    """
    part = _part(spark, d, "p_retailprice")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = read_table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    if fits_broadcast(part):
        measures = {"sales": "sales", **PROFIT_PARTS}
        per_order = rollup_join(_line_profit(_lines(spark, d), part), "l_orderkey", orders, "o_orderkey", measures)
        per_cust = rollup_join(per_order, "o_custkey", customers, "c_custkey", measures)
        totals = sum_by(per_cust, "segment", measures)
        return _profit_total(_dollars(totals, "sales", as_double=False), as_double=False)
    lines = _lines(spark, d).select("l_orderkey", "l_partkey", *[cents(c).alias(n) for n, c in LINE_CENTS.items()])
    placed = join_dim(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", "segment")
    ordered = (join_dim(lines, placed, "l_orderkey", "o_orderkey") if fits_broadcast(orders)
               else lines.join(placed, lines["l_orderkey"] == placed["o_orderkey"]))
    measures = {"sales": F.col("price"), **_net_parts(F.col("price"), F.col("discount"), F.col("units"))}
    folded = sum_by(ordered, ["segment", "l_partkey"], measures)
    priced = folded.join(part, folded["l_partkey"] == part["p_partkey"])
    rows = priced.select("segment", from_cents("sales").alias("sales"), _priced_profit().alias("profit"))
    return sum_by(rows, "segment", {"sales": "sales", "profit": "profit"})


def sales_profit_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return _double(_segment_sums(spark, d), "sales", "profit").orderBy("segment")


def sales_to_profit_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = ratio_column(_double(_segment_sums(spark, d), "sales", "profit"), "sales", "profit",
                     "sales_to_profit_ratio")
    return r.select("segment", "sales_to_profit_ratio").orderBy("segment")


def kpi_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select(cents("l_extendedprice").alias("revenue"),
                                    cents("l_quantity", QUANTITY_SCALE).alias("quantity"),
                                    F.col("l_orderkey").alias("order_id"))
    return kpis(lines, "revenue", "quantity", "order_id", revenue_cents_scale=2, quantity_scale=QUANTITY_SCALE)


def kpi_labels(spark: SparkSession, d: str) -> DataFrame:
    k = kpi_summary(spark, d)
    return k.select(format_fixed("total_revenue", 2, prefix="$").alias("total_revenue"),
                    *[format_fixed(c, 2).alias(c) for c in
                      ("total_quantity", "total_orders", "avg_order_value", "avg_quantity_per_order")])


# ---------------------------------------------------------------- labels of the figures
def weekday_revenue_labels(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by weekday with its bar label (``$1,234.50``)."""
    r = revenue_by_weekday(spark, d)
    return r.select("weekday", "weekday_ordinal", format_fixed("revenue", 2, prefix="$").alias("revenue_label")) \
        .orderBy("weekday_ordinal")


def share_labels(spark: SparkSession, d: str) -> DataFrame:
    """Category revenue as plain text and its share as a percent label (``12.2%``)."""
    s = category_share(spark, d)
    return s.select("category", to_text("revenue").alias("revenue_text"),
                    format_fixed("share_pct", 1, thousands=False, suffix="%").alias("share_label")).orderBy("category")


# ---------------------------------------------------------------- inspection
LINE_KEY = ("l_orderkey", "l_linenumber")  # leads the order of rows; all other columns follow


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(_lines(spark, d))


def dataset_shape(spark: SparkSession, d: str) -> DataFrame:
    return shape(_lines(spark, d))


def numeric_describe(spark: SparkSession, d: str) -> DataFrame:
    return describe_numeric(_lines(spark, d))


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return _head(spark, d, last=False)


def last_rows(spark: SparkSession, d: str) -> DataFrame:
    return _head(spark, d, last=True)


def _head(spark: SparkSession, d: str, last: bool) -> DataFrame:
    lines = _lines(spark, d)
    order = [*LINE_KEY, *[c for c in lines.columns if c not in LINE_KEY]]
    return (ranking.last_rows if last else ranking.first_rows)(lines, order, 5)


REPORTS: dict[str, Report] = {
    "sales_by_month": sales_by_month,
    "sales_by_category": sales_by_category,
    "sales_share_by_category": sales_share_by_category,
    "sales_by_subcategory": sales_by_subcategory,
    "profit_by_month": profit_by_month,
    "profit_by_category": profit_by_category,
    "profit_share_by_category": profit_share_by_category,
    "profit_by_subcategory": profit_by_subcategory,
    "sales_profit_by_segment": sales_profit_by_segment,
    "sales_to_profit_ratio": sales_to_profit_ratio,
    "kpi_summary": kpi_summary,
    "kpi_labels": kpi_labels,
    "ingredient_counts": ingredient_counts,
    "ingredient_top10": ingredient_top10,
    "orders_by_weekday": orders_by_weekday,
    "revenue_by_weekday": revenue_by_weekday,
    "orders_by_hour": orders_by_hour,
    "orders_by_month": orders_by_month,
    "category_share": category_share,
    "category_size_pivot": category_size_pivot,
    "category_size_share": category_size_share,
    "quantity_by_category": quantity_by_category,
    "top5_by_quantity": top5_by_quantity,
    "top5_by_orders": top5_by_orders,
    "top5_by_revenue": top5_by_revenue,
    "bottom5_by_revenue": bottom5_by_revenue,
    "bottom5_by_quantity": bottom5_by_quantity,
    "bottom5_by_orders": bottom5_by_orders,
    "dataset_profile": dataset_profile,
    "numeric_describe": numeric_describe,
    "calendar_parts": calendar_parts,
    "parse_day_first": parse_day_first,
    "parse_month_first": parse_month_first,
    "dataset_shape": dataset_shape,
    "orders_by_month_sparse": orders_by_month_sparse,
    "brand_size_pivot_filled": brand_size_pivot_filled,
    "weekday_revenue_labels": weekday_revenue_labels,
    "share_labels": share_labels,
    "first_rows": first_rows,
    "last_rows": last_rows,
    "top5_by_orders_pruned": top5_by_orders_pruned,
    "bottom5_by_orders_pruned": bottom5_by_orders_pruned,
    "ingredient_top10_certified": ingredient_top10_certified,
    "orders_by_weekday_sketched": orders_by_weekday_sketched,
    "orders_by_hour_sketched": orders_by_hour_sketched,
    **{f"{name}_laid_out": _laid_out(name) for name in LAID_OUT},
}
