"""The additive reports from one stored roll-up of the lines.

``build_cube`` reads and joins the lines once and stores their sums per (month, weekday, segment, part, size); a
report whose keys and measures the roll-up holds is answered from it alone.  ``derive`` checks that before it
answers: distinct orders, say, do not add up over cells and are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.calendar import month_number, weekday_dim, weekday_name
from tally.functions.measures import cents, format_fixed, from_cents, to_text
from tally.operators.aggregate import over_domain, sum_by
from tally.operators.pivot import pivot_cells, stored_cells
from tally.operators.ranking import top_k
from tally.operators.shares import cells_share_of_total, grand_total, ratio_column, share_of_total
from tally.operators.tokens import token_counts
from tally.plans import reports as direct
from tally.plans.notebook import Reports
from tally.plans.star import join_dim
from tally.sources.parquet import read_table

#: Keys of the roll-up, and keys that follow from its part.
GRAIN = ("order_month", "weekday", "segment", "l_partkey", "size")
PART_KEYS = {"category": "p_type", "sub_category": "p_brand", "product": "p_name", "part_size": "p_size"}
#: Sums that the roll-up's cells add up to; the profit follows from its part's list price.
MEASURES = ("sales", "quantity", "profit", "lines")
_STORED = ("sales", "quantity", "net_whole", "net_rem", "qty", "lines")


class NotDerivable(ValueError):
    """The roll-up does not hold what a report needs."""


def build_cube(spark: SparkSession, data_dir: str, path: str) -> DataFrame:
    """Store the roll-up at ``path``; the lines are scanned, and joined to orders and customers, once.

    A line without its order or customer keeps a null month, weekday or segment, and counts in the other reports.
    Order and customer keys must be unique, or their lines would count twice; this is checked on the stored sums.
    """
    lines = read_table(spark, data_dir, "lineitem")
    measures = {"sales": cents("l_extendedprice"), "quantity": cents("l_quantity", direct.QUANTITY_SCALE), **direct._net_parts()}
    fact = lines.select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("size"), *[e.alias(n) for n, e in measures.items()])
    orders = read_table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", month_number("o_orderdate").alias("order_month"),
                                                          weekday_name("o_orderdate").alias("weekday"))
    customers = read_table(spark, data_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    joined = join_dim(join_dim(fact, orders, "l_orderkey", "o_orderkey", "left"), customers, "o_custkey", "c_custkey", "left")
    sums = [F.sum(n).alias(n) for n in measures]
    joined.groupBy(*GRAIN).agg(*sums, F.count(F.lit(1)).alias("lines")).write.mode("overwrite").parquet(path)
    cube = spark.read.parquet(path)
    held, rows = cube.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0], lines.count()  # the latter from footers
    if held != rows:
        raise ValueError(f"order or customer keys are not unique: {rows} lines, {held} in the roll-up")
    return cube


def derive(spark: SparkSession, data_dir: str, cube: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, measures) of the roll-up's cells at the keys' grain; sums are whole cents, 1/10^4 units and exact profit.

    Fails with ``NotDerivable`` for a key or measure that the cells do not hold.
    """
    lost = [k for k in keys if k not in GRAIN and k not in PART_KEYS] + [m for m in measures if m not in MEASURES]
    if lost:
        raise NotDerivable(f"not in the roll-up: {lost}")
    if missing := [c for c in (*GRAIN, *_STORED) if c not in cube.columns]:
        raise NotDerivable(f"columns missing from the stored roll-up: {missing}")
    of_part = [k for k in keys if k in PART_KEYS]
    priced = "profit" in measures
    own = [k for k in keys if k in GRAIN]
    stored = [m for m in measures if m != "profit"] + (["net_whole", "net_rem", "qty"] if priced else [])
    if not of_part and not priced:
        return cube.groupBy(*own).agg(*[F.sum(m).alias(m) for m in stored])
    # cells fold to the part before they meet it
    folded = cube.groupBy(*dict.fromkeys([*own, "l_partkey"])).agg(*[F.sum(m).alias(m) for m in stored])
    part = read_table(spark, data_dir, "part").select("p_partkey", *[PART_KEYS[k] for k in of_part],
                                                      *(["p_retailprice"] if priced else []))
    met = join_dim(folded, part, "l_partkey", "p_partkey")
    out = [F.col(k) for k in own] + [F.col(PART_KEYS[k]).alias(k) for k in of_part] + [F.col(m) for m in measures if m != "profit"]
    return met.select(*out, *([direct._priced_profit().alias("profit")] if priced else []))


def cube_reports(spark: SparkSession, data_dir: str, cube: DataFrame) -> Reports:
    """The additive reports by name, each built from the roll-up when asked for; the rows of ``reports.REPORTS``."""
    finish: dict[str, Callable] = {"sales": lambda c: from_cents(c), "quantity": lambda c: from_cents(c, direct.QUANTITY_SCALE),
                                   "profit": F.col}

    def total(keys: Sequence[str], *measures: str) -> DataFrame:
        """Exact sums per key."""
        cells = derive(spark, data_dir, cube, keys, measures)
        return sum_by(cells, keys, {m: m for m in measures}).withColumns({m: finish[m](m) for m in measures})

    def doubles(df: DataFrame, *cols: str) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("double") for c in cols})

    def by(key: str, measure: str) -> DataFrame:
        return doubles(total([key], measure), measure).orderBy(key)

    def share(key: str, measure: str, out: str | None = None) -> DataFrame:
        df = total([key], measure)
        df = df.withColumnRenamed(measure, out) if out else df
        return doubles(share_of_total(df, out or measure), out or measure).orderBy(key)

    def segments() -> DataFrame:
        return doubles(total(["segment"], "sales", "profit"), "sales", "profit")

    def revenue_by_weekday() -> DataFrame:
        agg = doubles(total(["weekday"], "sales").withColumnRenamed("sales", "revenue"), "revenue")
        return over_domain(agg, weekday_dim(spark), "weekday", {"revenue": 0.0}, order_by="weekday_ordinal")

    def ranked(measure: str, out: str, ascending: bool) -> DataFrame:
        df = doubles(total(["product"], measure), measure).withColumnRenamed(measure, out)
        return top_k(df, out, 5, tie="product", ascending=ascending)

    def matrix(index: str, columns: str, of_total: bool = False) -> DataFrame:
        rows = derive(spark, data_dir, cube, [index, columns], ["sales"]).withColumnRenamed("sales", "revenue")
        cells = stored_cells(rows, index, columns, "revenue")
        body = pivot_cells(cells, index, columns, "revenue", finish=from_cents, cast_to=None if of_total else "double")
        if of_total:
            grand = grand_total(cells.withColumn("revenue", from_cents("revenue")), [index, columns], "revenue")
            body = cells_share_of_total(body, [c for c in body.columns if c != index], grand)
        return body.orderBy(index)

    def ingredients() -> DataFrame:
        texts = derive(spark, data_dir, cube, ["product"], ["lines"]).withColumn(
            "ingredients", F.replace(F.col("product"), F.lit(" "), F.lit(", ")))
        return token_counts(texts, "ingredients", ",", weight="lines", token="ingredient", out="n")

    def weekday_labels() -> DataFrame:
        return revenue_by_weekday().select("weekday", "weekday_ordinal", format_fixed("revenue", 2, prefix="$").alias("revenue_label")) \
            .orderBy("weekday_ordinal")

    def labels() -> DataFrame:
        return share("category", "sales", "revenue").select(
            "category", to_text("revenue").alias("revenue_text"),
            format_fixed("share_pct", 1, thousands=False, suffix="%").alias("share_label")).orderBy("category")

    found = {
        "sales_by_month": lambda: by("order_month", "sales"), "profit_by_month": lambda: by("order_month", "profit"),
        "sales_by_category": lambda: by("category", "sales"), "profit_by_category": lambda: by("category", "profit"),
        "sales_by_subcategory": lambda: by("sub_category", "sales"), "profit_by_subcategory": lambda: by("sub_category", "profit"),
        "quantity_by_category": lambda: by("category", "quantity"),
        "sales_share_by_category": lambda: share("category", "sales"), "profit_share_by_category": lambda: share("category", "profit"),
        "category_share": lambda: share("category", "sales", "revenue"),
        "sales_profit_by_segment": lambda: segments().orderBy("segment"),
        "sales_to_profit_ratio": lambda: ratio_column(segments(), "sales", "profit", "sales_to_profit_ratio").select(
            "segment", "sales_to_profit_ratio").orderBy("segment"),
        "revenue_by_weekday": revenue_by_weekday, "weekday_revenue_labels": weekday_labels, "share_labels": labels,
        "category_size_pivot": lambda: matrix("category", "size"), "category_size_share": lambda: matrix("category", "size", True),
        "brand_size_pivot_filled": lambda: matrix("sub_category", "part_size"),
        "ingredient_counts": lambda: ingredients().orderBy(F.desc("n"), "ingredient"),
        "ingredient_top10": lambda: top_k(ingredients(), "n", 10, tie="ingredient"),
    }
    for measure, out in (("quantity", "quantity"), ("sales", "revenue")):
        for name, ascending in (("top5", False), ("bottom5", True)):
            found[f"{name}_by_{out}"] = lambda m=measure, o=out, a=ascending: ranked(m, o, a)
    return Reports(found)


__all__ = ["build_cube", "derive", "cube_reports", "NotDerivable", "GRAIN", "MEASURES"]
