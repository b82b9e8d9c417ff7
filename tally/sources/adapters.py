"""The canonical sales-line view over the star-schema tables.

Reports are written against one order-line table with the columns the two
notebooks use.  Over the Parquet star schema each column maps as below; only
the tables a requested column needs are read and joined, and Catalyst prunes
every scan to the columns used.

===============  ==========================================  ============
column           expression                                  tables
===============  ==========================================  ============
order_id         l_orderkey                                  lineitem
line_number      l_linenumber                                lineitem
quantity         l_quantity                                  lineitem
sales            decimal(18,2)(l_extendedprice)              lineitem
sales_cents      the same in whole cents (bigint)            lineitem
profit           sales * (1 - discount) - quantity * retail  + part
size             l_returnflag                                lineitem
ship_date        date(l_shipdate)                            lineitem
order_date       date(o_orderdate)                           + orders
category         p_type                                      + part
sub_category     p_brand                                     + part
product          p_name                                      + part
part_size        p_size                                      + part
ingredients      p_name words joined by ', '                 + part
segment          c_mktsegment                                + orders, customer
===============  ==========================================  ============

Money is fixed-point (decimal, or whole cents for fast exact sums) so that
sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.measures import cents, money
from tally.plans.star import join_dim
from tally.sources.parquet import read_table


def profit_expr() -> Column:
    """Line profit, exact: net revenue minus units at list price, decimal(18,4)."""
    net = money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    cost = money("l_quantity") * money("p_retailprice")
    return (net - cost).cast("decimal(18,4)")


FACT_COLUMNS: dict[str, tuple[frozenset, object]] = {
    "order_id": (frozenset(), lambda: F.col("l_orderkey")),
    "line_number": (frozenset(), lambda: F.col("l_linenumber")),
    "quantity": (frozenset(), lambda: F.col("l_quantity")),
    "sales": (frozenset(), lambda: money("l_extendedprice")),
    "sales_cents": (frozenset(), lambda: cents("l_extendedprice")),
    "size": (frozenset(), lambda: F.col("l_returnflag")),
    "ship_date": (frozenset(), lambda: F.to_date("l_shipdate")),
    "profit": (frozenset({"part"}), profit_expr),
    "order_date": (frozenset({"orders"}), lambda: F.to_date("o_orderdate")),
    "category": (frozenset({"part"}), lambda: F.col("p_type")),
    "sub_category": (frozenset({"part"}), lambda: F.col("p_brand")),
    "product": (frozenset({"part"}), lambda: F.col("p_name")),
    "part_size": (frozenset({"part"}), lambda: F.col("p_size")),
    "ingredients": (frozenset({"part"}), lambda: F.replace(F.col("p_name"), F.lit(" "), F.lit(", "))),
    "segment": (frozenset({"orders", "customer"}), lambda: F.col("c_mktsegment")),
}


#: The dimension columns behind the canonical ones: only those that are asked for are joined, and measured for broadcast.
PART_COLUMNS = {"profit": "p_retailprice", "category": "p_type", "sub_category": "p_brand", "product": "p_name",
                "part_size": "p_size", "ingredients": "p_name"}
ORDER_COLUMNS = {"order_date": "o_orderdate", "segment": "o_custkey"}


def sales_lines(spark: SparkSession, data_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Order lines with the requested canonical columns (all of them by default)."""
    columns = list(columns or FACT_COLUMNS)
    unknown = [c for c in columns if c not in FACT_COLUMNS]
    if unknown:
        raise KeyError(f"unknown sales-line columns: {unknown}")
    need = frozenset().union(*(FACT_COLUMNS[c][0] for c in columns))
    df = read_table(spark, data_dir, "lineitem")
    if "orders" in need:
        orders = read_table(spark, data_dir, "orders").select("o_orderkey", *_behind(ORDER_COLUMNS, columns))
        df = join_dim(df, orders, "l_orderkey", "o_orderkey")
    if "customer" in need:
        customer = read_table(spark, data_dir, "customer").select("c_custkey", "c_mktsegment")
        df = join_dim(df, customer, "o_custkey", "c_custkey")
    if "part" in need:
        part = read_table(spark, data_dir, "part").select("p_partkey", *_behind(PART_COLUMNS, columns))
        df = join_dim(df, part, "l_partkey", "p_partkey")
    return df.select(*[FACT_COLUMNS[c][1]().alias(c) for c in columns])


def _behind(known: dict[str, str], columns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(known[c] for c in columns if c in known))


def event_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Events as timed orders: ``order_id`` = user_id, ``order_time`` = 'HH:mm:ss' text.

    The star schema's order dates carry no time of day, so the hourly report
    reads its times from the event stream table.
    """
    ev = read_table(spark, data_dir, "events")
    return ev.select(F.col("user_id").alias("order_id"),
                     F.date_format("ts", "HH:mm:ss").alias("order_time"),
                     F.to_date("ts").alias("order_date"))
