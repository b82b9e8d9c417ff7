"""Grouped and global aggregates with pandas-compatible null/NaN rules.

* Rows whose group key is null are dropped before grouping (null is never a group).
* Sums skip NaN and null; a group with nothing to add sums to 0.
* Distinct counts ignore null ids.

Every aggregate here is decomposable, so Spark runs it as partial aggregate ->
hash shuffle on the keys -> final aggregate: a hot key is combined map-side
before it reaches the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.measures import from_cents, nan_safe_sum, safe_ratio

Measures = Mapping[str, "Column | str"]


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_floating(df: DataFrame, c: Column | str) -> bool:
    """True when ``c`` evaluates to float/double on ``df`` (analysis only, no job)."""
    if isinstance(c, str) and c in df.columns:  # the frame's schema is cached
        dtype = df.schema[c].dataType
    else:
        dtype = df.select(_col(c)).schema.fields[0].dataType
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def drop_null_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    keys = _keys(keys)
    if not keys:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def sum_aggs(df: DataFrame, measures: Measures) -> list[Column]:
    return [nan_safe_sum(_col(e), is_floating(df, e)).alias(out) for out, e in measures.items()]


def sum_by(df: DataFrame, keys: str | Sequence[str], measures: Measures) -> DataFrame:
    """``groupby(keys)[measures].sum()``: one row per non-null key."""
    keys = _keys(keys)
    kept = drop_null_keys(df, keys)
    return kept.groupBy(*keys).agg(*sum_aggs(kept, measures))


def _distinct(id_col: str, rsd: float | None) -> Column:
    return F.approx_count_distinct(id_col, rsd) if rsd else F.count_distinct(id_col)


def count_distinct_by(df: DataFrame, keys: str | Sequence[str], id_col: str,
                      out: str = "n_distinct", rsd: float | None = None) -> DataFrame:
    """``groupby(keys)[id_col].nunique()``.

    Exact by default (a dedupe on (keys, id), then a count).  ``rsd`` opts into
    HyperLogLog++ with that relative standard deviation: one pass, fixed-size
    state per group, no dedupe shuffle.
    """
    keys = _keys(keys)
    return drop_null_keys(df, keys).groupBy(*keys).agg(_distinct(id_col, rsd).alias(out))


def over_domain(agg: DataFrame, domain: DataFrame, key: str, fill: Mapping[str, object],
                order_by: str | None = None) -> DataFrame:
    """Re-key a grouped result onto a closed domain.

    Every member of ``domain`` appears once, in domain order, with the measures in
    ``fill`` replaced by their fill value where the member had no rows; keys of
    ``agg`` outside the domain are dropped (an ordered categorical's behaviour).
    Both sides are small (a fixed domain, a result with one row per key); Spark
    broadcasts the aggregated side from its runtime size.
    """
    joined = domain.join(agg, on=key, how="left")
    cols = [F.col(c) for c in domain.columns]
    types = {f.name: f.dataType for f in agg.schema.fields}
    for m, value in fill.items():
        cols.append(F.coalesce(F.col(m), F.lit(value).cast(types[m])).alias(m))
    out = joined.select(*cols)
    return out.orderBy(order_by) if order_by else out


def kpis(df: DataFrame, revenue: str, quantity: str, order_id: str,
         revenue_cents_scale: int | None = None, quantity_scale: int | None = None,
         rsd: float | None = None) -> DataFrame:
    """One-row frame: total revenue, total units, distinct orders and two per-order ratios.

    All three totals come from one aggregate (one scan).  Ratios divide doubles
    with IEEE rules (x/0 = inf, 0/0 = NaN).  With ``revenue_cents_scale`` the
    revenue column holds whole 1/10^scale units (``functions.measures.cents``), with
    ``quantity_scale`` likewise the units; a total of units is a bigint only if the
    column is integral.
    ``rsd`` makes the order count approximate (see ``count_distinct_by``).
    """
    totals = df.agg(
        nan_safe_sum(revenue, is_floating(df, revenue)).alias("total_revenue"),
        nan_safe_sum(quantity, is_floating(df, quantity)).alias("total_quantity"),
        _distinct(order_id, rsd).alias("total_orders"),
    )
    if quantity_scale is not None:
        totals = totals.withColumn("total_quantity", from_cents("total_quantity", quantity_scale))
    whole = isinstance(totals.schema["total_quantity"].dataType, T.IntegralType)
    if revenue_cents_scale is not None:
        totals = totals.withColumn("total_revenue", from_cents("total_revenue", revenue_cents_scale))
    return totals.select(
        F.col("total_revenue").cast("double").alias("total_revenue"),
        F.col("total_quantity").cast("bigint" if whole else "double").alias("total_quantity"),
        F.col("total_orders").cast("bigint").alias("total_orders"),
        safe_ratio("total_revenue", "total_orders").alias("avg_order_value"),
        safe_ratio("total_quantity", "total_orders").alias("avg_quantity_per_order"),
    )
