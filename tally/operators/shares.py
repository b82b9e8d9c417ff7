"""Percent-of-total and per-row ratios over aggregated results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.measures import nan_safe_sum, safe_ratio
from tally.operators.aggregate import drop_null_keys, is_floating


def share_of_total(df: DataFrame, measure: str, out: str = "share_pct",
                   scale: float = 100.0, on_zero: str = "ieee") -> DataFrame:
    """Add ``scale * measure / sum(measure)`` (signed; a losing row has a negative share).

    The total is a scalar subquery over ``df`` (one value, planned once), so the
    rows stay in their partitions: no global window and no cross join.  It is
    summed in the measure's own type (exact for decimals) and only then made double.
    """
    total = df.select(F.sum(F.col(measure))).scalar()
    return df.withColumn(out, safe_ratio(F.lit(scale) * F.col(measure).cast("double"), total, on_zero))


def cells_share_of_total(df: DataFrame, value_cols: Sequence[str], grand: Column, scale: float = 100.0,
                         on_zero: str = "ieee") -> DataFrame:
    """Divide every cell of a matrix (e.g. a pivot) by ``grand``, the matrix's total.

    The total is taken from the rows before the pivot (``grand_total``), so that it
    holds whatever columns the matrix shows.
    """
    keep = [c for c in df.columns if c not in set(value_cols)]
    return df.select(*keep, *[safe_ratio(F.lit(scale) * F.col(f"`{c}`").cast("double"), grand, on_zero).alias(c)
                              for c in value_cols])


def grand_total(df: DataFrame, keys: Sequence[str], measure: str) -> Column:
    """Sum of ``measure`` over the rows whose keys are all present, as a scalar subquery."""
    kept = drop_null_keys(df, keys)
    return kept.select(nan_safe_sum(measure, is_floating(kept, measure))).scalar()


def ratio_column(df: DataFrame, numerator: str, denominator: str, out: str,
                 on_zero: str = "ieee") -> DataFrame:
    return df.withColumn(out, safe_ratio(numerator, denominator, on_zero))
