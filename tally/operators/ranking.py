"""Top-k / bottom-k and ordered first / last rows.

All of these plan as ``TakeOrderedAndProject``: each task keeps its own best k
rows and only k x tasks rows meet in the final merge; nothing is globally sorted.
Ties are broken by the ``tie`` columns so the answer is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators.aggregate import is_floating


def _list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def top_k(df: DataFrame, by: str, k: int = 5, tie: str | Sequence[str] = (),
          ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or, ``ascending=True``, smallest) ``by``.

    NaN/null measures sort last in both directions; ties go to the smallest ``tie`` value.
    """
    measure = F.nanvl(F.col(by), F.lit(None).cast("double")) if is_floating(df, by) else F.col(by)
    first = measure.asc_nulls_last() if ascending else measure.desc_nulls_last()
    return df.orderBy(first, *[F.asc_nulls_last(t) for t in _list(tie)]).limit(k)


def first_rows(df: DataFrame, order: str | Sequence[str], k: int = 5) -> DataFrame:
    """``head(k)`` for an explicit order (Spark rows have no file order)."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in _list(order)]).limit(k)


def last_rows(df: DataFrame, order: str | Sequence[str], k: int = 5) -> DataFrame:
    """``tail(k)`` for an explicit order, returned in ascending order."""
    cols = _list(order)
    tail = df.orderBy(*[F.desc_nulls_first(c) for c in cols]).limit(k)
    return tail.orderBy(*[F.asc_nulls_last(c) for c in cols])
