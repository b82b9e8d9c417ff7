"""Pivot tables (``pivot_table(aggfunc='sum', fill_value=...)``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators.aggregate import drop_null_keys, is_floating
from tally.session import ensure_checkpoint_dir


def _cells(df: DataFrame, index: str, columns: str, values: str) -> DataFrame:
    """(index, columns, values): one row a cell; rows with a null key are dropped."""
    kept = drop_null_keys(df, [index, columns])
    agg = F.sum(F.nanvl(F.col(values), F.lit(None).cast("double"))) if is_floating(kept, values) else F.sum(values)
    return kept.groupBy(index, columns).agg(agg.alias(values))


def stored_cells(df: DataFrame, index: str, columns: str, values: str) -> DataFrame:
    """The sums of ``values`` per (index, columns), folded in one pass over ``df`` and checkpointed.

    One row a cell, however many rows ``df`` has: a pivot takes its columns, its body and its total from
    them without reading ``df`` again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _cells(df, index, columns, values).checkpoint(eager=True)


def pivot_cells(cells: DataFrame, index: str, columns: str, values: str,
                column_values: Sequence[object] | None = None, fill: object = 0, cast_to: str | None = None,
                finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """The matrix of (index, columns, values) cells, each key pair once; see ``pivot_sum``."""
    if column_values is None:
        limit = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
        column_values = [r[0] for r in cells.select(columns).distinct().limit(limit + 1).collect()]
        if len(column_values) > limit:
            raise ValueError(f"pivot column {columns!r} has more than {limit} values")
    wide = cells.groupBy(index).pivot(columns, sorted(column_values)).agg(F.first(values))
    types = {f.name: f.dataType for f in wide.schema.fields}
    out = {c: F.coalesce(F.col(f"`{c}`"), F.lit(fill).cast(t)) for c, t in types.items() if c != index}
    if finish:
        out = {c: finish(e) for c, e in out.items()}
    return wide.select(index, *[(e.cast(cast_to) if cast_to else e).alias(c) for c, e in out.items()])


def pivot_sum(df: DataFrame, index: str, columns: str, values: str,
              column_values: Sequence[object] | None = None, fill: object = 0,
              cast_to: str | None = None,
              finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sum of ``values`` by ``index`` x ``columns``; empty cells get ``fill``.

    Rows with a null index or column key are dropped first (no phantom ``null``
    column).  The columns are the values that occur: the rows are folded to stored cells when the
    plan is built (``stored_cells``), which hold both the columns and the body; more than
    ``spark.sql.pivotMaxValues`` of them (10,000 unless set) is an error, the pivot's limit.
    Passing ``column_values`` fixes the output schema and
    stores nothing; a row with a value outside the list then fails the query.  Columns
    are sorted either way.  ``finish`` (e.g. cents to an exact decimal)
    and then ``cast_to`` (e.g. ``'double'``) convert the cells in the same projection.
    """
    if column_values is None:
        cells = stored_cells(df, index, columns, values)
    else:
        listed = F.col(columns).isin(list(column_values))
        unlisted = F.raise_error(F.concat(F.lit(f"pivot column {columns}: value not listed: "),
                                          F.col(columns).cast("string")))
        checked = drop_null_keys(df, [index, columns]).withColumn(columns, F.when(listed, F.col(columns)).otherwise(
            unlisted.cast(df.schema[columns].dataType)))
        cells = _cells(checked, index, columns, values)
    return pivot_cells(cells, index, columns, values, column_values, fill, cast_to, finish)
