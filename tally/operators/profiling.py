"""Table profiling: shape, per-column non-null counts and types, numeric summary.

``describe_numeric`` matches ``DataFrame.describe()`` of pandas: non-null count,
mean, sample standard deviation, min, linearly interpolated 25/50/75 %
percentiles and max, one row per numeric column.

Exact percentiles, moments and extremes come from two scans of the table and a sketch that brackets the
wanted ranks (``operators.quantiles``), not from Spark's ``percentile``, whose final merge holds every
distinct value of a column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.operators.quantiles import bracketed_counts, moments_from_counts, quantiles_from_counts

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
DESCRIBE_PROBS = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def profile(df: DataFrame) -> DataFrame:
    """One row per column: name, position, type, non-null count, table rows and columns.

    One aggregate pass computes every count.
    """
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count(F.col(f"`{f.name}`")).alias(f"_c{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"),
                     F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col(f"_c{i}").alias("non_null")) for i, f in enumerate(fields)]
    return counts.select(F.explode(F.array(*rows)).alias("r"), "_rows").select(
        "r.*", F.col("_rows").alias("n_rows"), F.lit(len(fields)).cast("bigint").alias("n_columns"))


def _named(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The column's number ``k`` as its name."""
    names = F.array(*[F.lit(c) for c in cols])
    return df.withColumn("column_name", F.element_at(names, F.col("k") + 1)).drop("k")


def exact_quantiles(df: DataFrame, cols: Sequence[str],
                    probs: Sequence[tuple[str, float]] = DESCRIBE_PROBS) -> DataFrame:
    """Linearly interpolated quantiles per column with values: (column_name, <name> for each prob).

    Nulls and NaN are no values.  The table is scanned when this is called.
    """
    counts, state = bracketed_counts(df, cols, probs)
    out = _named(quantiles_from_counts(counts, cols, state, probs), cols)
    return out.select("column_name", *[name for name, _ in probs])


def approx_quantiles(df: DataFrame, cols: Sequence[str],
                     probs: Sequence[tuple[str, float]] = DESCRIBE_PROBS,
                     accuracy: int = 10000) -> DataFrame:
    """Single-pass approximate quantiles (rank error at most n / accuracy)."""
    qs = [q for _, q in probs]
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")),
                                       qs, accuracy).alias(f"_q{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               *[F.col(f"_q{i}")[j].alias(name) for j, (name, _) in enumerate(probs)])
                      for i, c in enumerate(cols)])
    return row.select(F.explode(cells).alias("r")).select("r.*")


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """pandas ``describe()`` in long form: (column_name, n, mean, std, min, p25, p50, p75, max).

    Exact: two scans, when it is called, the first for sketches that bracket the percentiles; a few counts are
    checkpointed, and every statistic comes from them.  Approximate: one aggregate pass over the table
    with ``percentile_approx``.  See ``moments_from_counts`` for when mean and std are
    exact; percentiles, min and max are exact values.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if exact:
        counts, state = bracketed_counts(df, cols, DESCRIBE_PROBS)
        m = _named(moments_from_counts(counts, cols, state), cols)
        q = _named(quantiles_from_counts(counts, cols, state, DESCRIBE_PROBS), cols)
    else:
        clean = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols}
        moments = F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.count(v).alias("n"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        ) for c, v in clean.items()])
        m = df.agg(moments.alias("m")).select(F.explode("m").alias("r")).select("r.*")
        q = approx_quantiles(df, cols)
    # every column has a row even when it holds no values (n = 0)
    names = df.sparkSession.range(len(cols)).select(
        F.element_at(F.array(*[F.lit(c) for c in cols]), (F.col("id") + 1).cast("int")).alias("column_name"))
    out = names.join(m, "column_name", "left").join(q, "column_name", "left")
    return out.select("column_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
                      "mean", "std", "min", "p25", "p50", "p75", "max")


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


__all__ = ["profile", "describe_numeric", "exact_quantiles", "approx_quantiles", "shape",
           "numeric_columns"]
