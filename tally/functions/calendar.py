"""Calendar parsing and attributes (month, year, weekday, names, hour).

Dates are parsed against an explicit list of formats: nothing is guessed from
the first value.  Weekday numbering is Monday = 0 and names are full English
names, which is what the reports group by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two closed, ordered calendar domains the reports zero-fill over.
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTH_NAMES = ("January", "February", "March", "April", "May", "June",
               "July", "August", "September", "October", "November", "December")

ON_ERROR = ("raise", "null")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guard(raw: Column, parsed: Column, on_error: str, what: str) -> Column:
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {ON_ERROR}, got {on_error!r}")
    if on_error == "null":
        return parsed
    return F.when(raw.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit(f"cannot parse {what}: "), raw))).otherwise(parsed)


def try_date(raw: Column, formats: Sequence[str]) -> Column:
    """The date by the first of ``formats`` that fits, else null."""
    parsed = [F.try_to_date(raw, f) for f in formats]
    return F.coalesce(*parsed) if len(parsed) > 1 else parsed[0]


def parse_date(c: Column | str, formats: str | Sequence[str] = ("M/d/yyyy",),
               on_error: str = "raise") -> Column:
    """Parse a date string with the first of ``formats`` that fits.

    ``'d-M-yyyy'`` is day-first, ``'M/d/yyyy'`` month-first.  A non-null value no
    format accepts raises (``on_error='raise'``) or becomes null (``'null'``).
    """
    raw = _col(c)
    if isinstance(formats, str):
        formats = (formats,)
    return _guard(raw, try_date(raw, formats), on_error, "date")


def hour_of_time(c: Column | str, fmt: str = "H:m:s", on_error: str = "raise") -> Column:
    """Hour (0-23) of a time-of-day string such as ``'9:05:03'``; ``'24:00:00'`` is invalid."""
    raw = _col(c)
    return _guard(raw, F.hour(F.try_to_timestamp(raw, F.lit(fmt))), on_error, "time")


def month_number(d: Column | str) -> Column:
    return F.month(_col(d))


def year_number(d: Column | str) -> Column:
    return F.year(_col(d))


def weekday_number(d: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(d))


def weekday_name(d: Column | str) -> Column:
    """Full English weekday name, e.g. ``'Monday'``."""
    return F.date_format(_col(d), "EEEE")


def month_name(d: Column | str) -> Column:
    """Full English month name, e.g. ``'January'``."""
    return F.date_format(_col(d), "MMMM")


def _dimension(spark: SparkSession, names: Sequence[str], name_col: str, ordinal_col: str,
               first: int) -> DataFrame:
    # Generated in the JVM from a range (a local relation, no Python rows to ship).
    labels = F.array(*[F.lit(n) for n in names])
    return spark.range(len(names)).select(
        F.element_at(labels, (F.col("id") + 1).cast("int")).alias(name_col),
        (F.col("id") + first).cast("int").alias(ordinal_col))


def weekday_dim(spark: SparkSession, name_col: str = "weekday",
                ordinal_col: str = "weekday_ordinal") -> DataFrame:
    """Seven rows (name, ordinal 0-6), Monday first."""
    return _dimension(spark, WEEKDAY_NAMES, name_col, ordinal_col, 0)


def month_dim(spark: SparkSession, name_col: str = "month_name",
              ordinal_col: str = "month_ordinal") -> DataFrame:
    """Twelve rows (name, ordinal 1-12), January first."""
    return _dimension(spark, MONTH_NAMES, name_col, ordinal_col, 1)
