"""CSV sources read the way the reports need them.

Columns are read as strings (no ``inferSchema``: no extra pass over the file,
and no guessed types) and then cast explicitly.  Quoting follows RFC 4180
(``""`` inside quotes is a quote).  ``multiline`` (off unless asked for) is needed only
when quoted fields hold newlines, and makes each file one split; without it a file
splits freely, and a row broken by a quoted newline fails the read; ``sources.records`` reads such
files in many splits, and lists the rows that cannot be read.  Several reports
over one file should read it once: ``to_parquet`` converts it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The strings pandas.read_csv reads as missing by default
# (exact, case-sensitive, untrimmed matches; the empty string is null anyway).
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def snake_case(name: str) -> str:
    """``'Sub-Category'`` -> ``'sub_category'``, ``'Order Date'`` -> ``'order_date'``."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def csv_options(delimiter: str = ",") -> dict[str, str]:
    return {"quote": '"', "escape": '"', "sep": delimiter}


def read_csv_text(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8",
                  multiline: bool = False, delimiter: str = ",") -> DataFrame:
    """All columns as strings, named from the header row; a malformed row fails the read."""
    return (spark.read
            .option("header", True)
            .option("inferSchema", False)
            .option("encoding", encoding)
            .option("multiLine", multiline)
            .options(**csv_options(delimiter))
            .option("mode", "FAILFAST")
            .option("columnPruning", False)  # every row is parsed whole, so a broken one is seen
            .csv(path))


def null_tokens(c: Column, tokens: Sequence[str] = PANDAS_NA_TOKENS) -> Column:
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


#: Columns that keep a file's row order; no columns of the file.
FILE_ORDER = ("_file", "_block", "_row")


def read_csv_typed(spark: SparkSession, path: str | Sequence[str],
                   columns: Mapping[str, str | None],
                   encoding: str = "UTF-8", tokens: Sequence[str] = PANDAS_NA_TOKENS,
                   multiline: bool = False, rename: bool = True, others: bool = False) -> DataFrame:
    """Select ``columns`` (header name -> Spark SQL type, ``None`` keeps the string).

    Missing-value tokens become null before the cast, so ``'NA'`` in a number
    column is null rather than a cast error.  With ``rename`` the output names
    are snake_case.  With ``others`` every other column of the file stays too, as strings, in the
    file's column order, and FILE_ORDER columns are added.  Date and time strings are
    kept as strings here; parse them with ``tally.functions.parse_date`` /
    ``hour_of_time`` and an explicit format.
    """
    raw = read_csv_text(spark, path, encoding=encoding, multiline=multiline)
    missing = [n for n in columns if n not in raw.columns]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")
    out = []
    for name in raw.columns if others else columns:
        c = null_tokens(F.col(f"`{name}`"), tokens)
        if columns.get(name):
            c = c.cast(columns[name])
        out.append(c.alias(snake_case(name) if rename else name))
    if others:
        out += [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_row")]
    return raw.select(*out)


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as Parquet and read it back: one parse of the CSV serves every report."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# The columns each notebook's cells use, with their target types.  Money is
# fixed-point with six decimals (retail amounts carry up to four) so sums are exact.
MONEY = "decimal(22,6)"
STORE_COLUMNS = {
    "Order Date": None, "Ship Date": None, "Category": None, "Sub-Category": None,
    "Segment": None, "Sales": MONEY, "Profit": MONEY,
}
RESTAURANT_COLUMNS = {
    "order_id": "bigint", "quantity": "bigint", "order_date": None, "order_time": None,
    "total_price": MONEY, "pizza_category": None, "pizza_size": None,
    "pizza_name": None, "pizza_ingredients": None,
}
# Further numeric columns of such files, typed where they occur.
STORE_NUMBERS = {"Row ID": "bigint", "Quantity": "bigint", "Discount": MONEY}
RESTAURANT_NUMBERS = {"pizza_id": "bigint", "unit_price": MONEY}


def _raw(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str | None],
         numbers: Mapping[str, str], encoding: str, multiline: bool) -> DataFrame:
    present = read_csv_text(spark, path, encoding=encoding, multiline=multiline).columns
    types = {**columns, **{n: t for n, t in numbers.items() if n in present}}
    return read_csv_typed(spark, path, types, encoding=encoding, multiline=multiline, others=True)


def read_store_raw(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """A retail CSV (Latin-1) as read: all its columns, dates as text, FILE_ORDER added."""
    return _raw(spark, path, STORE_COLUMNS, STORE_NUMBERS, "ISO-8859-1", multiline)


def read_restaurant_raw(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """A restaurant CSV (UTF-8) as read: all its columns, dates and times as text, FILE_ORDER added."""
    return _raw(spark, path, RESTAURANT_COLUMNS, RESTAURANT_NUMBERS, "UTF-8", multiline)


def store_lines(raw: DataFrame, date_format: str = "M/d/yyyy") -> DataFrame:
    """``read_store_raw`` output with parsed dates and calendar parts."""
    from tally.functions.calendar import month_number, parse_date, weekday_number, year_number
    df = raw.withColumn("order_date", parse_date("order_date", date_format)) \
            .withColumn("ship_date", parse_date("ship_date", date_format))
    return df.withColumns({"order_month": month_number("order_date"),
                           "order_year": year_number("order_date"),
                           "order_day_of_week": weekday_number("order_date")})


def restaurant_lines(raw: DataFrame, date_formats: Sequence[str] = ("d-M-yyyy", "d/M/yyyy")) -> DataFrame:
    """``read_restaurant_raw`` output with parsed day-first dates and the hour of ``H:m:s`` times."""
    from tally.functions.calendar import hour_of_time, parse_date
    return raw.withColumn("order_date", parse_date("order_date", date_formats)) \
              .withColumn("order_hour", hour_of_time("order_time"))


def read_store_sales(spark: SparkSession, path: str | Sequence[str], date_format: str = "M/d/yyyy",
                     multiline: bool = False) -> DataFrame:
    """Retail order lines with all the file's columns, parsed dates and calendar parts."""
    return store_lines(read_store_raw(spark, path, multiline), date_format)


def read_restaurant_sales(spark: SparkSession, path: str | Sequence[str],
                          date_formats: Sequence[str] = ("d-M-yyyy", "d/M/yyyy"),
                          multiline: bool = False) -> DataFrame:
    """Restaurant order lines with all the file's columns; day-first dates, hours."""
    return restaurant_lines(read_restaurant_raw(spark, path, multiline), date_formats)
