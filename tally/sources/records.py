"""CSV records of splittable files: quoted newlines by quote parity, and a side table of what cannot be read.

A newline is data if an odd number of quotes stands before it.  Files are read as lines, split at will: each
block counts its quotes, a prefix over the blocks tells whether a block begins inside quotes, and only the
lines of records that span several are brought together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tally.functions.calendar import hour_of_time, month_number, try_date, weekday_number, year_number
from tally.sources.csv import (
    PANDAS_NA_TOKENS, RESTAURANT_COLUMNS, RESTAURANT_NUMBERS, STORE_COLUMNS, STORE_NUMBERS, csv_options, null_tokens,
    read_csv_text, snake_case,
)


def _lines(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """(_file, _block, _at, line): the lines of each file block, ``_at`` ascending within it."""
    df = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        line = F.decode(line.cast("binary"), encoding)
    return df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_at"), line.alias("line"))


def _quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))).cast("long")


def csv_records(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(_file, _record, record): the records of each file in file order, numbered from 1 (the header).

    The lines of a block are shuffled once, by block, to count quotes in order; what crosses blocks is a row a block.
    A record of one line goes on as it is; the lines of longer ones meet by record.  A quote that never closes
    makes the rest of its file one record.  Blank records are left out, but numbered.
    """
    in_block = Window.partitionBy("_file", "_block").orderBy("_at")
    lines = _lines(spark, path, encoding).withColumn("quotes", _quotes(F.col("line")))
    before = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("odd", before)  # quotes since the block's beginning
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # records begun in the block so far, if it begins outside quotes and if it begins inside them
    lines = lines.withColumns({"even_starts": F.sum((F.col("odd") == 0).cast("long")).over(upto),
                               "odd_starts": F.sum((F.col("odd") == 1).cast("long")).over(upto)})
    totals = lines.groupBy("_file", "_block").agg(F.sum("quotes").alias("quotes"), F.max("even_starts").alias("even_starts"),
                                                  F.max("odd_starts").alias("odd_starts"))
    blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    state = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(blocks), F.lit(0)) % 2)
    state = state.withColumn("starts", F.when(F.col("inside") == 0, F.col("even_starts")).otherwise(F.col("odd_starts")))
    state = state.select("_file", "_block", "inside", F.coalesce(F.sum("starts").over(blocks), F.lit(0)).alias("records"))
    placed = lines.join(state, ["_file", "_block"])
    own = F.when(F.col("inside") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    placed = placed.select("_file", "_block", "_at", "line", "quotes", ((F.col("inside") + F.col("odd")) % 2 == 0).alias("begins"),
                           (F.col("records") + own).alias("_record"))
    alone = F.col("begins") & (F.col("quotes") % 2 == 0)
    pieces = placed.where(~alone).groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "line"))).alias("p"))
    whole = placed.where(alone).select("_file", "_record", F.col("line").alias("record")).unionByName(
        pieces.select("_file", "_record", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("record")))
    return whole.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def _schema(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def read_csv_records(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8",
                     delimiter: str = ",") -> DataFrame:
    """The rows of ``read_csv_text(multiline=True)``, in more than one task a file; a malformed record fails.

    The header must be a single line, the same in every file.
    """
    names = read_csv_text(spark, path, encoding=encoding, delimiter=delimiter).columns
    rows = csv_records(spark, path, encoding).where("_record > 1")
    options = {**csv_options(delimiter), "multiLine": "true", "mode": "FAILFAST"}
    return rows.select(F.from_csv("record", _schema(names), options).alias("r")).select("r.*")


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str | None],
                     dates: Mapping[str, str | Sequence[str]] | None = None, encoding: str = "UTF-8",
                     tokens: Sequence[str] = PANDAS_NA_TOKENS, delimiter: str = ",",
                     quoted_newlines: bool = False, times: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): every line of the files, without headers and blank lines, is in one of the two.

    ``columns`` are typed as in ``read_csv_typed``, ``dates`` parsed with their formats; good rows have them under snake_case names.
    ``times`` are times of day, checked against their format and kept as text.
    ``rejected`` has a row a line: (file, line, errors), errors an array of (column, reason, value); a line with broken
    quotes or a wrong number of fields has one error without a column.  Both are lazy and read the files each;
    lines are never shuffled.  A line equal to the header is taken for one.  ``quoted_newlines`` reads records instead of
    lines (see ``csv_records``).
    """
    dates = {n: [f] if isinstance(f, str) else list(f) for n, f in (dates or {}).items()}
    names = read_csv_text(spark, path, encoding=encoding, delimiter=delimiter).columns
    times = dict(times or {})
    missing = [n for n in [*columns, *dates, *times] if n not in names]
    if missing:
        raise ValueError(f"columns not in the file: {missing}")
    if quoted_newlines:
        lines = csv_records(spark, path, encoding).where("_record > 1").select(F.col("_file").alias("file"), F.col("record").alias("line"))
    else:
        lines = _lines(spark, path, encoding).select(F.col("_file").alias("file"), F.regexp_replace("line", "\r$", "").alias("line"))
        lines = lines.where("line <> ''")
        # the header's text: the first line of the first block that has one
        head = lines.limit(1).select("line").first()
        lines = lines.where(F.col("line") != F.lit(head[0])) if head else lines
    options = {**csv_options(delimiter), "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    parsed = lines.withColumn("r", F.from_csv("line", f"{_schema(names)}, __bad string", options))
    broken = F.col("r.__bad").isNotNull() | (_quotes(F.col("line")) % 2 == 1)
    typed, errors = {}, []
    for name in dict.fromkeys([*columns, *dates, *times]):
        raw = null_tokens(F.col(f"r.`{name}`"), tokens)
        if name in dates:
            kind, value = "date", try_date(raw, dates[name])
        elif name in times:
            kind, value = "time", raw
        else:
            kind, value = columns[name], raw.try_cast(columns[name]) if columns[name] else raw
        typed[snake_case(name)] = value
        read = F.try_to_timestamp(raw, F.lit(times[name])) if name in times else value
        if kind:
            errors.append(F.when(raw.isNotNull() & read.isNull(), F.struct(
                F.lit(name).alias("column"), F.lit(f"not a {kind}").alias("reason"), raw.alias("value"))))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("column"), F.lit("broken quotes or number of fields").alias("reason"), none.alias("value")))
    found = F.when(broken, whole).otherwise(F.array_compact(F.array(*errors)) if errors else F.filter(whole, lambda e: F.lit(False)))
    checked = parsed.withColumn("errors", found)
    good = checked.where(F.size("errors") == 0).select(*[e.alias(n) for n, e in typed.items()])
    return good, checked.where(F.size("errors") > 0).select("file", "line", "errors")


def reject_counts(rejected: DataFrame) -> DataFrame:
    """(file, column, reason, n): lines by what is wrong with them; a line of two bad columns counts for both."""
    return (rejected.select("file", F.explode("errors").alias("e")).select("file", "e.column", "e.reason")
            .groupBy("file", "column", "reason").agg(F.count(F.lit(1)).alias("n")))


def _typed(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str | None], numbers: Mapping[str, str],
           encoding: str) -> dict[str, str | None]:
    present = read_csv_text(spark, path, encoding=encoding).columns
    return {**columns, **{n: t for n, t in numbers.items() if n in present}}


def read_store_checked(spark: SparkSession, path: str | Sequence[str], date_format: str = "M/d/yyyy",
                       quoted_newlines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Retail order lines (the named columns, parsed dates, calendar parts), and the rejected lines."""
    types = _typed(spark, path, STORE_COLUMNS, STORE_NUMBERS, "ISO-8859-1")
    dates = {"Order Date": date_format, "Ship Date": date_format}
    good, rejected = read_csv_checked(spark, path, types, dates, "ISO-8859-1", quoted_newlines=quoted_newlines)
    return good.withColumns({"order_month": month_number("order_date"), "order_year": year_number("order_date"),
                             "order_day_of_week": weekday_number("order_date")}), rejected


def read_restaurant_checked(spark: SparkSession, path: str | Sequence[str], date_formats: Sequence[str] = ("d-M-yyyy", "d/M/yyyy"),
                            quoted_newlines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Restaurant order lines (the named columns, day-first dates, hours), and the rejected lines."""
    types = _typed(spark, path, RESTAURANT_COLUMNS, RESTAURANT_NUMBERS, "UTF-8")
    good, rejected = read_csv_checked(spark, path, types, {"order_date": date_formats}, quoted_newlines=quoted_newlines,
                                      times={"order_time": "H:m:s"})
    return good.withColumn("order_hour", hour_of_time("order_time")), rejected


__all__ = ["read_store_checked", "read_restaurant_checked", "csv_records", "read_csv_records", "read_csv_checked", "reject_counts"]
