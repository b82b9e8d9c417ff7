"""Money, ratios, NaN-safe sums and display labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON_ZERO = ("ieee", "null", "raise")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str, scale: int = 2, precision: int = 18) -> Column:
    """Exact fixed-point value; sums of it are exact and order independent."""
    return _col(c).cast(T.DecimalType(precision, scale))


def cents(c: Column | str, scale: int = 2) -> Column:
    """A money value as a whole number of 1/10^scale units (bigint), rounded half-up.

    Summing these is exact long arithmetic, far cheaper than a wide decimal sum;
    ``from_cents`` turns a total back into an exact decimal.  NaN is null, as in every
    sum here.  A value of 2^53 units or more, which a double can't hold exactly, fails
    the query; a bigint total holds 9.2e18 units and fails in ANSI mode rather than wrap.
    """
    units = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double")) * (10 ** scale)
    return F.when(F.abs(units) >= float(1 << 53), F.raise_error(F.lit("money value beyond 2^53 units")).cast("bigint")) \
        .otherwise(F.round(units).cast("bigint"))


def from_cents(c: Column | str, scale: int = 2) -> Column:
    """Exact decimal(38, scale) value of a whole number of 1/10^scale units."""
    unit = F.lit(Decimal(1).scaleb(-scale))
    return (_col(c).cast("decimal(38,0)") * unit).cast(T.DecimalType(38, scale))


def split_units(units: Column | str, scale: int = 4) -> tuple[Column, Column]:
    """Split a whole number of 1/10^scale units into (whole, remainder) longs.

    whole = floor(units / 10^scale) and remainder in [0, 10^scale).  Summed
    separately, neither overflows a long even over 10^11 rows of per-row values
    up to 10^9 units (e.g. a line's profit at four decimals), where a single
    long sum could; ``join_units`` recombines the two totals exactly.
    """
    base = 10 ** scale
    u = _col(units)
    rem = F.pmod(u, F.lit(base))
    whole = ((u - rem) / F.lit(base)).cast("bigint")
    return whole, rem


def join_units(whole: Column | str, rem: Column | str, scale: int = 4) -> Column:
    """Exact decimal(38, scale) of whole + rem / 10^scale."""
    unit = F.lit(Decimal(1).scaleb(-scale))
    return (_col(whole).cast("decimal(38,0)") + _col(rem).cast("decimal(38,0)") * unit).cast(
        T.DecimalType(38, scale))


def nan_safe_sum(c: Column | str, floating: bool = True) -> Column:
    """Sum that skips NaN and nulls and gives 0 for a group with no values."""
    c = _col(c)
    if floating:
        return F.coalesce(F.sum(F.nanvl(c, F.lit(None).cast("double"))), F.lit(0.0))
    return F.coalesce(F.sum(c), F.lit(0))


def safe_ratio(a: Column | str, b: Column | str, on_zero: str = "ieee") -> Column:
    """``a / b`` as double.

    ``on_zero='ieee'``: x/0 is +inf or -inf by the sign of x and 0/0 is NaN.
    ``'null'``: a zero divisor gives null.  ``'raise'``: a zero divisor fails the query.
    """
    if on_zero not in ON_ZERO:
        raise ValueError(f"on_zero must be one of {ON_ZERO}, got {on_zero!r}")
    num, den = _col(a).cast("double"), _col(b).cast("double")
    if on_zero == "null":
        return F.try_divide(num, den)
    if on_zero == "raise":
        return num / den
    by_zero = (F.when(num > 0, F.lit(float("inf")))
               .when(num < 0, F.lit(float("-inf")))
               .otherwise(F.lit(float("nan"))))
    return F.when(den == 0, by_zero).otherwise(num / den)


def format_fixed(c: Column | str, digits: int = 2, thousands: bool = True,
                 prefix: str = "", suffix: str = "") -> Column:
    """Fixed-point label, rounded half-even on the exact binary value.

    ``format_fixed(x, 2, prefix='$')`` gives ``'$1,234,567.12'``;
    ``format_fixed(x, 1, thousands=False, suffix='%')`` gives ``'12.2%'``.
    NaN and infinities print as ``nan``, ``inf``, ``-inf``.
    """
    x = _col(c).cast("double")
    body = F.format_number(x, digits)
    if not thousands:
        body = F.regexp_replace(body, ",", "")
    body = (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .otherwise(body))
    return F.concat(F.lit(prefix), body, F.lit(suffix))


def to_text(c: Column | str) -> Column:
    """A number as plain decimal text: ``12345678.9``, not ``1.23456789E7``.

    Floats show at least one decimal (``100.0``), ``nan``, ``inf`` and ``-inf``; magnitudes of
    1e16 or more, or below 1e-4, keep the exponent.  Other types print as Spark casts them.
    """
    c = _col(c)
    x = c.try_cast("double")
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(x)
    floating = F.typeof(c).isin("double", "float")
    return (F.when(~floating, c.cast("string"))
            .when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
            .when(((size < 1e16) & (size >= 1e-4)) | (size == 0), plain).otherwise(c.cast("string")))
