"""Column functions (all built-in Spark SQL expressions, no Python UDFs)."""

from tally.functions.calendar import (
    MONTH_NAMES, WEEKDAY_NAMES, hour_of_time, month_dim, month_name, month_number,
    parse_date, weekday_dim, weekday_name, weekday_number, year_number,
)
from tally.functions.measures import (
    cents, format_fixed, from_cents, money, nan_safe_sum, safe_ratio, to_text,
)
from tally.functions.text import split_literal, strip_whitespace

__all__ = [
    "MONTH_NAMES", "WEEKDAY_NAMES", "hour_of_time", "month_dim", "month_name",
    "month_number", "parse_date", "weekday_dim", "weekday_name", "weekday_number",
    "year_number", "cents", "format_fixed", "from_cents", "money", "nan_safe_sum", "safe_ratio", "to_text",
    "split_literal", "strip_whitespace",
]
