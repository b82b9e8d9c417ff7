"""DataFrame -> DataFrame operators."""

from tally.operators.aggregate import (
    count_distinct_by, drop_null_keys, kpis, over_domain, sum_by,
)
from tally.operators.pivot import pivot_sum
from tally.operators.profiling import (
    approx_quantiles, describe_numeric, exact_quantiles, profile, shape,
)
from tally.operators.ranking import first_rows, last_rows, top_k
from tally.operators.shares import cells_share_of_total, grand_total, ratio_column, share_of_total
from tally.operators.tokens import token_counts

__all__ = [
    "count_distinct_by", "drop_null_keys", "kpis", "over_domain", "sum_by",
    "pivot_sum", "approx_quantiles", "describe_numeric", "exact_quantiles", "profile", "shape",
    "first_rows", "last_rows", "top_k", "cells_share_of_total", "grand_total", "ratio_column",
    "share_of_total", "token_counts",
]
