"""Token frequencies of delimited text (split -> explode -> strip -> count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions.text import split_literal, strip_whitespace


def token_counts(df: DataFrame, text_col: str, delimiter: str = ",", drop_empty: bool = False,
                 weight: str | None = None, token: str = "token", out: str = "n") -> DataFrame:
    """Occurrences of each stripped token, in no order.

    The delimiter is literal; leading and trailing Unicode whitespace is stripped.
    Empty pieces (``'a,,b'``, a trailing comma, an empty string) count as the
    token ``''`` unless ``drop_empty``.  Null texts contribute nothing.  With
    ``weight``, each row counts ``weight`` times: callers pre-aggregate repeated
    texts and pass the repeat count, so the split runs once per distinct text.
    """
    pieces = df.select(F.explode(split_literal(text_col, delimiter)).alias("_piece"),
                       *([F.col(weight).alias("_w")] if weight else []))
    tokens = pieces.select(strip_whitespace("_piece").alias(token), *(["_w"] if weight else []))
    if drop_empty:
        tokens = tokens.where(F.col(token) != "")
    measure = F.sum("_w") if weight else F.count(F.lit(1))
    return tokens.groupBy(token).agg(measure.cast("bigint").alias(out))
