"""The most frequent values, certified: a bounded summary finds candidates, an exact recount decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators.aggregate import drop_null_keys
from tally.operators.ranking import top_k
from tally.session import ensure_checkpoint_dir

#: Values that the summary tracks at first and at most; beyond, all values are counted.
TRACKED, MOST_TRACKED = 1024, 1 << 18
#: A value that a summary of m tracked values leaves out occurs at most this many times in n rows, over n / m:
#: twice the summary's error, 3.5 n over its map's size, which is larger than m.
MISSED = 7.0


def heavy_values(df: DataFrame, col: str, k: int, out: str = "n", tracked: int = TRACKED, most: int = MOST_TRACKED) -> DataFrame:
    """(col, out) of the k most frequent non-null values, ties by value: the answer of a full count.

    A scan builds Spark's mergeable frequent-items summary (``approx_top_k``); the next counts its at most
    ``tracked`` values exactly.  If the kth of those counts exceeds what any value left out can reach, no other
    value, also by a tie, belongs among the k.  Otherwise four times as many are tracked; beyond
    ``most`` all values are counted.  Both scans run when this is called.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = drop_null_keys(df, col)
    while tracked <= most:
        summary = F.expr(f"approx_top_k(`{col}`, {tracked}, {tracked})")
        row = kept.agg(F.count(F.lit(1)).alias("rows"), summary.alias("items")).first()
        values = kept.sparkSession.createDataFrame([(r["item"],) for r in row["items"]], kept.select(col).schema)
        # at most ``tracked`` values and rows
        counts = (kept.join(F.broadcast(values), col, "left_semi").groupBy(col).agg(F.count(F.lit(1)).alias(out))
                  .checkpoint(eager=True))
        best = top_k(counts, out, k, tie=col)
        seen = counts.agg(F.coalesce(F.sum(out), F.lit(0))).first()[0]
        found, least = best.agg(F.count(F.lit(1)), F.min(out)).first()
        if seen == row.rows or (found == k and least > MISSED * row.rows / tracked):
            return best
        tracked *= 4
    return top_k(kept.groupBy(col).agg(F.count(F.lit(1)).alias(out)), out, k, tie=col)


__all__ = ["heavy_values"]
