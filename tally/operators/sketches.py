"""Distinct counts from stored, mergeable sketches, and rankings by distinct ids that dedupe few groups.

A table of one HyperLogLog sketch per (day, key) answers distinct counts for any union of them, a weekday,
a month, a run of days, without reading the facts: sketches of overlapping sets merge, counts do not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.operators.aggregate import count_distinct_by, drop_null_keys
from tally.operators.ranking import top_k
from tally.session import ensure_checkpoint_dir

#: Sketches have 2^LG_K registers (of 6 bits): 12 KB at most, less for few ids.
LG_K = 14
#: Relative error of a merged sketch's count, in standard deviations: the stated bound.
BOUND_SIGMAS = 4.0
#: The same where a bound decides which groups are left out: 2e-9 a group.
PRUNE_SIGMAS = 6.0


def relative_error(lg_k: int, sigmas: float) -> float:
    return sigmas * 1.04 / sqrt(1 << lg_k)


def _bounds(approx: str, error: float) -> tuple[Column, Column]:
    """The least and the greatest count that a sketch's answer leaves possible."""
    high = F.ceil(F.col(approx) / (1 - error)) if error < 1 else F.lit((1 << 63) - 1)
    return F.floor(F.col(approx) / (1 + error)).cast("long"), high.cast("long")


def distinct_sketches(df: DataFrame, keys: str | Sequence[str], id_col: str, lg_k: int = LG_K) -> DataFrame:
    """(keys, sketch): a sketch of the distinct non-null ids of each key; null keys are dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return drop_null_keys(df, keys).groupBy(*keys).agg(F.hll_sketch_agg(id_col, F.lit(lg_k)).alias("sketch"))


def append_sketches(sketches: DataFrame, path: str) -> DataFrame:
    """Add sketches to the table at ``path`` and return it.

    A key may have several rows, of several loads: they merge like any others, and ids that were in an
    earlier load count once.  A load that is added twice changes nothing.
    """
    sketches.write.mode("append").parquet(path)
    return sketches.sparkSession.read.parquet(path)


def merged_counts(table: DataFrame, by: str | Column | Mapping[str, Column], out: str = "approx",
                  lg_k: int = LG_K) -> DataFrame:
    """(group, out, out_low, out_high): distinct ids of each group of sketches, and the stated bounds.

    ``by`` is a key column, or a name and an expression of the keys (a day's weekday); null groups are dropped.
    """
    named = {by: F.col(by)} if isinstance(by, str) else dict(by)
    grouped = drop_null_keys(table.select(*[e.alias(n) for n, e in named.items()], "sketch"), list(named))
    counts = grouped.groupBy(*named).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))
    low, high = _bounds(out, relative_error(lg_k, BOUND_SIGMAS))
    return counts.withColumns({f"{out}_low": low, f"{out}_high": high})


def checked_counts(exact: DataFrame, key: str, count: str, approx: DataFrame, out: str = "approx") -> DataFrame:
    """The exact counts with ``within_bound``: whether each lies within its sketch's bounds."""
    inside = F.col(count).between(F.col(f"{out}_low"), F.col(f"{out}_high"))
    # one row a group on both sides
    return exact.join(approx, key, "left").select(*exact.columns, F.coalesce(inside, F.col(count) == 0).alias("within_bound"))


def candidates_by_distinct(rows: DataFrame, key: str, id_col: str, k: int, ascending: bool = False,
                           lg_k: int = LG_K) -> DataFrame:
    """(key) that can still be among the k with the most (or, ``ascending``, the fewest) distinct ids.

    A group's bounds are its sketch's count, less and plus PRUNE_SIGMAS, and at most its rows.  The kth best
    bound is certain to be reached; groups whose other bound falls short of it go.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    low, high = _bounds("approx", relative_error(lg_k, PRUNE_SIGMAS))
    sized = (drop_null_keys(rows, key).groupBy(key)
             .agg(F.hll_sketch_estimate(F.hll_sketch_agg(id_col, F.lit(lg_k))).alias("approx"), F.count(id_col).alias("n"))
             .select(key, low.alias("low"), F.least("n", high).alias("high"))
             .checkpoint(eager=True))  # one row a group: read for the kth bound and again for the test
    mine, other = ("high", "low") if ascending else ("low", "high")
    kth = top_k(sized, mine, k, tie=key, ascending=ascending).select((F.max if ascending else F.min)(mine)).scalar()
    return sized.where(F.col(other) <= kth if ascending else F.col(other) >= kth).select(key)


def ranked_by_distinct(rows: DataFrame, key: str, id_col: str, k: int, ascending: bool = False, out: str = "n_distinct",
                       lg_k: int = LG_K) -> DataFrame:
    """The k groups with the most (fewest) distinct ids, ties by key: one pass of sketches, then only the
    candidates' rows are deduplicated.  The counts are exact."""
    few = candidates_by_distinct(rows, key, id_col, k, ascending, lg_k)
    return top_k(count_distinct_by(rows.join(few, key, "left_semi"), key, id_col, out), out, k, tie=key, ascending=ascending)


__all__ = ["distinct_sketches", "append_sketches", "merged_counts", "checked_counts", "candidates_by_distinct",
           "ranked_by_distinct", "relative_error"]
