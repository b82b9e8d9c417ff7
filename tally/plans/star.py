"""Joining the fact table to its dimensions at any size.

A dimension is broadcast only after its size is shown to fit under the
broadcast limit: its row count (a Parquet footer read, no data scan) times the
fixed slot width first, and, only when that passes (so the table is small), the
exact bytes of its variable-length values.  Beyond the limit the fact is first
aggregated to the join key (``rollup_join``), so the sort-merge join sees one
row per key instead of one per line: the aggregate and the join hash-partition
on the same key, so the pre-aggregation adds no shuffle, and a hot key is
folded map-side before it is shuffled.

The limit is ``spark.sql.autoBroadcastJoinThreshold`` unless the session sets
``tally.broadcast.maxBytes`` (0 forces the shuffle path, as the tests do).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.session import ensure_checkpoint_dir

_FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
          T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.DecimalType)
_ROW_OVERHEAD = 16  # row header and hash-table entry, per row


def _fixed_bytes(df: DataFrame) -> int:
    # 8 bytes per field slot (a variable-length field's slot holds offset and length)
    return _ROW_OVERHEAD + 8 * len(df.schema.fields)


def _variable_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _FIXED)]


def broadcast_limit(df: DataFrame) -> int:
    conf = df.sparkSession.conf
    own = conf.get("tally.broadcast.maxBytes", None)
    if own is not None:
        return int(own)
    raw = conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        return int(raw)
    except ValueError:  # e.g. "10MB"
        units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        s = raw.strip().lower().rstrip("b") or "0"
        return int(float(s[:-1]) * units[s[-1]]) if s[-1] in units else int(float(s))


#: (rows, exact bytes or None) of dimensions measured so far, by plan and files.
_SIZES: dict[tuple, tuple[int, int | None]] = {}


def _identity(dim: DataFrame) -> tuple:
    """The plan, its input files and their total size: changes when the files do."""
    size = dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return dim.semanticHash(), int(str(size)), hash(tuple(sorted(dim.inputFiles())))


def dimension_bytes(dim: DataFrame, limit: int) -> int:
    """Size of the dimension as broadcast rows, exact where it matters.

    Rows (a Parquet footer read) x fixed slot bytes is a lower bound; if that
    already exceeds ``limit`` the dimension is large and nothing is scanned.
    Otherwise the table is small, and the bytes of its variable-length values
    are added exactly by one pass over it.  Both are measured again once the files differ.
    """
    key = _identity(dim)
    rows, wide = _SIZES.get(key, (None, None))
    if rows is None:
        rows = dim.count()
    fixed = rows * _fixed_bytes(dim)
    var = _variable_fields(dim)
    if fixed <= limit and var and wide is None:
        width = sum(F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in var)
        wide = int(dim.agg(F.sum(width)).first()[0] or 0)
    _SIZES[key] = rows, wide
    return fixed if fixed > limit else fixed + (wide or 0)


def fits_broadcast(dim: DataFrame) -> bool:
    """True when the dimension's rows are shown to fit under the broadcast limit.

    ``dim`` should be the projected scan, so only the columns the join carries count.
    """
    limit = broadcast_limit(dim)
    if limit <= 0:
        return False
    return dimension_bytes(dim, limit) <= limit


def join_dim(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
             how: str = "inner") -> DataFrame:
    """Fact-to-dimension equi-join; broadcast only when the size check passes."""
    side = F.broadcast(dim) if fits_broadcast(dim) else dim
    return fact.join(side, fact[fact_key] == side[dim_key], how)


def hot_keys(fact: DataFrame, key: str) -> DataFrame | None:
    """The keys (column ``key``) that hold more than an average shuffle partition's rows, or None.

    Fewer than there are partitions, by counting; found by one map-side aggregate of that column, and checkpointed.
    """
    ensure_checkpoint_dir(fact.sparkSession)
    n = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = fact.select(F.col(key).alias("key")).where("key is not null")
    found = known.groupBy("key").count().where(F.col("count") * n > F.lit(known.count())).select("key").checkpoint(eager=True)
    return found if found.limit(1).count() else None


def split_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Line-grain equi-join with a dimension of unique keys, whose hot keys never meet in one task.

    A small dimension is broadcast.  With a large one the lines of hot keys are split off: their few dimension rows
    are broadcast to them wherever they are, and only the other lines are shuffled.  No side is copied.
    """
    if fits_broadcast(dim):
        return join_dim(fact, dim, fact_key, dim_key)
    hot = hot_keys(fact, fact_key)
    if hot is None:
        return fact.join(dim, fact[fact_key] == dim[dim_key])
    few = F.broadcast(hot)  # fewer rows than shuffle partitions
    of_hot = dim.join(few, dim[dim_key] == few["key"], "left_semi").checkpoint(eager=True)
    if of_hot.count() > hot.count():  # keys that repeat: adaptive execution splits what is large
        return fact.join(dim, fact[fact_key] == dim[dim_key])
    large = fact.join(few, fact[fact_key] == few["key"], "left_semi")
    rest = fact.join(few, fact[fact_key] == few["key"], "left_anti")
    return (rest.join(dim, rest[fact_key] == dim[dim_key])
            .unionByName(large.join(F.broadcast(of_hot), large[fact_key] == of_hot[dim_key])))


def rollup_join(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                sums: Mapping[str, Column | str] | None = None,
                fact_keys: Sequence[str] = (), count_as: str | None = None,
                pre_aggregate: bool | None = None, co_located: bool = False) -> DataFrame:
    """Join ``dim`` to the fact, folded to the grain (``fact_key``, ``fact_keys``) where that pays.

    The number of rows is not fixed: lines where the dimension is small, one row a grain
    where it is large.  Callers aggregate again.  Output: ``fact_key``, ``fact_keys``, every ``sums`` column (summed per grain;
    exact for integer and decimal measures), optionally ``count_as`` (lines per
    grain), plus the dimension columns.  Summing again over any dimension column
    gives the same answer as summing the raw lines, because sums and counts are
    decomposable.

    A small dimension is broadcast to the raw lines (no fact shuffle at all);
    a large one meets the fact after the fact is aggregated to the key.
    ``pre_aggregate=True`` aggregates first in every case: worth it when heavy
    per-row work follows the join (the aggregate shuffle is then much smaller
    than the work it saves), and the small dimension is still broadcast.  ``co_located`` says that
    both are bucketed alike on the key (``sources.layout``): the lines fold and meet the dimension
    bucket by bucket, without an exchange of either.
    """
    sums = dict(sums or {})
    grain = [fact_key, *fact_keys]
    small = not co_located and fits_broadcast(dim)
    if small and not pre_aggregate:
        cols = [F.col(c) for c in grain] + [(F.col(e) if isinstance(e, str) else e).alias(n)
                                           for n, e in sums.items()]
        if count_as:
            cols.append(F.lit(1).cast("bigint").alias(count_as))
        lines = fact.select(*cols)
        return lines.join(F.broadcast(dim), lines[fact_key] == dim[dim_key])
    aggs = [F.sum(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in sums.items()]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    per_key = fact.groupBy(*grain).agg(*aggs) if aggs else fact.select(*grain).distinct()
    side = F.broadcast(dim) if small else dim.hint("merge") if co_located else dim
    return per_key.join(side, per_key[fact_key] == side[dim_key])
