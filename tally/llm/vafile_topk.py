"""Exact top-k by inner product with vector-approximation files.

Every distinct vector is approximated by one byte a component: the component's range over the table is
cut into 256 cells.  The approximations alone are scanned: a cell bounds each score from both
sides, and a vector stays a candidate while its upper bound reaches the kth lower bound known.  That bound
is carried: a pilot shard gives each query its first one, and the shards' survivors give the final one.
Exact vectors are then read by id, in two rounds in the order of the bounds: the k best first, then those whose
upper bound still reaches the kth score found.  The stated queries meet all
rows in blocks of bounded size: each (shard, query group) is one group of a cogroup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import join_salted, written

#: Vectors of a shard and queries of a group, on average.
SHARD, GROUP = 8192, 2048
#: Cells of a component's range: a byte.
CELLS = 256
_ENDS = 2.0 ** 64  # twice the range of a long
_EXACT = 1 << 53  # integers up to here are exact in floating point
_LONG = 1 << 63


class Grid:
    """The cells: per component its least value and the cells' width (whole numbers)."""

    def __init__(self, low: list[int], high: list[int], cells: int = CELLS):
        self.low, self.high = low, high
        self.width = [max(1, -(-(h - a + 1) // cells)) for a, h in zip(low, high)]
        self.largest = max((abs(x) for x in [*low, *high]), default=0)

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """One byte a component; differences of longs are taken modulo 2^64, where they fit."""
        off = vectors.astype(np.int64).view(np.uint64) - np.array(self.low, dtype=np.int64).view(np.uint64)
        return (off // np.array(self.width, dtype=np.uint64)).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of every query's score with every approximated vector."""
        low, width = np.array(self.low, dtype=np.float64), np.array(self.width, dtype=np.float64)
        asked = queries.astype(np.float64)
        base = asked @ (low + cells * width).T
        down = np.minimum(asked * (width - 1), 0).sum(1)[:, None]
        up = np.maximum(asked * (width - 1), 0).sum(1)[:, None]
        reach = np.abs(asked).sum(1)[:, None]
        largest = float(self.largest) + float(max(self.width, default=1))
        if 2 * largest * float(reach.max(initial=0)) >= _EXACT:  # rounding widens the bounds
            slack = reach * largest * 1e-9 + 1.0
            down, up = down - slack, up + slack
        return np.clip(base + down, -_ENDS, _ENDS), np.clip(base + up, -_ENDS, _ENDS)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; beyond a long's range they stay at its end."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if largest[0] * largest[1] * max(1, a.shape[1]) < _EXACT:
        return (a * b).sum(axis=1)
    wide = (a.astype(object) * b.astype(object)).sum(axis=1) if a.shape[1] else np.zeros(len(a), dtype=object)
    return np.array([max(-_LONG, min(_LONG - 1, int(s))) for s in wide], dtype=np.int64)


def survivors(grid: Grid, cells: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int
              ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, row numbers, lower, upper) of the rows that can still be among a query's k best.

    ``floors`` are the kth lower bounds known before; the shard's own kth may be better.
    """
    for at in range(0, len(queries), 256):
        lower, upper = grid.bounds(cells, queries[at:at + 256])
        if len(cells) >= k:
            own = np.partition(lower, len(cells) - k, axis=1)[:, len(cells) - k]
            floor = np.maximum(floors[at:at + 256], own)
        else:
            floor = floors[at:at + 256]
        for j in range(len(lower)):
            left = np.flatnonzero(upper[j] >= floor[j])
            if len(left):
                yield at + j, left, lower[j, left], upper[j, left]


def _matrix(column: list, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _grid(distinct: DataFrame) -> Grid:
    """The components' ranges; vectors shorter than others have zeros there."""
    rows = (distinct.select(F.posexplode("v").alias("p", "x")).groupBy("p")
            .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("p").collect())  # a row a component
    n = distinct.count()
    short = [r.n < n for r in rows]
    return Grid([min(0, r.low) if s else r.low for r, s in zip(rows, short)],
                [max(0, r.high) if s else r.high for r, s in zip(rows, short)])


def candidates(distinct: DataFrame, asked: DataFrame, k: int, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query, did, lower, upper): for each query vector a superset of its k best, by the cells alone.

    ``distinct`` has (did, v), ``asked`` the same of the query vectors.  The cells (a byte a component) are
    repeated for every group of queries, exact vectors of queries for every shard.
    """
    grid = _grid(distinct)
    n, m, width = distinct.count(), asked.count(), len(grid.low)
    shards, groups = max(1, -(-n // shard)), max(1, -(-m // group))
    coded = pa.schema([("did", pa.int64()), ("cells", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = grid.cells_of(_matrix(b.column(1).to_pylist(), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], schema=coded)

    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    file = written(distinct.select("did", "v").mapInArrow(encode, "did long, cells binary")
                   .withColumn("shard", number("did", shards)))
    found = pa.schema([("query", pa.int64()), ("did", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, width)
            ids, own = rows.column("did").to_numpy(), queries.column("query").to_numpy()
            floors = queries.column("floor").to_numpy()
            for q, left, lower, upper in survivors(grid, cells, _matrix(queries.column("v").to_pylist(), width), floors, k):
                for c, x in zip(cols, (np.full(len(left), own[q]), ids[left], lower, upper)):
                    c.append(x)
        return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols, found)], schema=found)

    def scan(part: DataFrame, queries: DataFrame, over: int) -> DataFrame:
        """The survivors of the shards below ``over``."""
        rows = part.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        dealt = (queries.withColumn("part", number("query", groups))
                 .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(over - 1)))))
        return rows.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(
            meet, "query long, did long, lower double, upper double")

    def floors(df: DataFrame) -> DataFrame:
        """(query, floor): the kth lower bound, where there are k."""
        best = Window.partitionBy("query").orderBy(F.desc("lower"))
        ranked = df.select("query", "lower").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
        return ranked.groupBy("query").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("held")).where(F.col("held") == k)

    queries = asked.select(F.col("did").alias("query"), "v", F.lit(-_ENDS).alias("floor"))
    if shards > 1:  # a pilot shard gives the first bounds
        pilot = floors(scan(file.where("shard = 0"), queries, 1)).select("query", "floor")
        queries = written(queries.drop("floor").join(pilot, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-_ENDS))))
    left = written(scan(file, queries, shards))
    final = floors(left).select("query", "floor")
    return left.join(final, "query", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).drop("floor")


def scored(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(query, did, score) of the pairs: both exact vectors are read by id."""
    both = (pairs.select("query", "did").join(distinct.select("did", "v"), "did")
            .join(distinct.select(F.col("did").alias("query"), F.col("v").alias("w")), "query").select("query", "did", "v", "w"))
    schema = pa.schema([("query", pa.int64()), ("did", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, w = b.column(2).to_pylist(), b.column(3).to_pylist()
            width = max((len(x) for x in v + w), default=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(exact_scores(_matrix(v, width), _matrix(w, width)))],
                                             schema=schema)

    return both.mapInArrow(run, "query long, did long, score long")


def nearest(distinct: DataFrame, asked: DataFrame, k: int, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """(query, did, score): each query vector's k best vectors, itself among them, and all that tie with the kth."""
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "did")
    left = written(candidates(distinct, asked, k, shard, group).withColumn("n", F.row_number().over(order)))
    first = written(scored(left.where(F.col("n") <= k), distinct))
    kth = first.groupBy("query").agg(F.min("score").alias("kth"))
    # no vector still unread can reach the kth score unless its bound does
    more = left.where(F.col("n") > k).join(kth, "query").where(F.col("upper") >= F.col("kth").cast("double"))
    both = first.unionByName(written(scored(more, distinct)))
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    return both.withColumn("n", F.rank().over(best)).where(F.col("n") <= k).select("query", "did", "score")


def topk(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
         vector_col: str = "embedding", shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best scores over all other rows.

    Components become floor(scale * x); the score is their inner product (a long;
    beyond its range it stays at the range's end).  The queries are the rows whose id is
    divisible by ``every``.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a
    null id; rows with equal ids are rows of their own, queries too; rows of equal vectors are searched as one, of
    which the k + 1 smallest ids can be results; vectors of unequal
    lengths meet as if padded with zeros, and an empty vector scores 0; ties go to the
    smaller id; fewer than k others give fewer rows; an empty table gives an empty
    result; columns other than the two named are ignored.
    """
    vec = F.col(f"`{vector_col}`")
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = written(vectors.where(F.col(f"`{id_col}`").isNotNull() & vec.isNotNull() & finite)
                   .select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                           F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")))
    query = F.col("vec_id") % every == 0
    distinct = written(rows.groupBy("v").agg(F.min("row").alias("did"), F.bool_or(query).alias("asked")))
    # a vector's rows with the smallest ids; copies beyond them are no one's results
    members = (rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))).where(F.col("nth") <= k + 1)
               .join(distinct.select("v", "did"), "v").select("did", "vec_id", "row"))
    # one more than k, as a query's own row is no result
    near = nearest(distinct.select("did", "v"), distinct.where("asked").select("did", "v"), k + 1, shard, group)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    few = (near.join(members, "did").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
           .groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "vec_id", "row", "score"))).alias("best")))
    # the query rows of one vector may be many: they are salted
    asked = join_salted(rows.where(query).select("row", "vec_id", "v"), distinct.where("asked").select("v", "did"), "v", F.col("row"))
    met = join_salted(asked.select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), F.col("did").alias("query")), few,
                      "query", F.col("own"))
    others = F.slice(F.filter(F.reverse("best"), lambda s: s["row"] != F.col("own")), 1, k)
    return (met.select("query_id", F.posexplode(others).alias("at", "s"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score")))
