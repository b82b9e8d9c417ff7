import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import vafile_topk
from tally.llm.vafile_topk import Grid, exact_scores, survivors, topk
from tests.llm.common import DATA, empty_like


def score(a, b):
    s = sum(x * y for x, y in zip(a, b))
    return max(-(1 << 63), min((1 << 63) - 1, s))


@pytest.mark.parametrize("trial", range(40))
def test_cells_bound_every_score(trial):
    """No vector among the k best, ties with the kth included, is lost; and few others stay if cells are narrow."""
    rng = np.random.default_rng(trial)
    n, d, k = int(rng.integers(1, 80)), int(rng.integers(1, 6)), int(rng.integers(1, 8))
    high = (6, 3000, 1 << 40, (1 << 63) - 1)[trial % 4]
    vectors = rng.integers(-high, high, (n, d), endpoint=True)
    grid = Grid(vectors.min(0).tolist(), vectors.max(0).tolist(), int(rng.choice([4, 256])))
    cells = grid.cells_of(vectors)
    assert cells.dtype == np.uint8
    for j, (c, v) in enumerate(zip(cells.tolist(), vectors.tolist())):
        assert all(a + x * w <= y < a + (x + 1) * w for a, w, x, y in zip(grid.low, grid.width, c, v))
    queries = vectors[rng.integers(0, n, 5)]
    got = {q: set(left.tolist()) for q, left, _, _ in survivors(grid, cells, queries, np.full(5, -2.0 ** 64), k)}
    for j, q in enumerate(queries.tolist()):
        scores = [score(v, q) for v in vectors.tolist()]
        kth = sorted(scores, reverse=True)[min(k, n) - 1]
        best = {i for i, s in enumerate(scores) if s >= kth}
        assert best <= got[j]
        if trial % 4 == 0 and max(grid.width) == 1 and n > k:
            assert got[j] == best  # cells of width 1 are exact
    want = [score(v, q) for v, q in zip(vectors.tolist(), queries.tolist())]
    assert exact_scores(vectors[:5], queries[:n]).tolist() == want[:5] if n >= 5 else True


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(130)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf"), 1.0]), (280, []), (300, [0.5]),
             (None, [1.0] * 8), (40, rows[40][1]), (131, rows[20][1]), (132, rows[20][1]), (60, rows[61][1])]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, shard int")


def brute(rows, every, k):
    kept = [(r.vec_id, [max(-(1 << 63), min((1 << 63) - 1, math.floor(64 * x))) for x in r.embedding]) for r in rows
            if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for j, (q, own) in enumerate(kept):
        if q % every == 0:
            best = sorted((-score(v, own), i) for h, (i, v) in enumerate(kept) if h != j)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,group,k", [(8192, 2048, 20), (16, 3, 5), (40, 2, 500)])
def test_against_brute_force(spark, shard, group, k):
    df = vectors(spark)
    got = sorted(map(tuple, topk(df, k=k, shard=shard, group=group).collect()))
    assert got == brute(df.collect(), 20, k)


def test_huge_components(spark):
    rows = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(50)] + [(60, [1e15, -1e15]), (80, [0.25, 1e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk(df, k=4, shard=9).collect())) == brute(df.collect(), 20, 4)


def test_hot_vector(spark):
    """A third of the rows are one vector: it is searched once, and its smallest ids are the results."""
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5] if i % 3 == 0 else [float(x) for x in rng.normal(0, 0.3, 2)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk(df, shard=100, group=7).collect())) == brute(df.collect(), 20, 20)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """Of all pairs the cells leave a small share."""
    read = []
    real = vafile_topk.scored
    monkeypatch.setattr(vafile_topk, "scored", lambda pairs, d: read.append(pairs.count()) or real(pairs, d))
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    n = df.count()
    queries = df.where(F.col("vec_id") % 20 == 0).count()
    assert topk(df, shard=100).count() == 20 * queries
    assert sum(read) < 0.06 * n * queries  # 21 of 500 are 0.042


def test_empty_table(spark):
    assert topk(empty_like(vectors(spark))).count() == 0
