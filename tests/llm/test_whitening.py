from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import whitening
from tally.llm.whitening import chebyshev_subspace, fit, quantised, whiten
from tests.llm.common import DATA

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=16):
    """{vec_id: x}, n, S, eigenvalues and vectors of the fit list, by numpy's dense solver on the exact covariance."""
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in keep), default=0)
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] + [1000000] * (d - len(v)) for _, v in keep],
                 dtype=np.int64).reshape(len(keep), d)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    off = (n * u - s).astype(np.float64) / max(n, 1)
    e, q = np.linalg.eigh(off.T @ off / max(n, 1)) if n and d else (np.zeros(0), np.zeros((0, 0)))
    return [i for i, _ in keep], x, n, s, e[::-1][:components], q[:, ::-1][:, :components], float((off * off).sum()) / max(n, 1)


def check(df, components=16, precision=1e-9, **kw):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    ids, x, n, s, e, q, trace = plain(rows, components)
    k = int((e > 1e-10 * e[0]).sum()) if len(e) else 0
    got = whiten(df, components=components, **kw).collect()
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    white = (n * x - s) / n @ q[:, :k] / np.sqrt(e[:k])
    signs = {}
    for i, v, w in zip(ids, x, white):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        for c in range(k):
            found = [r for r in by[i, c + 1] if r.deviation == deviation]
            assert found and all(r.n == n and r.identity_error < 1e-9 for r in found)
            assert all(abs(r.explained - e[c] / trace) < 1e-12 for r in found)
            if abs(w[c]) > 1e-3:
                signs.setdefault(c, {round(float(np.sign(w[c] * r.whitened))) for r in found})
            sign = next(iter(signs.get(c, {1})))
            assert any(abs(r.whitened - sign * w[c]) <= precision * max(1, abs(w[c])) for r in found), (i, c)


def test_whole_table(spark):
    check(spark.read.parquet(f"{DATA}/embeddings.parquet"))


def test_larger_block_than_space_and_few_components(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 200")
    check(df, components=3, extra=2, degree=6)
    check(df, components=60)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [0.25, -1.0, 3.0]), (3, [1.0, 2.0, 0.5]), (4, None), (5, [1.0, None, 2.0]),
            (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (None, [4.0, 1.0, -2.0]), (8, [0.5]), (9, []), (2, [0.25, -1.0, 3.0]),
            (2, [2.5, 1.5, -3.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("x", "rows", "part", "component", "n")])
    check(df)
    for some in (rows[:0], rows[3:7], [rows[0], rows[2]], [(1, []), (2, [])]):
        assert whiten(spark.createDataFrame(some, SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame(rows, SCHEMA)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_lower_rank_and_huge_entries(spark):
    line = [(i, [float(i % 7), 2.0 * (i % 7), 1.0, 0.0]) for i in range(40)]
    got = whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert len(got) == 40 and {r.component for r in got} == {1} and {r.n for r in got} == {7}
    huge = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(6)]
    got = whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert len(got) >= 6 and all(np.isfinite(r.whitened) for r in got)


def test_deviations_are_exact():
    total, n = [3 * 10 ** 17 + 5, -7], 10 ** 6
    mean, rest = whitening._centre(total, n)
    x = np.array([[3 * 10 ** 11 + 123456, 4]], dtype=np.int64)
    want = [n * int(a) - b for a, b in zip(x[0], total)]
    assert [int(v) for v in whitening._deviations(x, n, mean, rest)[0]] == want
    big = np.array([[1 << 60, 5]], dtype=np.int64)
    got = whitening._deviations(big, n, mean, rest)
    assert [int(v) for v in got[0]] == [n * int(a) - b for a, b in zip(big[0], total)]
    assert whitening._squares(got)[0] == (1 << 63) - 1


@pytest.mark.parametrize("spectrum", ["flat", "steep", "low rank"])
def test_subspace_against_dense(spectrum):
    """Certified pairs agree with the dense solver, also where neighbouring values are close."""
    rnd = np.random.default_rng(8)
    d = 80
    values = {"flat": np.concatenate(([106, 104], np.linspace(68, 57, d - 2))), "steep": 100 * 0.7 ** np.arange(d),
              "low rank": np.concatenate((np.arange(10, 0, -1), np.zeros(d - 10)))}[spectrum].astype(float)
    basis = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    v = (basis * values) @ basis.T
    passes = []
    e, q, rounds, residual = chebyshev_subspace(lambda x: passes.append(1) or v @ x, d, 16)
    assert residual <= 1e-11 and len(passes) < 90
    assert np.abs(e - values[:16]).max() < 1e-12 * values[0]
    for j in range(10 if spectrum == "low rank" else 16):
        assert abs(abs(basis[:, j] @ q[:, j]) - 1) < 1e-12


def test_uncertified_fails():
    v = np.diag(np.linspace(2, 1, 200))
    with pytest.raises(RuntimeError):
        chebyshev_subspace(lambda x: v @ x, 200, 16, extra=1, degree=2, rounds=1)


def test_sums_of_many_tasks(spark, monkeypatch):
    """Beyond FEW tasks the sums are added in two steps; the result is the same."""
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 100").repartition(8)
    whole = quantised(df, "vec_id", "embedding")
    one = fit(whole, 4)
    monkeypatch.setattr(whitening, "FEW", 0)
    two = fit(whole, 4)
    assert one.n == two.n and np.allclose(one.values, two.values, rtol=1e-12)
    exact = sum(Fraction(int(v)) for v in one.sums)
    assert exact == sum(two.sums)
