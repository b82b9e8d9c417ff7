"""Bracketed quantiles and moments against numpy, also where the sketch misses or intervals are large."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.operators import quantiles
from tally.operators.profiling import DESCRIBE_PROBS, describe_numeric, exact_quantiles


def frame(spark, columns):
    n = max(len(c) for c in columns)
    rows = [tuple(float(c[i]) if i < len(c) and c[i] is not None else None for c in columns) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(columns)))).repartition(4)


def check(spark, columns):
    df = frame(spark, columns)
    got = {r.column_name: r for r in describe_numeric(df).collect()}
    for i, c in enumerate(columns):
        v, r = np.array([x for x in c if x is not None and not math.isnan(x)], dtype=float), got[f"c{i}"]
        assert r.n == len(v)
        if not len(v):
            assert r.mean is None and r.p25 is None and r.min is None
            continue
        assert [r.min, r.p25, r.p50, r.p75, r.max] == pytest.approx([v.min(), *np.percentile(v, [25, 50, 75]), v.max()], rel=1e-12)
        assert r.mean == pytest.approx(v.mean(), rel=1e-9, abs=1e-9)
        if len(v) > 1:
            assert r.std == pytest.approx(v.std(ddof=1), rel=1e-9, abs=1e-9)
        else:
            assert r.std is None


def random_columns(n=5000, seed=3):
    rnd = np.random.default_rng(seed)
    return [rnd.normal(1e6, 3, n), rnd.integers(0, 4, n), np.round(rnd.lognormal(3, 2, n), 2), np.where(rnd.random(n) < 0.4, 7.0, rnd.random(n)),
            np.concatenate((np.zeros(n - 3), [1, 2, 3])), np.arange(n) % 2 * 1e15 - 5e14]


def test_columns_of_all_kinds(spark):
    check(spark, [*map(list, random_columns()), [None, float("nan")], [], [5.0], [1.5, None, 1.5], [-1e300, 2e300, 0.25]])


def test_small_sketches_and_narrowed_intervals(spark, monkeypatch):
    """A coarse sketch and a low bound of rows: intervals are narrowed by scans of their own, with the same result."""
    narrowed = []
    real = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: narrowed.append(1) or real(*a))
    monkeypatch.setattr(quantiles, "INSIDE", 20)
    monkeypatch.setattr(quantiles.bracketed_counts, "__defaults__", (50,))
    check(spark, [*map(list, random_columns(3000))])
    assert narrowed


def test_a_sketch_that_misses_is_widened(spark, monkeypatch):
    """An error bound far too small: the exact counts show that ranks lie outside, and the interval grows."""
    rounds = []
    real = quantiles._certain
    monkeypatch.setattr(quantiles, "_certain", lambda *a: rounds.append(real(*a)) or rounds[-1])
    monkeypatch.setattr(quantiles, "sketch_error", lambda k: 1e-7)
    monkeypatch.setattr(quantiles.bracketed_counts, "__defaults__", (8,))
    check(spark, [list(np.random.default_rng(1).random(4000))])
    assert len(rounds) > 1 and not rounds[0] and rounds[-1]


def test_many_probabilities(spark):
    v = np.random.default_rng(2).random(2000)
    probs = [(f"q{i}", i / 20) for i in range(21)]
    r = exact_quantiles(frame(spark, [list(v)]), ["c0"], probs).first()
    assert [r[name] for name, _ in probs] == pytest.approx(np.percentile(v, [100 * q for _, q in probs]), rel=1e-12)


def test_insides_alone_are_kept(spark):
    """Most distinct values of a wide column are counted outside, in one row a gap."""
    df = spark.range(400000).select(F.xxhash64("id").cast("double").alias("c0"))
    counts, state = quantiles.bracketed_counts(df, ["c0"], DESCRIBE_PROBS)
    assert counts.count() < 400000 * 12 * quantiles.sketch_error(quantiles.SKETCH_K)
    assert counts.where("value is null").count() == 4 and counts.agg(F.sum("c")).first()[0] == 400000
