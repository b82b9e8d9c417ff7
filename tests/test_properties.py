"""Random small frames (nulls, NaN, ties, empty strings) against pandas / numpy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tally.operators import count_distinct_by, sum_by, token_counts, top_k
from tally.operators.profiling import exact_quantiles

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
keys = st.sampled_from(["a", "b", "c", None])
values = st.one_of(st.none(), st.just(float("nan")), st.floats(-1e6, 1e6, allow_nan=False))


@SETTINGS
@given(st.lists(st.tuples(keys, values), min_size=1, max_size=40))
def test_sum_by_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.v for r in sum_by(df, "k", {"v": "v"}).collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].sum().to_dict()
    assert got.keys() == want.keys()
    for k in want:
        assert math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-6)


@SETTINGS
@given(st.lists(st.tuples(keys, st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=40))
def test_count_distinct_by_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows, "k string, id int")
    got = {r.k: r.n for r in count_distinct_by(df, "k", "id", "n").collect()}
    want = pd.DataFrame(rows, columns=["k", "id"]).groupby("k")["id"].nunique().to_dict()
    assert got == want


texts = st.one_of(st.none(), st.lists(st.sampled_from(["x", " y", "z ", "", " w", "x"]), max_size=4)
                  .map(",".join))


@SETTINGS
@given(st.lists(texts, min_size=1, max_size=20))
def test_token_counts_match_pandas(spark, rows):
    df = spark.createDataFrame([(t,) for t in rows], "s string")
    got = {r.token: r.n for r in token_counts(df, "s").collect()}
    want = Counter(piece.strip() for t in rows if t is not None for piece in t.split(","))
    assert got == dict(want)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.just(float("nan")), st.integers(-50, 50).map(float)),
                min_size=1, max_size=60))
def test_exact_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    clean = np.array([x for x in xs if x is not None and not math.isnan(x)])
    rows = exact_quantiles(df, ["x"]).collect()
    if clean.size == 0:
        assert rows == []
        return
    r = rows[0]
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert math.isclose(r[name], float(np.percentile(clean, q * 100)), rel_tol=1e-12, abs_tol=1e-12)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.one_of(
    st.none(), st.just(float("nan")), st.integers(0, 4).map(float))), min_size=1, max_size=30,
                unique_by=lambda t: t[0]), st.integers(1, 5), st.booleans())
def test_top_k_is_sorted_prefix(spark, rows, k, ascending):
    """NaN and null come last in both directions."""
    df = spark.createDataFrame(rows, "k string, v double")
    got = [r.k for r in top_k(df, "v", k, tie="k", ascending=ascending).collect()]
    absent = lambda v: v is None or math.isnan(v)
    want = sorted(rows, key=lambda t: (absent(t[1]), 0 if absent(t[1]) else t[1] if ascending else -t[1], t[0]))
    assert got == [t[0] for t in want[:k]]
