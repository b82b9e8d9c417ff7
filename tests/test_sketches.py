"""Stored distinct sketches, rankings pruned by sketch bounds, and certified heavy values."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tally.operators import heavy
from tally.operators.heavy import heavy_values
from tally.operators.sketches import (
    append_sketches, candidates_by_distinct, checked_counts, distinct_sketches, merged_counts, ranked_by_distinct,
)


def visits(n=4000, seed=1):
    rnd = random.Random(seed)
    return [(rnd.randint(0, 20), rnd.choice("abc"), rnd.randint(0, 300)) for _ in range(n)] + [(None, "a", 1), (3, "a", None)]


def test_sketches_merge_over_days(spark, tmp_path):
    rows = visits()
    df = spark.createDataFrame(rows, "day int, shop string, user long")
    half = df.where("day < 10 or day is null"), df.where("day >= 9")  # day 9 is in both loads
    for part in (*half, half[0]):  # and the first load comes twice
        table = append_sketches(distinct_sketches(part, ["day", "shop"], "user"), str(tmp_path / "t"))
    want = defaultdict(set)
    for day, shop, user in rows:
        if day is not None and user is not None:
            want["shop", shop].add(user)
            want["week", day // 7].add(user)
    for name, by in (("shop", "shop"), ("week", {"week": F.floor(F.col("day") / 7)})):
        got = {r[name]: r for r in merged_counts(table, by).collect()}
        assert set(got) == {k for n, k in want if n == name}
        for k, r in got.items():
            assert r.approx_low <= len(want[name, k]) <= r.approx_high and r.approx_high < 1.1 * r.approx_low + 4
    exact = df.where("day is not null").groupBy("shop").agg(F.count_distinct("user").alias("users"))
    assert [r.within_bound for r in checked_counts(exact, "shop", "users", merged_counts(table, "shop")).collect()] == [True] * 3
    wrong = exact.withColumn("users", F.col("users") * 2)
    assert not any(r.within_bound for r in checked_counts(wrong, "shop", "users", merged_counts(table, "shop")).collect())


def grouped(spark, sizes, repeats=3, seed=2):
    """Groups of so many distinct ids, each several times; one group's rows are a third of all."""
    rnd = random.Random(seed)
    rows = [(g, i) for g, n in sizes.items() for i in range(n) for _ in range(repeats)]
    hot = max(sizes, key=sizes.get)
    rows += [(hot, 0)] * (len(rows) // 2) + [(None, 1), ("idless", None)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g string, i long").repartition(5)


@pytest.mark.parametrize("ascending", [False, True])
def test_pruned_ranking_with_ties_and_a_hot_group(spark, ascending):
    sizes = {f"p{i:02d}": 20 + 15 * i for i in range(30)} | {f"t{i}": 455 for i in range(3)} | {f"s{i}": 20 for i in range(3)}
    df = grouped(spark, sizes)
    want = sorted([*sizes.items(), ("idless", 0)], key=lambda x: (x[1] if ascending else -x[1], x[0]))
    for k in (1, 3, 5):
        got = [(r.g, r.n) for r in ranked_by_distinct(df, "g", "i", k, ascending, "n").collect()]
        assert got == want[:k]
    few = candidates_by_distinct(df, "g", "i", 3, ascending).count()
    assert 3 <= few < len(sizes) / 2
    assert ranked_by_distinct(df, "g", "i", 100, ascending).count() == len(want)
    assert ranked_by_distinct(df.where("1 = 0"), "g", "i", 3, ascending).count() == 0


def test_coarse_sketches_only_widen_the_candidates(spark):
    sizes = {f"p{i}": 900 + i for i in range(25)}
    df = grouped(spark, sizes, 2)
    got = [(r.g, r.n_distinct) for r in ranked_by_distinct(df, "g", "i", 2, lg_k=4).collect()]
    assert got == [("p24", 924), ("p23", 923)]


def full(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


def long_tail(seed=4):
    rnd = random.Random(seed)
    return [f"h{i}" for i in range(12) for _ in range(400 - 20 * (i // 3))] + [f"t{rnd.randint(0, 20000)}" for _ in range(20000)] + [None] * 9


@pytest.mark.parametrize("k", [1, 5, 12, 14])
def test_certified_on_a_long_tail_with_ties(spark, monkeypatch, k):
    """Also where the kth is in the tail, which no summary certifies: then all are counted."""
    values = long_tail()
    monkeypatch.setattr(heavy, "MOST_TRACKED", 4096)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = [(r.v, r.n) for r in heavy_values(df, "v", k, tracked=256, most=4096).collect()]
    assert got == full(values, k)


def test_few_values_and_none(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,), ("",)], "v string")
    assert [(r.v, r.n) for r in heavy_values(df, "v", 10).collect()] == [("a", 2), ("", 1), ("b", 1)]
    assert heavy_values(df.where("1 = 0"), "v", 3).count() == 0


def test_uniform_values_fall_back(spark):
    df = spark.range(6000).select((F.col("id") % 3000).cast("string").alias("v"))
    got = [(r.v, r.n) for r in heavy_values(df, "v", 3, tracked=16, most=64).collect()]
    assert got == [("0", 2), ("1", 2), ("10", 2)]
