import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tally.llm import simhash_dedup
from tally.llm.simhash_dedup import anchor_keys, anchor_steps, fingerprint, forest, home, near_duplicates
from tests.llm.common import DATA, LOWER, ODD_TEXTS, WORD, empty_like, odd_documents


def plain_fingerprint(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=3):
    """Least id reachable of each id, by all pairs; ``fps``: id -> set of fingerprints."""
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(fps), 2):
        if any((a ^ b).bit_count() <= distance for a in fps[i] for b in fps[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in fps}


def check(df, distance=3, **kw):
    rows = df.select("doc_id", "text").collect()
    fps = {}
    for r in rows:
        if r.doc_id is not None:
            fps.setdefault(r.doc_id, set()).add(plain_fingerprint(r.text))
    want = plain_components(fps, distance)
    got = near_duplicates(df, distance=distance, **kw).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id]
            assert int(r.fingerprint, 16) in fps[r.doc_id] and len(r.fingerprint) == 16


def test_fingerprint_is_sparks_hash(spark):
    text = "One two  THREE\nfour"
    grams = spark.sql("select xxhash64('one two three') a, xxhash64('two three four') b").first()
    both = grams.a & grams.b & (1 << 64) - 1  # of two hashes, over half means both
    assert fingerprint(text.encode(), 3) == both
    assert fingerprint(b"one  two", 3) == spark.sql("select xxhash64('one two')").first()[0] & (1 << 64) - 1
    assert fingerprint(b"", 3) == fingerprint(b" \n", 3) == 0


def test_slices_do_not_matter(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "CD", "efg", "é"]) for _ in range(4000))
    want = plain_fingerprint(text)
    assert fingerprint(text.encode(), 3) == want
    from tally.llm import common
    monkeypatch.setattr(common, "SLICE", 100)
    assert fingerprint(text.encode(), 3) == want


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_code_covers(distance):
    """Every half is within one bit of its home, and pairs within the distance meet at a home."""
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 300, dtype=np.uint64)
    halves = a.astype(np.uint32)
    assert (np.bitwise_count(home(halves) ^ halves) <= 1).all() and (home(home(halves)) == home(halves)).all()
    b = a.copy()
    for i in range(len(b)):
        for j in rnd.choice(64, distance, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(j)
    (ra, ka), (rb, kb) = (anchor_keys(x, 1 + distance // 2) for x in (a, b))
    for i in range(len(a)):
        met = set(ka[ra == i].tolist()) & set(kb[rb == i].tolist())
        keys = np.array(sorted(met), dtype=np.int64)
        assert simhash_dedup.at_home(keys, np.full(len(keys), a[i])).any()
    n = np.bincount(ra)
    if distance == 3:
        assert n.max() == 34
    for i in range(20):  # all anchors within the reach, each once
        assert len(set(ka[ra == i].tolist())) == n[i]


def test_against_all_pairs(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet").limit(500))


@pytest.mark.parametrize("distance", [0, 8])
def test_other_distances(spark, distance):
    check(spark.read.parquet(f"{DATA}/documents.parquet").limit(150), distance)


def test_odd_documents(spark):
    df = odd_documents(spark)
    check(df)
    assert near_duplicates(df).count() == len(ODD_TEXTS) + 4
    assert near_duplicates(empty_like(df)).count() == 0
    assert near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id"]


def clustered(n, seed=5):
    """Distinct fingerprints of one tight cluster, in which chains of links matter, and some far ones."""
    rnd = random.Random(seed)
    base, found = rnd.getrandbits(64), set()
    while len(found) < n:
        x = base
        for j in rnd.sample(range(64), rnd.randint(0, 5)):
            x ^= 1 << j
        found.add(x if rnd.random() < 0.9 else rnd.getrandbits(64))
    return np.array(sorted(found), dtype=np.uint64)


@pytest.mark.parametrize("chunk", [16, 8192])
def test_hot_anchors(spark, monkeypatch, chunk):
    """Anchors of many rows, cut by ranges and chunks, give the same components as all pairs."""
    monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    monkeypatch.setattr(simhash_dedup, "written", lambda df: df)
    fps = clustered(400)
    reps = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        steps = anchor_steps(reps, 3, 7).persist()
        assert steps.where("key is not null").count() > (20 if chunk == 16 else 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    links = steps.where("a is not null").select("a", "b").unionByName(
        simhash_dedup.block_links(steps.where("key is not null").select("key", "block", "fps"), 3)).collect()
    want = plain_components({i: {int(x)} for i, x in enumerate(fps)})
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    parent = {i: i for i in want}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        x, y = int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))
        assert (x ^ y).bit_count() <= 3
        i, j = root(at[r.a]), root(at[r.b])
        parent[max(i, j)] = min(i, j)
    assert {i: root(i) for i in want} == want


def test_forest_has_no_cycles():
    fps = clustered(300)
    a, b = forest(fps, np.ones(len(fps), dtype=bool), 3)
    groups = len(set(plain_components({i: {int(x)} for i, x in enumerate(fps)}).values()))
    assert len(a) == len(fps) - groups


def test_copies_of_one_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("a b c d")).otherwise(
        F.concat(F.lit("w"), F.col("id").cast("string"))).alias("text"))
    check(df.where("doc_id < 200"))
    assert near_duplicates(df).where("component_id = 1").count() == 2000
