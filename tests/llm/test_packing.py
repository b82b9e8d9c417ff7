import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from tally.llm import packing
from tally.llm.packing import Encoder, choose_cuts, pack
from tally.llm.queries import tokenizer_path
from tests.llm.common import DATA, ODD_TEXTS, empty_like, odd_documents


def check(rows, docs, window=2048):
    """Every id lies in one piece; sequences are gapless and at most the window; returns the padding."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = collections.Counter()
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected[(r.doc_id, np.array(ids, dtype="<u4").tobytes())] += 1
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id in {k for k, _ in expected}:
        own = sorted((data, n) for (k, data), n in expected.items() if k == doc_id)
        want = collections.Counter()
        for data, n in own:
            cuts = {(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc_id] if p.doc_tokens == len(data) // 4}
            at = 0
            assert cuts
        if len(own) == 1 and own[0][1] == 1:
            data, at = own[0][0], 0
            for p in sorted(pieces[doc_id], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(data) // 4
                assert p.ids_crc32 == zlib.crc32(data[4 * at:4 * (at + p.length)])
                at += p.length
            assert at == len(data) // 4
        else:
            assert sum(p.length for p in pieces[doc_id]) == sum(len(d) // 4 * n for d, n in own)
    lengths = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        lengths.append(at)
    return 1 - sum(lengths) / (window * max(1, len(lengths)))


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    padding = check(pack(docs, tokenizer_path(), partitions=4).collect(), docs.collect())
    assert padding < 0.02


def test_small_blocks_and_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 700)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    rows = pack(docs, tokenizer_path(), partitions=3, window=64).collect()
    assert check(rows, docs.collect(), 64) < 0.2


def test_odd_documents(spark):
    df = odd_documents(spark)
    rows = pack(df, tokenizer_path(), partitions=3).collect()
    check(rows, df.select("doc_id", "text").collect())
    assert sum(r.length for r in rows if r.doc_id is None) == len(Encoder(tokenizer_path()).ids("one")) + 2
    assert pack(empty_like(df), tokenizer_path()).count() == 0


def test_order_is_preserved(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(200)
    rows = sorted(pack(docs, tokenizer_path(), partitions=3).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [(r.doc_id, r.start) for r in rows] == sorted((r.doc_id, r.start) for r in rows)


def test_ids_equal_the_library():
    from tokenizers import Tokenizer
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    for text in [t or "" for t in ODD_TEXTS] + ["it's  we'll 12 34٣ \t\t x", "a\r\n\r\n b", "ſK", "日本語 テキスト"]:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_optimal(seed):
    rnd = random.Random(seed)
    window = rnd.randint(4, 12)
    places = [0]
    while len(places) < 9:
        places.append(places[-1] + rnd.randint(1, window))
    penalties = [rnd.choice([0, 1, 5]) for _ in places]
    best = None
    for n in range(len(places)):
        for inner in itertools.combinations(range(1, len(places) - 1), n):
            chosen = [0, *inner, len(places) - 1]
            steps = [places[b] - places[a] for a, b in zip(chosen, chosen[1:])]
            if max(steps) <= window:
                cost = sum(window - s for s in steps) + sum(penalties[c] for c in chosen[1:])
                best = cost if best is None else min(best, cost)
    cuts = choose_cuts(places, penalties, window)
    steps = [b - a for a, b in zip([0, *cuts], cuts)]
    assert max(steps) <= window and cuts[-1] == places[-1]
    assert sum(window - s for s in steps) + sum(penalties[places.index(c)] for c in cuts) == best


def test_the_ids_are_given(spark, monkeypatch):
    """The ids by sequence and offset are the tokens of all documents, each closed by the separator."""
    monkeypatch.setattr(packing, "BLOCK", 700)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).unionByName(
        odd_documents(spark).selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = pack(docs, tokenizer_path(), partitions=3, window=64).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    stream = [i for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) for i in r.ids]
    encoder = Encoder(tokenizer_path())
    every = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    assert stream == [i for r in every for i in [*encoder.ids(r.text or "").tolist(), 1]]
