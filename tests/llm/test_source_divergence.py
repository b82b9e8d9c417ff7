import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tally.llm import source_divergence
from tally.llm.source_divergence import audit, price_block
from tests.llm.common import LOWER, empty_like, odd_documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    """Every result row, term by term."""
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(words)
        in_docs[lang or ""].update(set(words))
    out = set()
    for lang in {k for k, _ in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (k, s), c in groups.items() if k == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def prices(count):
            n = sum(count.values())
            return {t: 1 + 1000000000 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in own.items()}, prices(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in own if h != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = audit(df, **kw).collect()
    want = brute(rows, **{k.split("_")[0]: v for k, v in kw.items()})
    assert len(got) == len(want) and set(map(tuple, got)) == want


def texts(n, seed, words=40, langs=("en", "de"), sources=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)] + ["É", "straße", "日本"]
    return [(" ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rnd.randint(0, 60))),
             rnd.choice(langs), f"s{int(rnd.random() ** 2 * sources)}") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_term_by_term(spark, seed):
    check(spark, texts(120, seed))


def test_blocks_and_shards(spark, monkeypatch):
    """Many blocks of groups and shards of terms, products in small steps, counts given out early."""
    for name, value in (("TERMS", 7), ("GROUPS", 3), ("_PRODUCTS", 5), ("_HELD", 10), ("_SLICE", 30)):
        monkeypatch.setattr(source_divergence, name, value)
    check(spark, texts(200, 3, sources=12))


def test_top_terms_and_ties(spark):
    rows = [("b a d c", "en", "x"), ("a b c d", "en", "x"), ("c d a b", "en", "x"), ("e e e", "en", "y"), ("e", "en", "y"), ("e", "en", "y")]
    check(spark, rows, top_terms=2)
    check(spark, rows, least_docs=1)


def test_odd_tables(spark):
    rows = [(None, None, None), ("", "en", "s"), ("one", "en", "s"), ("one", "en", None), ("x", "de", "a"), ("y", "de", "b"),
            ("!!! 123", "fr", "only"), ("a_b\x00c\x7fd", "es", "u"), ("A b c", "es", "v"), ("a", "es", "w"),
            ("b c " * 9000, "es", "long"), ("b c", "es", "é"), ("b c", "es", "z"), ("b c", "es", "z")]
    check(spark, rows)
    df = odd_documents(spark)
    got = audit(df).collect()
    want = brute([(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()])
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert audit(empty_like(df)).count() == 0


def test_products_equal_dense_ones():
    """The joint tables of a block are the cells of the indicator matrix's transpose times itself."""
    rnd = np.random.default_rng(4)
    level = rnd.integers(0, 4, (30, 5))
    term, group = np.nonzero(level)
    columns = {(g, a): k for k, (g, a) in enumerate(itertools.product(range(5), range(1, 4)))}
    col = np.array([columns[g, a] for g, a in zip(group.tolist(), level[term, group].tolist())])
    x = np.zeros((30, len(columns)), dtype=np.int64)
    x[term, col] = 1
    got = np.zeros((len(columns), len(columns)), dtype=np.int64)
    for a, b, n in source_divergence.joint_cells((term, col), (term, col), len(columns)):
        np.add.at(got, (a, b), n)
    assert (got == x.T @ x).all()
    price, zero = np.array([5, 17, 40, 90]), np.full(5, 5)
    value = price_block(group, term, level[term, group], price[level[term, group]], np.zeros(5, dtype=np.int64), zero, 30)
    full = price[level]
    want = [[0 if g == h else int(source_divergence.divergence(full[:, g], full[:, h]).sum()) for h in range(5)] for g in range(5)]
    assert value.tolist() == want
