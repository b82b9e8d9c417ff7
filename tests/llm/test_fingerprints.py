import hashlib
import random

import numpy as np
import pytest

from tally.llm.common import mix64
from tally.llm.fingerprints import _BASE, _CHARS, _TABLE, _similarity, edited, fingerprint_documents, fingerprints, likeness
from tests.llm.common import DATA, ODD_TEXTS, empty_like, odd_documents


def check(df, **kw):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))
    want = []
    for (known, doc_id, text), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        changed = edited(text, after)
        own, mark, following = (fingerprints([t])[0] for t in (text, changed, after))
        want.append((doc_id if known else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, mark,
                     likeness(own, mark), likeness(own, following)))
    got = [tuple(r) for r in fingerprint_documents(df, **kw).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 5, 64])
def test_against_one_by_one(spark, n):
    check(spark.read.parquet(f"{DATA}/documents.parquet").limit(150), partitions=n)


def test_odd_documents(spark):
    df = odd_documents(spark)
    check(df)
    check(df.limit(1))
    assert fingerprint_documents(empty_like(df)).count() == 0


def test_edited_text():
    assert edited("abcde", "XYZ") == "abcXY" and edited("abcdef", "X") == "abcX" and edited("", "x") == "" and edited("a", "b") == "a"


def test_likeness_of_edits():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    base = " ".join(word() for _ in range(800))
    other = " ".join(word() for _ in range(800))
    words = base.split()
    words[100] = "changed"
    words.insert(400, "inserted")
    near = " ".join(words)
    a, b, c, half = fingerprints([base, near, other, edited(base, other)])
    assert likeness(a, a) == 1.0 and likeness(a, b) > 0.85 and likeness(a, c) == 0.0
    assert 0.3 < likeness(a, half) < 0.85 and likeness(a, b) == likeness(b, a)


def test_blocks_do_not_matter():
    texts = [t or "" for t in ODD_TEXTS]
    assert fingerprints(texts) == [fingerprints([t])[0] for t in texts]
    assert fingerprints([""]) == ["1::"] and likeness("1::", "1::") == 1.0
    for f in fingerprints(texts):
        for g in fingerprints(texts):
            assert 0.0 <= likeness(f, g) <= 1.0


def test_similarity_is_an_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last if x == y else 1 + min(row[j + 1], row[j])
        return row[-1]

    rnd = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(8, 20))) for _ in range(2))
        s = _similarity(a, b)
        assert s == 0.0 or abs(s - (1 - distance(a, b) / (len(a) + len(b)))) < 1e-12


def plain_fingerprint(text):
    """Byte by byte, in plain integers; only the byte table and the mixing function are the operator's."""
    data, low = text.encode("utf-8", "surrogatepass"), (1 << 32) - 1
    rolled = []
    for i in range(len(data)):
        h = 0
        for k in range(min(7, i + 1)):
            h += int(_TABLE[data[i - k]]) * pow(int(_BASE), k, 1 << 32)
        h &= low
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * factor & low
        rolled.append(h ^ h >> 16)
    block = 1
    while 64 * block < len(data):
        block *= 2

    def signature(size):
        out, at = "", 0
        while at < len(data):
            least, most = max(1, size // 4), max(1, size * 3 // 2)
            inside = range(at + least - 1, min(at + most, len(data)))
            marked = [j for j in inside if rolled[j] % size == size - 1]
            if marked:
                end = marked[0] + 1
            elif at + most >= len(data):
                end = len(data)
            else:
                end = max(inside, key=lambda j: (rolled[j], j)) + 1
            total = np.array([sum(rolled[at:end])], dtype=np.uint64)
            out += chr(_CHARS[int(mix64(total)[0]) >> 58])
            at = end
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(a, b):
    """Edit distance by its table; nothing without a shared run of characters."""
    if a == b:
        return 1.0
    (n, *x), (m, *y) = (f.split(":") for f in (a, b))
    pairs = {1: [(x[0], y[0]), (x[1], y[1])], 2: [(x[0], y[1])], 0.5: [(x[1], y[0])]}.get(int(n) / int(m), [])
    best = 0.0
    for s, t in pairs:
        need = max(2, min(7, min(len(s), len(t)) // 4))
        if not s or not t or (s != t if min(len(s), len(t)) < need else not any(s[i:i + need] in t for i in range(len(s) - need + 1))):
            continue
        row = list(range(len(t) + 1))
        for i, c in enumerate(s):
            last, row[0] = row[0], i + 1
            for j, e in enumerate(t):
                last, row[j + 1] = row[j + 1], last if c == e else 1 + min(row[j + 1], row[j])
        best = max(best, 1 - row[-1] / (len(s) + len(t)))
    return best


def repetitive(rnd, lines=300):
    line = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(10)) + "\n"
    return line * lines


def prose(rnd, words=2500):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(words))


def test_against_plain_version():
    rnd = random.Random(9)
    texts = [t or "" for t in ODD_TEXTS if len(t or "") < 50000] + [prose(rnd, k) for k in (3, 20, 90, 400, 900)] + [
        repetitive(rnd, k) for k in (2, 9, 70)] + ["ab" * 700, "x" * 1000, "0123456789" * 99]
    texts += [edited(a, b) for a, b in zip(texts, texts[1:])]
    got, want = fingerprints(texts), [plain_fingerprint(t) for t in texts]
    assert got == want
    for f in got[::2]:
        for g in got[1::3]:
            assert abs(likeness(f, g) - plain_likeness(f, g)) < 1e-12


def test_repetitive_texts_are_covered_whole():
    """Half of a text of one repeated line replaced: the other half shows, wherever the replaced one lies."""
    rnd = random.Random(3)
    for _ in range(24):
        text, other = repetitive(rnd), prose(rnd, 4000)
        half = len(text) // 2
        whole, end, start, away = fingerprints([text, edited(text, other), other[:half] + text[half:], other])
        assert 0.3 < likeness(whole, end) < 0.8 and 0.3 < likeness(whole, start) < 0.8 and likeness(whole, away) < 0.2
        assert likeness(whole, fingerprints(["one more line\n" + text])[0]) > 0.7


def test_no_piece_holds_a_large_part():
    rnd = random.Random(4)
    for text in (repetitive(rnd, 1000), prose(rnd, 9000), "ab" * 30000, "y" * 60000, repetitive(rnd, 20) + prose(rnd, 5000)):
        block, fine, coarse = fingerprints([text])[0].split(":")
        assert 64 * int(block) >= len(text) > 32 * int(block) and 21 <= len(fine) <= 257 and len(coarse) <= 130


def test_an_id_of_many_texts_spreads(spark):
    rows = [(7, f"text {i} " + "w" * (i % 50)) for i in range(300)] + [(1, "a"), (9, "b")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), partitions=16)
