import collections

import numpy as np
import pytest

from tally.llm.common import mix64
from tally.llm.lattice_sampling import FALLBACK, SPACE, Vocabulary, decode, sample_block, sample_segmentations
from tally.llm.queries import tokenizer_path
from tests.llm.common import ODD_TEXTS, empty_like, odd_documents

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(tokenizer_path(MODEL))


def all_paths(text, vocabulary):
    """Every segmentation of a short text with its log-probability."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    number = {p: i for i, p in enumerate(vocabulary.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    marked = SPACE + text.replace(" ", SPACE)
    found = []

    def walk(at, ids, weight):
        if at == len(marked):
            found.append((tuple(ids), weight))
        for n in range(1, min(16, len(marked) - at) + 1):
            piece = marked[at:at + n]
            if piece in number:
                rank = -sp.get_score(number[piece])
                walk(at + n, [*ids, number[piece]], weight - np.log((rank if rank < 1e6 else 100) + 3))
            elif n == 1:
                data = piece.encode()
                walk(at + 1, [*ids, *(int(vocabulary.byte_ids[b]) for b in data)], weight - len(data) * np.log(FALLBACK))

    walk(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in found])
    return {ids: w - total for ids, w in found}


@pytest.mark.parametrize("text", ["ab c", "the é\n", "thing", "  a"])
def test_samples_follow_the_lattice(vocabulary, text):
    """Probabilities are exact; order and frequencies are those of sampling without replacement."""
    paths = all_paths(text, vocabulary)
    n, k = 4000, min(3, len(paths))
    drawn = sample_block([text] * n, [int(x) for x in mix64(np.arange(n, dtype=np.uint64))], vocabulary, k)
    counts = [collections.Counter() for _ in range(k)]
    weight = collections.Counter()
    for samples in drawn:
        assert len({tuple(ids) for ids, _, _ in samples}) == k
        for turn, (ids, log_prob, log_inclusion) in enumerate(samples):
            inclusion = float(np.exp(log_inclusion))
            key = tuple(ids.tolist())
            assert abs(paths[key] - log_prob) < 1e-9 and 0 < inclusion <= 1
            assert vocabulary.decode(key) == text
            counts[turn][key] += 1
            weight[key] += 1 / inclusion / n
    p = {s: float(np.exp(w)) for s, w in paths.items()}
    for s in sorted(p, key=lambda s: -p[s])[:3]:
        assert abs(counts[0][s] / n - p[s]) < 0.035
        second = sum(p[f] * p[s] / (1 - p[f]) for f in p if f != s)
        assert abs(counts[1][s] / n - second) < 0.035
        if p[s] > 0.01:  # inclusion scores make the estimate unbiased: each path weighs its probability once
            assert abs(weight[s] - 1) < 0.15


def test_fewer_segmentations_than_asked(vocabulary):
    (one,) = sample_block(["🙂"], [1], vocabulary, 5)
    assert len(one) == 1 and one[0][1] == 0.0 and one[0][2] == 0.0
    (empty,) = sample_block([""], [1], vocabulary, 3)
    assert len(empty) == 1 and len(empty[0][0]) == 0


def test_odd_documents_round_trip(spark):
    df = odd_documents(spark)
    path = tokenizer_path(MODEL)
    drawn = sample_segmentations(df, path, k=2)
    rows = drawn.collect()
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    per = collections.Counter(r.doc_id for r in rows)
    assert per[0] == 2 and per[5] == 4  # an empty text, repeated, has one segmentation; a repeated row's samples repeat
    assert len({tuple(r.ids) for r in rows if r.doc_id == 5}) == 2
    for r in decode(drawn, path).collect():
        if r.doc_id is not None:
            assert r.text == texts[r.doc_id].replace(SPACE, " ")
    assert sample_segmentations(empty_like(df), path).count() == 0
    again = sample_segmentations(df.repartition(7), path, k=2).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))  # seeded by the row, not the partition


def test_decode_agrees_with_the_library(vocabulary):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    for text in [t for t in ODD_TEXTS if t and "\x00" not in t][:8] + ["a ▁b", "ﬁ Ａ"]:
        ids = sp.encode(text)
        assert vocabulary.decode(ids) == sp.decode(ids)
    assert vocabulary.decode([1, *sp.encode("x y"), 2]) == "x y"


def test_decode_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "a long, ids array<int>")
    assert sorted(map(tuple, decode(df, tokenizer_path(MODEL)).collect())) == [(1, None), (2, "")]
