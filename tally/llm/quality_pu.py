"""Quality classification by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic scorer that minimises the
non-negative unbiased risk of Kiryo et al. (2017): with class prior p,
    R = p R+(positives) + max(0, R-(unlabelled) - p R-(positives)).
The prior is estimated from the two samples alone.  Negative labels are never used.

Features are ratios of whole texts (characters by class, repetition of words and
lines), the same code for training and for scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most positives and most unlabelled rows that the fit uses (the rows of least hash).
SAMPLE = 10000
#: Ids that a hash threshold leaves, for one that the sample takes.
HASHED = 4
#: The estimated negative risk may fall so far below zero before a step is reversed.
TOLERANCE = 0.03
#: A score from here on predicts label 1.
THRESHOLD = 0.3
_WORD = re.compile(r"\w+", re.UNICODE)
_MARKS = "!?.,;:|$%&#*@<>{}[]()/\\+=~^_-\"'`"

NAMES = (
    "log_chars", "upper", "lower", "digit", "space", "other", "marks", "words", "word_length",
    "distinct_words", "top_word", "same_as_before", "two_before", "distinct_lines", "line_length",
    "mark_tokens", "upper_words", "mark_ended", "sentences", "long_words",
    *(f"mark_{ord(c)}" for c in _MARKS),
)


def features(text: str | None) -> list[float]:
    """Features of a whole text, each bounded; an empty text has all but none at 0."""
    text = text or ""
    n = len(text)
    out = [0.0] * len(NAMES)
    if not n:
        return out
    tokens = text.split()
    counts = Counter(text)
    upper = sum(c for k, c in counts.items() if k.isupper())
    lower = sum(c for k, c in counts.items() if k.islower())
    digit = sum(c for k, c in counts.items() if k.isdigit())
    space = sum(c for k, c in counts.items() if k.isspace())
    marks = [counts[c] for c in _MARKS]
    out[:7] = [min(1.0, np.log1p(n) / 12), upper / n, lower / n, digit / n, space / n,
               max(0, n - upper - lower - digit - space - sum(marks)) / n, sum(marks) / n]
    m = len(tokens)
    if m:
        freq = Counter(tokens)
        lines = [x for x in text.split("\n") if x]
        chars = n - space
        same = sum(map(str.__eq__, tokens, tokens[1:]))
        two = sum(map(str.__eq__, tokens, tokens[2:]))
        bare = sum(c for t, c in freq.items() if not t[0].isalnum() and not t[-1].isalnum() and not _WORD.search(t))
        loud = sum(c for t, c in freq.items() if len(t) > 1 and t.isupper())
        ended = sum(c for t, c in freq.items() if not t[-1].isalnum() and t[-1] not in ".,")
        ends = sum(c for t, c in freq.items() if t[-1] in ".!?")
        out[7:20] = [min(1.0, np.log1p(m) / 10), min(1.0, chars / m / 20), len(freq) / m,
                     max(freq.values()) / m, same / m, two / m, len(set(lines)) / max(1, len(lines)),
                     min(1.0, n / max(1, len(lines)) / 2000), bare / m, loud / m, ended / m, ends / m,
                     sum(c for t, c in freq.items() if len(t) > 24) / m]
    for k, c in enumerate(marks):
        out[20 + k] = c / n
    return out


def _expanded(x: np.ndarray) -> np.ndarray:
    """The features and their square roots, which spread small ratios."""
    return np.hstack((x, np.sqrt(np.abs(x))))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_expanded(x) - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores that rise with the positive class.

    In any set of scores the unlabelled hold at least the prior's share of the
    positives'; the smallest ratio over all upper tails, less a confidence margin, is
    therefore an upper bound that the purest tail attains (Blanchard et al., 2010).
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    p = np.searchsorted(np.sort(positive), cuts, "left")
    u = np.searchsorted(np.sort(unlabelled), cuts, "left")
    tail_p, tail_u = 1 - p / len(positive), 1 - u / len(unlabelled)
    slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    ratio = (tail_u + slack * 0.25) / np.maximum(tail_p - slack * 0.25, 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _fit(x_p: np.ndarray, x_u: np.ndarray, prior: float | None, steps: int, rate: float, decay: float) -> tuple:
    """Full-batch Adam; ``prior`` None fits positives against unlabelled as if negative."""
    d = x_p.shape[1]
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        s_p, s_u = _sigmoid(x_p @ w + b), _sigmoid(x_u @ w + b)
        # gradients in the margin of the logistic losses log(1 + e^-z) and log(1 + e^z)
        if prior is None:
            g_p, g_u = (s_p - 1) / len(s_p), s_u / len(s_u)
        else:
            z_p, z_u = x_p @ w + b, x_u @ w + b
            negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            g_p = prior * (s_p - 1) / len(s_p)
            if negative >= -TOLERANCE:
                g_p = g_p - prior * s_p / len(s_p)
                g_u = s_u / len(s_u)
            else:  # the negative part has been fitted below its least: step back along it
                g_p = prior * s_p / len(s_p)
                g_u = -s_u / len(s_u)
        grad = np.concatenate((x_p.T @ g_p + x_u.T @ g_u + decay * w, [g_p.sum() + g_u.sum()]))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05,
        decay: float = 1e-3) -> Model:
    """The scorer of least non-negative risk.  Without positives every score is the prior's, one half."""
    d = 2 * len(NAMES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.5)
    x_p, x_u = _expanded(positive), _expanded(unlabelled)
    mean, scale = x_p.mean(0), np.maximum(x_p.std(0), 1e-3)
    x_p, x_u = (np.clip((x - mean) / scale, -8, 8) for x in (x_p, x_u))
    w, b = _fit(x_p, x_u, None, steps, rate, decay)
    prior = estimate_prior(x_p @ w + b, x_u @ w + b)
    w, b = _fit(x_p, x_u, prior, steps, rate, decay)
    return Model(mean, scale, w, float(b), prior)


def in_training_fold(id_: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 5, is not 0; a null id is in no fold."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the training fold: at most ``sample`` trusted positives (label 1) and as many unlabelled rows.

    Both samples are the rows of least hash of the id, so that they do not depend on
    the partitioning; the rows' features, a few hundred bytes each, go to the driver.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    trusted = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y"))
               .where(in_training_fold(F.col("id")) & (F.col("y") == 1)).select("id").distinct())
    others = rows.select("id").where(in_training_fold(F.col("id"))).distinct()
    # at most 2 * sample ids: a bounded broadcast
    chosen = _least(trusted, 17, sample).withColumn("trusted", F.lit(True))
    others = _least(others, 29, sample).withColumn("trusted", F.lit(False))
    picked = rows.join(F.broadcast(chosen.unionByName(others)), "id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, flags = b.column(0), b.column(1)
            values = [np.array(features(t.as_py()), dtype=np.float32).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([ids, flags, pa.array(values, type=pa.binary())],
                                             names=["id", "trusted", "x"])

    found = (picked.select(F.col("id").cast("string").alias("id"), "trusted", "text")
             .mapInArrow(measured, "id string, trusted boolean, x binary")
             .groupBy("id", "trusted").agg(F.min("x").alias("x"))  # repeated rows of an id: one of them
             .orderBy("trusted", "id").collect())
    wide = lambda flag: np.frombuffer(b"".join(r.x for r in found if r.trusted is flag),
                                      dtype=np.float32).reshape(-1, len(NAMES)).astype(np.float64)
    return fit(wide(True), wide(False))


def _least(ids: DataFrame, seed: int, sample: int) -> DataFrame:
    """The ``sample`` ids of least hash.

    A threshold on the hash first leaves about HASHED times as many, so that what the final
    sort gathers does not grow with the input; should it leave too few, all are sorted.
    """
    n = ids.count()
    key = F.xxhash64(F.col("id"), F.lit(seed))
    if n > 2 * HASHED * sample:
        some = ids.where(key < -(1 << 63) + int(HASHED * sample / n * 2 ** 64))
        if some.count() >= sample:
            ids = some
    return ids.orderBy(key, "id").limit(sample)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD,
                    keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (and the ``keep`` columns).

    Labels are learnt only from rows whose crc32(id as text) mod 5 is not 0; no label,
    language, source or id enters a score.  A null text counts as empty and is scored;
    equal texts have equal scores; a row with a null id is held out; a null label is
    none; with no positive in the training fold every score is 0.5; an empty table gives
    an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, sample)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(0)]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.score(x))],
                                             names=[*b.schema.names[1:], "score"])

    cols = {f"c{k}": F.col(f"`{c}`") for k, c in enumerate([id_col, *keep])}
    frame = docs.select(F.col(f"`{text_col}`").alias("text"), *[c.alias(n) for n, c in cols.items()])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[1:])
    out = frame.mapInArrow(scored, f"{kinds}, score double")
    return out.select(
        F.col("c0").alias(id_col), F.coalesce(~in_training_fold(F.col("c0")), F.lit(True)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
        *[F.col(f"c{k + 1}").alias(c) for k, c in enumerate(keep)])
