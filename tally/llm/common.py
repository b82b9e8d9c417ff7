"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: later readers neither recompute ``df`` nor depend on any
    one executor.  The folder is the one ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Copies of the smaller side of a salted join.
SALTS = 8


def join_salted(rows: DataFrame, facts: DataFrame, key: str | list[str], salt_by: Column, how: str = "inner") -> DataFrame:
    """Equi-join of many rows of a hot key (one column or several) with the one row of ``facts`` for it.

    The rows of a key spread over SALTS shuffle partitions; and as neither side then keeps the
    partitioning it had, adaptive execution can split a partition that is still too large.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
            .join(facts.withColumn("_salt", copies), [*([key] if isinstance(key, str) else key), "_salt"], how)
            .drop("_salt"))


#: Bits of an id filter, whatever the number of ids: 4 MB.
FILTER_BITS = 1 << 25
_FILTER_HASHES = 4


def id_filter(ids: DataFrame):
    """A test ``f(id column) -> boolean column`` that holds for every id of the one-column frame.

    A Bloom filter of fixed size: of other ids it lets few pass while the ids number some
    millions, and more beyond.  It only saves shuffling rows that a join would drop;
    an exact join must follow.
    """
    places = [F.pmod(F.xxhash64(F.col(ids.columns[0]), F.lit(j)), F.lit(FILTER_BITS)) + 1 for j in range(_FILTER_HASHES)]
    maps = (ids.select(F.explode(F.array(*places)).alias("p"))
            .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    size = 4096  # bytes of Spark's bitmaps
    data = bytearray(FILTER_BITS // 8)
    for bucket, bits in maps:  # at most FILTER_BITS / 8 bytes
        data[(bucket - 1) * size:bucket * size] = bits
    held = bytes(data)

    @F.pandas_udf("boolean")
    def holds(p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        table = np.frombuffer(held, dtype=np.uint8)
        out = np.ones(len(p), dtype=bool)
        for c in (p, q, r, s):
            at = c.to_numpy()
            out &= (table[at >> 3] >> (at & 7)) & 1 == 1
        return pd.Series(out)

    return lambda col: holds(*[F.pmod(F.xxhash64(col, F.lit(j)), F.lit(FILTER_BITS)) for j in range(_FILTER_HASHES)])


# --- words and hashes of many texts at once --------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 * 8 + 5 & 0xFFFFFFFFFFFFFFFF)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _byte_table() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix64(x) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the multiply-xorshift of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


_BYTES = _byte_table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 16)
        inv = pow(int(_BASE), -1, 1 << 64)
        both = []
        for base in (_BASE, np.uint64(inv)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers, _inverse = both
    return _powers, _inverse


#: Bytes of a text that are hashed at once.
SLICE = 4 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes):
    at = 0
    while len(text) - at > SLICE:
        gap = _GAP.search(text, at + SLICE)
        if not gap:
            break
        yield text[at:gap.start()]
        at = gap.end()
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) UTF-8 texts.

    Returns (hashes, offsets): the words of text i are
    ``hashes[offsets[i]:offsets[i + 1]]``.  A word's 64-bit hash is that of its
    bytes alone, so equal words have equal hashes in every text.  Longer texts are
    hashed in slices, cut at white space.
    """
    if any(len(t) > 2 * SLICE for t in texts):
        parts = [np.concatenate([_hash_words([s])[0] for s in _slices(t)]) for t in texts]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    return _hash_words(texts)


def _hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1)
    data = _FOLD[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)] if texts else np.zeros(0, np.uint8)
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    start = np.flatnonzero(before & ~space)
    after = np.concatenate((space[1:], [True])) if len(data) else space
    end = np.flatnonzero(after & ~space) + 1
    powers, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers[:len(data)], out=total[1:])
    hashes = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.concatenate(([0], np.searchsorted(start, ends)))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``size`` words.

    A text of fewer words has one shingle, the whole sequence; a text without
    words has none.
    """
    words, at = word_hashes(texts)
    out = []
    mult = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64)) for k in range(size)]
    if len(words) >= size:
        n = len(words) - size + 1
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            grams += mix64(words[k:k + n] + mult[k])  # the word's place counts
            grams *= mult[k]
        grams = mix64(grams)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= size:
            s = np.unique(grams[a:b - size + 1])
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                h = mix64(h * mult[0] + words[k:k + 1])
            s = h
        else:
            s = np.zeros(0, dtype=np.uint64)
        out.append(s)
    return out


def blocks(rows, size, limit: int = 1 << 20):
    """Group an iterator into lists whose ``size(row)`` sum to about ``limit``."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += size(r)
        if n >= limit:
            yield out
            out, n = [], 0
    if out:
        yield out


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
