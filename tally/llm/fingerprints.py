"""Context-triggered piecewise hashing of documents.

A hash rolling over seven bytes marks the ends of pieces wherever its low bits are
all ones, so that an edit moves only the boundaries near it.  A piece has at least a quarter of
the block and at most one and a half of it: where no mark falls into that range it ends at the
range's largest hash, which keeps its place in repeated passages too.  So the pieces
cover the whole text, 40 to 260 of them, whatever it repeats.  Each piece gives one
character of the signature.  A fingerprint is ``block:signature:coarse``, the
signatures at the block, which follows the length, and at twice the block; two are compared,
by edit distance, where their block sizes agree.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import blocks, mix64, session_partitions, written

LENGTH = 64          # blocks that hold a text, at most
ROLL = 7             # bytes of the rolling hash
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_TABLE = np.concatenate(((mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32),
                         np.zeros(1, dtype=np.uint32)))  # index 256: nothing
_BASE = np.uint32(0x2C1B3C6D)


def _rolled(data: np.ndarray) -> np.ndarray:
    """Mixed rolling hash of the ROLL bytes that end at each place."""
    t = _TABLE[data]
    r = t.copy()
    scaled = t
    for k in range(1, ROLL):
        scaled = scaled * _BASE
        r[k:] += scaled[:len(t) - k]
    r ^= r >> np.uint32(16)
    r *= np.uint32(0x85EBCA6B)
    r ^= r >> np.uint32(13)
    r *= np.uint32(0xC2B2AE35)
    r ^= r >> np.uint32(16)
    return r


def _starts(rolled: np.ndarray, bits: int) -> list[int]:
    """Where the pieces of a non-empty text begin."""
    block = 1 << bits
    least, most = max(1, block // 4), max(1, block + block // 2)
    mask = np.uint32(block - 1)
    marks = np.flatnonzero((rolled & mask) == mask).tolist()
    n, out, at, i = len(rolled), [0], 0, 0
    while True:
        low, high = at + least - 1, min(at + most, n) - 1  # the piece's last byte
        i = bisect_left(marks, low, i)
        if i < len(marks) and marks[i] <= high:
            at = marks[i] + 1
        elif high == n - 1:
            return out
        else:  # the last of the largest
            at = high + 1 - int(rolled[low:high + 1][::-1].argmax())
        if at >= n:
            return out
        out.append(at)


def _signature(rolled: np.ndarray, bits: int) -> str:
    sums = np.add.reduceat(rolled, _starts(rolled, bits), dtype=np.uint64)
    return _CHARS[(mix64(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def _fingerprint(rolled: np.ndarray) -> str:
    """The block size follows the length, so that it survives edits."""
    bits = 0
    while (LENGTH << bits) < len(rolled):
        bits += 1
    return f"{1 << bits}:" + ":".join(_signature(rolled, k) if len(rolled) else "" for k in (bits, bits + 1))


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts; equal texts have equal ones, an empty one ``1::``."""
    out = []
    pad = np.full(ROLL - 1, 256, dtype=np.uint16)
    for group in blocks((t.encode("utf-8", "surrogatepass") for t in texts), len, 1 << 20):
        parts = []
        for b in group:
            parts += [np.frombuffer(b, dtype=np.uint8), pad]
        rolled = _rolled(np.concatenate(parts))
        at = 0
        for b in group:
            out.append(_fingerprint(rolled[at:at + len(b)]))
            at += len(b) + ROLL - 1
    return out


def _common_run(a: str, b: str) -> bool:
    """Whether the signatures share a run of characters long enough not to be chance."""
    need = max(2, min(7, min(len(a), len(b)) // 4))
    if len(a) < need or len(b) < need:
        return a == b
    return not {a[i:i + need] for i in range(len(a) - need + 1)}.isdisjoint(
        b[i:i + need] for i in range(len(b) - need + 1))


def _similarity(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) as a part of both lengths."""
    if not a or not b or not _common_run(a, b):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:  # longest common subsequence, a bit a character of a
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 2.0 * common / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 where no block size agrees."""
    if a == b:
        return 1.0
    n, a1, a2 = a.split(":")
    m, b1, b2 = b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_similarity(a1, b1), _similarity(a2, b2))
    if n == 2 * m:
        return _similarity(a1, b2)
    if m == 2 * n:
        return _similarity(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
_STEP = f"run int, place string, {_OUT}, text string"


def _rows(pairs: list[tuple]) -> list[tuple]:
    """Result rows of (doc_id, text, next text, next fingerprint or None)."""
    changed = [edited(t, n) for _, t, n in pairs]
    own = fingerprints([t for _, t, _ in pairs])
    theirs = fingerprints([n for _, _, n in pairs[-1:]])
    marks = fingerprints(changed)
    out = []
    for k, ((doc_id, t, _), c, f, e) in enumerate(zip(pairs, changed, own, marks)):
        following = own[k + 1] if k + 1 < len(pairs) and pairs[k + 1][1] == pairs[k][2] else (
            theirs[0] if k + 1 == len(pairs) else fingerprints([pairs[k][2]])[0])
        out.append((doc_id, len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), f, e,
                    likeness(f, e), likeness(f, following)))
    return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          partitions: int | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likenesses.

    The next document is that of the next id (equal ids: by text), after the last one
    the first.  The texts are dealt out once by ranges of the id and the text's beginning, so that an id
    of many texts spreads too; each task streams over its sorted run, and only the last document of a run, whose successor begins another
    run, is finished afterwards: one row a run.

    A null text is empty; null ids come first and stay null; repeated rows are answered
    each; a single document is its own successor; an empty table gives an empty result;
    columns other than the two named are ignored.
    """
    n = partitions or session_partitions(docs.sparkSession)
    ordered = (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                           F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
               .repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text"))
    step, result = _schema(_STEP), _schema(_OUT)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            whole = zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)))
            for group in blocks(whole, lambda r: len(r[1])):
                if first is None:
                    first = group[0][1]
                chain = ([last] if last else []) + group
                pairs = [(a[0], a[1], b[1]) for a, b in zip(chain, chain[1:])]
                last = chain[-1]
                if pairs:
                    yield _emit([(run, "inner", *r, None) for r in _rows(pairs)], step)
        if last:
            none = (None,) * 6
            yield _emit([(run, "first", None, *none, first), (run, "last", last[0], *none, last[1])], step)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for triple in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield _emit(_rows([triple]), result)

    done = written(ordered.mapInArrow(stream, _STEP))
    firsts = done.where("place = 'first'").select("run", F.col("text").alias("following"))
    by_run = Window.orderBy("run")  # one row a run, at most as many as partitions
    order = firsts.select("run", F.coalesce(F.lead("run").over(by_run), F.first("run").over(by_run)).alias("next_run"))
    ends = (done.where("place = 'last'").select("run", "doc_id", "text").join(order, "run")
            .join(firsts.withColumnRenamed("run", "next_run"), "next_run")
            .select("doc_id", "text", "following").mapInArrow(finish, _OUT))
    return done.where("place = 'inner'").select(*result.names).unionByName(ends)
