"""Order-preserving packing of tokenised documents into sequences.

The documents, in id order, form one stream of tokens.  Dynamic programming chooses
the window cuts among document ends, sentence ends and, in long sentences, a grid of
inner places, minimising padding plus a penalty per cut that splits a document.
With f(j) the least cost of a cut at place p(j),
    f(j) = penalty(j) + window - p(j) + min over p(j) - p(i) <= window of f(i) + p(i),
and the minimum over the sliding window comes from a monotone queue.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import session_partitions

WINDOW = 2048
#: Penalties, in tokens of padding, of a cut at a sentence end and inside a sentence.
SENTENCE_CUT, INNER_CUT = 4, 24
#: Places inside a sentence are this many tokens apart.
GRID = 16
#: Tokens that one run of the dynamic programme spans, at least; bounds the memory.
BLOCK = 1 << 21
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids array<int>")

_BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary (a ``tokenizers`` file).

    Ordinary texts go through the same vocabulary as ranks, which is several times
    faster and gives the same ids; texts that hold a special token's string or a very
    long run without a break go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec = json.loads(self.exact.to_str())
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        self.pieces = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=_BYTE_PATTERN, special_tokens={},
                                       mergeable_ranks={b: i for i, b in self.pieces.items()})
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        self.size = max(self.pieces) + 1 + len(special)
        ends = np.zeros(self.size, dtype=bool)
        for i, b in self.pieces.items():
            ends[i] = b.rstrip(b"\"')").endswith((b".", b"!", b"?", b"\n"))
        self.sentence_end = ends

    def ids(self, text: str) -> np.ndarray:
        if _LONG_RUN.search(text) or (self.special and self.special.search(text)):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.ranks.encode_ordinary(text), dtype=np.uint32)


def choose_cuts(places: list[int], penalties: list[int], window: int) -> list[int]:
    """Places of the cheapest cuts; ``places`` ascend from 0, at most ``window`` apart.

    The first place is given, the last is the last cut.
    """
    n = len(places)
    back = [0] * n
    value = [0] * n  # f(i) + p(i)
    queue = deque([0])
    for j in range(1, n):
        p = places[j]
        while p - places[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        v = value[j] = value[i] + window + penalties[j]
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


def _cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[list[int], list[int]]:
    """Candidate places (after which tokens a window may end) and their penalties."""
    n = len(ids)
    sentence = np.flatnonzero(sentence_end[ids]) + 1
    marks = np.unique(np.concatenate((sentence, doc_ends, [0])))
    gaps = np.diff(np.concatenate((marks, [n])))
    inner = [np.arange(a + GRID, a + g, GRID) for a, g in zip(marks[gaps > GRID], gaps[gaps > GRID])]
    places = np.unique(np.concatenate((marks, *inner))) if inner else marks
    cost = np.full(n + 1, INNER_CUT, dtype=np.int64)
    cost[sentence] = SENTENCE_CUT
    cost[doc_ends] = 0
    return places.tolist(), cost[places].tolist()


class Packer:
    """Packs a stream of documents; rows of ``SCHEMA`` come out in blocks."""

    def __init__(self, encoder: Encoder, separator: int, window: int, first_sequence: int):
        self.encoder, self.separator, self.window, self.sequence = encoder, separator, window, first_sequence
        self.parts: list[tuple] = []  # (doc_id, start, ids, doc_tokens) not yet packed
        self.held = 0

    def add(self, doc_id, text: str | None) -> list[tuple]:
        ids = np.append(self.encoder.ids(text or ""), np.uint32(self.separator)).astype(np.uint32)
        self.parts.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)
        return self.flush(False) if self.held >= BLOCK else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.parts:
            return []
        ids = np.concatenate([p[2] for p in self.parts])
        ends = np.cumsum([len(p[2]) for p in self.parts])
        cuts = choose_cuts(*_cut_places(ids, ends, self.encoder.sentence_end), self.window)
        if not last and len(cuts) > 1:
            cuts.pop()  # the rest begins the next block
        rows, windows = [], np.array([0, *cuts])
        bounds = np.unique(np.concatenate((windows, ends[ends < windows[-1]])))
        of_window = np.searchsorted(windows, bounds[:-1], "right") - 1
        of_part = np.searchsorted(ends, bounds[:-1], "right")
        for a, b, w, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), of_window.tolist(), of_part.tolist()):
            doc_id, start, own, total = self.parts[k]
            at = a - int(ends[k] - len(own))
            piece = own[at:at + b - a]
            rows.append((doc_id, start + at, b - a, zlib.crc32(piece.astype("<u4").tobytes()), total,
                         self.sequence + w, a - int(windows[w]), piece))
        self.sequence += len(cuts)
        done = int(windows[-1])
        k = int(np.searchsorted(ends, done, "right"))
        rest = self.parts[k:]
        if rest:
            doc_id, start, own, total = rest[0]
            at = done - int(ends[k] - len(own))
            rest[0] = (doc_id, start + at, own[at:], total)
        self.parts, self.held = rest, len(ids) - done
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    *cols, pieces = zip(*rows)
    ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*[pa.array(c, type=f.type) for c, f in zip(cols, schema)], ids.cast(schema.field("ids").type)],
                                      schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, separator: int = 1, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Pieces of all documents (``SCHEMA``) with their token ids: each token lies in exactly one piece.

    A sequence is its pieces' ``ids`` by ``offset``; ``ids_crc32`` is the checksum of the
    ids as little-endian 32-bit numbers.

    The stream is split by ranges of the id into ``partitions`` runs (the session's
    shuffle partitions by default), packed each for itself: the only windows whose
    padding the cuts can't choose are the last of each run.  Within a run, order is by
    id, then text.  A run is held in blocks of ``BLOCK`` tokens, never whole.

    A null or empty text is one separator; a null id comes first and stays null;
    repeated rows are packed each; an empty table gives an empty result; columns other
    than the two named are ignored.  ``tokenizer_path`` must be readable by executors.
    """
    n = partitions or session_partitions(docs.sparkSession)
    ordered = (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
               .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text"))
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(Encoder(tokenizer_path), separator, window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = packer.add(doc_id, text.as_py())
                if rows:  # the ids of one block at a time
                    yield _batch(rows, out)
        rows = packer.flush(True)
        if rows:
            yield _batch(rows, out)

    return ordered.mapInArrow(run, SCHEMA)
