"""Near-duplicate groups by SimHash, compared at the anchors of a covering code.

The anchors are the words of a covering code: the Hamming code of 31 bits with one free bit, whose
covering radius is 1, over each half of the 64-bit fingerprints.  Two fingerprints within the
distance d differ in at most d // 2 bits of one half; that is the threshold t of a half.  The
anchor nearest to one fingerprint lies within 1 of it (its home), and so within 1 + t of
the other: each fingerprint is replicated to every anchor within radius plus threshold, 17 a half for
d = 3, and at an anchor those at home there are compared with all that are present.  No pair
within the distance is missed, and at each of the 2^28 anchors few others are met.

1. Texts with equal fingerprints collapse into one.
2. The replicas are dealt out by ranges of (anchor, fingerprint), so that an anchor of any size may
   spread over several tasks; each streams over its run and compares the anchors that it holds whole.
3. Anchors cut by a run's end, or of more than CHUNK rows, come back in blocks, and each pair of
   blocks of an anchor is compared in a task of its own.
4. Links, of large anchors a spanning forest of them, contract to components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import LOWER, UPPER, _slices, blocks, join_salted, session_partitions, written
from tally.llm.components import components

SEED = 42            # of the shingles' XXH64
RADIUS = 1           # covering radius of the code
HALF = 32            # bits of a half: 31 of the Hamming code, one free
CHUNK = 8192         # rows of one block of a large anchor
SMALL = 32           # an anchor of up to so many rows gives all its links, a larger one a forest
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_CHECKS = [sum(1 << i for i in range(31) if (i + 1) >> j & 1) for j in range(5)]


# --- fingerprints -----------------------------------------------------------------------

def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by spaces; none for fewer words."""
    k = len(words) - size + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:k].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())), dtype=np.uint64, count=k)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the lowest bit first."""
    if not len(hashes):
        return np.zeros(64, dtype=np.int64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int) -> int:
    """The SimHash of a UTF-8 text: a bit is 1 if over half of the shingles' hashes have it.

    Repeated shingles count each time; a text of fewer words has one shingle, all its words; one
    without words has the fingerprint 0.  Long texts are taken in slices, cut at white space.
    """
    n, ones, words = 0, np.zeros(64, dtype=np.int64), []
    for part in _slices(text):
        words = words + part.translate(_FOLD).split()
        for at in range(0, max(0, len(words) - size + 1), 1 << 17):
            found = shingle_hashes(words[at:at + (1 << 17) + size - 1], size)
            n += len(found)
            ones += _ones(found)
        if len(words) >= size:
            words = words[len(words) - size + 1:]
    if not n and words:
        n, ones = 1, _ones(shingle_hashes(words, len(words)))
    return int(sum(1 << j for j in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp) per row of (doc_id, text); fp is the fingerprint's 64 bits as a long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ((b.column(1)[i].as_py() or b"") for i in range(b.num_rows))
            fps = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the covering code ------------------------------------------------------------------

def syndromes(halves: np.ndarray) -> np.ndarray:
    """Which of the 31 coded bits to flip (1 to 31) to reach the nearest code word; 0 for none."""
    out = np.zeros(halves.shape, dtype=np.uint32)
    for j, mask in enumerate(_CHECKS):
        out |= (np.bitwise_count(halves & np.uint32(mask)) & 1).astype(np.uint32) << np.uint32(j)
    return out


def home(halves: np.ndarray) -> np.ndarray:
    """The nearest code word of each half: at most one bit off."""
    s = syndromes(halves)
    return halves ^ np.where(s > 0, np.uint32(1) << (s - (s > 0)), np.uint32(0)).astype(np.uint32)


def _flips(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All patterns of up to ``reach`` bits, sorted by syndrome, with each syndrome's start and count."""
    every = [sum(1 << i for i in bits) for w in range(reach + 1) for bits in itertools.combinations(range(HALF), w)]
    flips = np.array(every, dtype=np.uint32)
    of = syndromes(flips)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=32)
    return flips[order], np.concatenate(([0], np.cumsum(counts)))[:-1], counts


def anchor_keys(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every anchor within ``reach`` of a half; a key is the half's number and the code word."""
    flips, starts, counts = _flips(reach)
    rows, keys = [], []
    for part in range(64 // HALF):
        halves = (fps >> np.uint64(HALF * part)).astype(np.uint32)
        s = syndromes(halves)
        n = counts[s]
        row = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        word = halves[row] ^ flips[starts[s][row] + nth]
        rows.append(row)
        keys.append(word.astype(np.int64) | np.int64(part << HALF))
    return np.concatenate(rows), np.concatenate(keys)


def at_home(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    part = (keys >> np.int64(HALF)).astype(np.uint64)
    halves = (fps >> (part * np.uint64(HALF))).astype(np.uint32)
    return home(halves) == (keys & np.int64((1 << HALF) - 1)).astype(np.uint32)


# --- comparing at an anchor -------------------------------------------------------------

def _small_links(fps: np.ndarray, homes: np.ndarray, sizes: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links of many small groups that stand one after another: a row against the row k places on."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((~homes, group))  # a group's homes come first
    fps, homes = fps[order], homes[order]
    left = np.cumsum(sizes)[group] - np.arange(len(fps))  # rows from here to the group's end
    rows, found, k = np.flatnonzero(homes), [], 1
    while len(rows := rows[left[rows] > k]):
        near = np.bitwise_count(fps[rows] ^ fps[rows + k]) <= distance
        found.append(np.stack((fps[rows[near]], fps[rows[near] + k])))
        k += 1
    return found


def forest(fps: np.ndarray, homes: np.ndarray, distance: int, own: np.ndarray | None = None) -> np.ndarray:
    """A spanning forest of the links between homes and all rows; with ``own``, of different owners only."""
    label, found = np.arange(len(fps)), []
    for i in np.flatnonzero(homes).tolist():
        near = (np.bitwise_count(fps ^ fps[i]) <= distance) & (label != label[i])
        if own is not None:
            near &= own != own[i]
        hits = np.flatnonzero(near)
        if len(hits):
            others, first = np.unique(label[hits], return_index=True)
            found += [(fps[i], fps[j]) for j in hits[first].tolist()]
            label[np.isin(label, others)] = label[i]
    return np.array(found, dtype=np.uint64).reshape(-1, 2).T


_STEP = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int64()), ("fps", pa.binary())])
_STEP_DDL = "a long, b long, key long, block long, fps binary"


def _link_rows(links: np.ndarray) -> pa.RecordBatch:
    n = links.shape[1]
    a, b = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in links)
    return pa.RecordBatch.from_arrays([a, b, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                                      schema=_STEP)


def _whole_groups(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Links of groups that are complete: sorted keys and their fingerprints."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    pick = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    homes = np.zeros(len(keys), dtype=bool)
    several = np.repeat(sizes > 1, sizes)
    homes[several] = at_home(keys[several], fps[several])
    if pick.any():
        found = _small_links(fps[pick], homes[pick], sizes[(sizes > 1) & (sizes <= SMALL)], distance)
        if found:
            yield _link_rows(np.concatenate(found, axis=1))
    for g in np.flatnonzero(sizes > SMALL).tolist():
        at = slice(starts[g], starts[g] + sizes[g])
        yield _link_rows(forest(fps[at], homes[at], distance))


def anchor_steps(reps: DataFrame, distance: int, partitions: int) -> DataFrame:
    """Links (a, b) found at anchors that one task holds whole, and blocks (key, block, fps) of the others."""
    reach = RADIUS + distance // 2
    keyed = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fps = b.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                row, key = anchor_keys(fps, reach)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], schema=keyed)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, given = TaskContext.get().partitionId(), 0
        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)  # the last key's rows so far
        first, open_key = None, None  # the run's first key; a key whose earlier rows went out in blocks

        def block(key: int, part: np.ndarray) -> pa.RecordBatch:
            nonlocal given
            given += 1
            return pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()),
                pa.array([run << 32 | given], pa.int64()), pa.array([part.tobytes()], pa.binary())], schema=_STEP)

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            fps = np.concatenate((fps, b.column(1).to_numpy().view(np.uint64)))
            first = int(keys[0]) if first is None else first
            head = int(np.searchsorted(keys, keys[0], "right"))
            tail = int(np.searchsorted(keys, keys[-1]))
            if tail and int(keys[0]) in (first, open_key):  # its end is seen now
                yield block(int(keys[0]), fps[:head])
            else:
                head = 0
            if tail > head:
                yield from _whole_groups(keys[head:tail], fps[head:tail], distance)
            keys, fps = keys[tail:], fps[tail:]
            while len(fps) > CHUNK:
                open_key = int(keys[0])
                yield block(open_key, fps[:CHUNK])
                keys, fps = keys[CHUNK:], fps[CHUNK:]
        if len(fps):
            yield block(int(keys[0]), fps)  # may go on in the next run

    return (reps.select("fp").mapInArrow(replicate, "key long, fp long")
            .repartitionByRange(partitions, "key", "fp").sortWithinPartitions("key", "fp")
            .mapInArrow(stream, _STEP_DDL))


def block_links(held: DataFrame, distance: int) -> DataFrame:
    """Links between fingerprints of one anchor, by pairs of its blocks (key, block, fps)."""
    # one row a block, of CHUNK fingerprints or of a run's end
    order = Window.partitionBy("key").orderBy("block")
    named = held.select("key", "block").withColumns({
        "own": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("key"))})
    dealt = (held.join(named, ["key", "block"])
             .select("key", "own", "fps", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("other"))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fps"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("fps").to_pylist()]
        fps = np.concatenate(parts)
        key = np.full(len(fps), rows.column("key")[0].as_py(), dtype=np.int64)
        own = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if len(parts) > 1 else None
        a, b = forest(fps, at_home(key, fps), distance, own)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return dealt.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                    distance: int = 3, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id.

    Fingerprints are SimHashes of the ``size``-word shingles; those that differ in at most ``distance`` bits
    are linked, and ``component_id`` is the least id reachable.

    A null or empty text, or one without words, has the fingerprint zero, which is linked like any
    other; a row with a null id gets its fingerprint and a null component and links nothing;
    rows of equal texts are copies; repeated rows are answered each; an empty table gives an empty
    result; columns other than the two named are ignored.  Texts of any length are read whole, in slices.
    """
    n = partitions or session_partitions(docs.sparkSession)
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(fingerprints(frame, size))
    reps = written(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    steps = written(anchor_steps(reps, distance, n))
    links = steps.where("a is not null").select("a", "b").unionByName(
        block_links(steps.where("key is not null").select("key", "block", "fps"), distance))
    labels = components(links.distinct())
    named = (reps.join(labels, F.col("fp") == F.col("node"), "left")
             .select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    of = join_salted(named, least, "group", F.col("fp")).select("fp", "component_id")
    out = join_salted(rows, of, "fp", F.col("doc_id"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      own.alias("component_id"))
