"""Near-duplicate groups by MinHash with tensored banding and exact verification.

Two collections of ``side`` bands of ``width`` minhashes each are computed, the left
and the right.  Every pair (left band, right band) forms a table key, so that
``side`` squared tables need only 2 * side * width minhashes: about the square root
of what as many separate bands would take (tensoring).  Documents that share a key are candidates.

1. Texts with equal shingle sets collapse into one representative.
2. Keys are sorted over the cluster; in every bucket the members meet its least
   member (a star), and those pairs are verified on the full shingle sets.
3. Verified links are contracted to components.  Buckets that still hold more than
   one component are resolved exactly: all their members' pairs across components are
   verified, block by block, so that no candidate pair goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import blocks, id_filter, join_salted, mix64, session_partitions, shingle_sets, written
from tally.llm.components import components


@dataclass(frozen=True)
class Banding:
    """A pair of similarity s shares a table with probability (1 - (1 - s^width)^side)^2."""
    side: int = 12
    width: int = 3

    @property
    def hashes(self) -> int:
        return 2 * self.side * self.width


#: Documents of one block of an unresolved bucket.
CHUNK = 256


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Minhashes, 32 bits each, of non-empty sets; one row a set."""
    out = np.zeros((len(sets), hashes), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))[:-1]
        mult, add = _multipliers(hashes)
        for j in range(hashes):
            least = np.minimum.reduceat((values ^ add[j]) * mult[j], starts)
            out[full, j] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(signature: np.ndarray, banding: Banding) -> np.ndarray:
    """Keys of the left bands, then of the right ones, per row."""
    parts = signature.reshape(len(signature), 2 * banding.side, banding.width).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, 2 * banding.side + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(banding.width):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k] + np.uint64(1))
    return key


def table_keys(signature: np.ndarray, banding: Banding) -> np.ndarray:
    """side * side table keys per row: each left band's key combined with each right one's."""
    keys = band_keys(signature, banding)
    left, right = keys[:, :banding.side, None], keys[:, None, banding.side:]
    return mix64(left * np.uint64(5) + right).reshape(len(signature), -1).view(np.int64)


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _text_blocks(batch: pa.RecordBatch, column: int):
    """Row numbers of a batch, and their texts, in blocks of a few MB."""
    rows = ((i, _encode(batch.column(column)[i].as_py())) for i in range(batch.num_rows))
    for group in blocks(rows, lambda r: len(r[1])):
        yield [i for i, _ in group], [t for _, t in group]


def sketches(docs: DataFrame, size: int, banding: Banding) -> DataFrame:
    """(doc_id, n, digest, sig) per row of (doc_id, text): set size, set digest, minhashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in _text_blocks(b, 1):
                sets = shingle_sets(texts, size)
                sig = signatures(sets, banding.hashes)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sig], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sig binary")


def _signature_rows(column: pa.Array, banding: Banding) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, banding.hashes)


def bucket_members(reps: DataFrame, banding: Banding, partitions: int) -> DataFrame:
    """(key, leader, rep, cut) of all members of buckets of two or more.

    The keys are range-partitioned and sorted by (key, rep), so that a bucket of any size may
    spread over several tasks; each streams over its run.  ``leader`` is the least member
    of a bucket's run; ``cut`` marks buckets at a run's ends, which may go on in the next.
    """
    keyed = pa.schema([("key", pa.int64()), ("rep", pa.int64())])
    member = pa.schema([("key", pa.int64()), ("leader", pa.int64()), ("rep", pa.int64()), ("cut", pa.bool_())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = table_keys(_signature_rows(part.column(1), banding), banding)
                reps_ = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps_)], schema=keyed)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (key, leader, rep of a lone member not yet given out or None, first group?)

        def rows(keys, leaders, reps_, cuts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(leaders, pa.int64()),
                                               pa.array(reps_, pa.int64()), pa.array(cuts, pa.bool_())], schema=member)

        for b in batches:
            keys, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            leaders = ids[starts].copy()
            joined = held is not None and held[0] == keys[0]  # the first bucket goes on from the batch before
            first = held is None or (joined and held[3])
            alone = sizes == 1
            cut = np.zeros(len(starts), dtype=bool)
            cut[0] = first
            if joined:
                leaders[0] = held[1]
                alone[0] = False
                if held[2] is not None:
                    yield rows([held[0]], [held[1]], [held[2]], [held[3]])
            elif held is not None and held[2] is not None and held[3]:
                yield rows([held[0]], [held[1]], [held[2]], [True])  # a lone member at the run's start
            last_alone = bool(alone[-1])
            give = ~alone
            if cut[0] and len(starts) > 1:
                give[0] = True
            if last_alone and len(starts) > 0:
                give[-1] = False
            which = np.repeat(give, sizes)
            if which.any():
                yield rows(keys[which], np.repeat(leaders, sizes)[which], ids[which], np.repeat(cut, sizes)[which])
            held = (int(keys[-1]), int(leaders[-1]), int(ids[-1]) if last_alone else None,
                    bool(cut[-1]) if len(starts) > 1 or not joined else held[3])
        if held is not None:  # the run's last bucket: its leader once more, marked
            yield rows([held[0]], [held[1]], [held[1]], [True])

    return (reps.select("rep", "sig").mapInArrow(explode, "key long, rep long")
            .repartitionByRange(partitions, "key", "rep").sortWithinPartitions("key", "rep")
            .mapInArrow(stream, "key long, leader long, rep long, cut boolean"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar; ``texts`` has (rep, n, text)."""
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("text").alias(f"t_{c}"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    sized = (pairs.join(side("a").drop("t_a"), "a").join(side("b").drop("t_b"), "b").where(near).select("a", "b"))
    rows = (sized.join(side("b").drop("n_b"), "b").join(side("a").drop("n_a"), "a").select("a", "b", "t_a", "t_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            ids = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            whole = ((i, j, b.column(2)[k].as_py(), b.column(3)[k].as_py()) for k, (i, j) in enumerate(ids))
            for group in blocks(whole, lambda r: len(r[2]) + len(r[3])):
                found = []
                sets = shingle_sets([_encode(r[3]) for r in group], size)
                for (i, j, ta, _), other in zip(group, sets):
                    if last[0] != ta:  # rows of one leader come together
                        last = (ta, shingle_sets([_encode(ta)], size)[0])
                    if _similar(last[1], other, percent):
                        found.append((i, j))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def leftover_links(members: DataFrame, labels: DataFrame, texts: DataFrame, size: int, percent: int,
                   banding: Banding, partitions: int) -> DataFrame:
    """Links between different components within the buckets that hold several.

    Candidates of such buckets meet on their left bands, each pair on the first that it
    shares (and only if it shares a right band too).  A large band is cut into chunks of
    about CHUNK members, and every pair of chunks is one block: bounded memory, any
    number of tasks.  Pairs are never given out, only links found.
    """
    named = (members.select("key", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    mixed = (named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("key"))
    open_ = named.join(mixed, "key", "left_semi").select("rep", "component").distinct()
    open_ = written(open_.join(texts, "rep").select("rep", "component", "n", "sig", "text"))

    narrow = pa.schema([("band", pa.int64()), ("rep", pa.int64()), ("component", pa.int64())])

    def left_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = band_keys(_signature_rows(b.column(2), banding), banding)[:, :banding.side].view(np.int64)
            each = [np.repeat(b.column(k).to_numpy(), banding.side) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *map(pa.array, each)], schema=narrow)

    bands = written(open_.select("rep", "component", "sig")
                    .mapInArrow(left_bands, "band long, rep long, component long"))
    mixed = (bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"),
                                       F.max("component").alias("hi"))
             .where("lo < hi").select("band", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    # the members of a hot band spread over tasks
    dealt = (join_salted(bands, mixed, "band", F.col("rep")).withColumn("own", own)
             .select("band", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep"))
    rows = (dealt.join(open_, "rep").select("band", "bi", "bj", "own", "rep", "component", "n", "sig", "text")
            .repartition(partitions, "band", "bi", "bj").sortWithinPartitions("band", "bi", "bj"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for b in batches:
            found = []
            for k, key in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if key != at and group:
                    found += _block_links(group, at[0], size, percent, banding)
                    group = []
                at = key
                group.append(tuple(b.column(c)[k].as_py() for c in range(3, 9)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        found = _block_links(group, at[0], size, percent, banding) if group else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def _block_links(group: list[tuple], band: int, size: int, percent: int, banding: Banding) -> list[tuple]:
    """Links that join components, within a block of (own chunk, rep, component, n, sig, text)."""
    own = np.array([g[0] for g in group])
    crossing = len(set(own.tolist())) > 1
    n = np.array([g[3] for g in group])
    keys = band_keys(np.frombuffer(b"".join(g[4] for g in group), dtype=np.uint32).reshape(len(group), -1), banding)
    left, right = keys[:, :banding.side], keys[:, banding.side:]
    table = int(np.flatnonzero(left[0].view(np.int64) == band)[0])
    parent = {g[2]: g[2] for g in group}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_sets([_encode(group[i][5])], size)[0]
        return sets[i]

    found = []
    for i in range(len(group) - 1):
        rest = slice(i + 1, None)
        ok = 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
        if crossing:  # pairs within a chunk belong to that chunk's own block
            ok &= own[rest] != own[i]
        ok &= (right[rest] == right[i]).any(1)
        if table:
            ok &= ~(left[rest, :table] == left[i, :table]).any(1)
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            a, b = root(group[i][2]), root(group[j][2])
            if a != b and _similar(shingles(i), shingles(j), percent):
                found.append((group[i][1], group[j][1]))
                parent[max(a, b)] = min(a, b)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80, banding: Banding = Banding(), partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    ``size``-word shingles (64-bit hashes of the words), confirmed on full sets;
    ``component_id`` is the least id reachable, ``kept`` whether that is the row's own.

    A null or empty text, or one without words, has no shingles and is linked with
    nothing; a row with a null id is linked with nothing, has a null component and is
    kept; rows of equal texts are copies; repeated rows are answered each; an empty table
    gives an empty result; columns other than the two named are ignored.
    """
    n = partitions or session_partitions(docs.sparkSession)
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(sketches(frame, size, banding))
    reps = written(rows.where("doc_id is not null and n > 0").groupBy("digest")
                   .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    members = written(bucket_members(reps, banding, n))
    runs = members.where("cut").select("key", "leader").distinct()
    pairs = members.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).unionByName(
        runs.join(runs.groupBy("key").agg(F.min("leader").alias("a")), "key").where("a <> leader")
        .select("a", F.col("leader").alias("b"))).distinct()
    pairs = written(pairs)
    texts = written(_candidate_texts(frame, pairs, size, banding))
    stars = written(verified(pairs, texts, size, percent))
    extra = written(leftover_links(members, components(stars), texts, size, percent, banding, n))
    labels = components(stars.unionByName(extra))
    named = (reps.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left")
             .select("digest", F.coalesce("component", "rep").alias("component_id")))
    # copies of one text may be many: their rows are salted
    out = join_salted(rows.select("doc_id", "n", "digest"), named, "digest", F.col("doc_id"), "left")
    # without shingles a digest is that of the empty set and has no representative
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _candidate_texts(frame: DataFrame, pairs: DataFrame, size: int, banding: Banding) -> DataFrame:
    """(rep, n, sig, text) of the documents in any candidate pair."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in _text_blocks(b, 1):
                sets = shingle_sets(texts, size)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in signatures(sets, banding.hashes)], pa.binary()),
                    b.column(1).take(at)], schema=schema)

    likely = frame.where(id_filter(ids)(F.col("doc_id")))  # the other texts are not shuffled
    return (likely.join(ids, "doc_id", "left_semi").select("doc_id", "text")
            .mapInArrow(run, "rep long, n long, sig binary, text string"))
