"""SentencePiece encoding by sampling without replacement, and decoding.

The segmentations of a text are the paths of its piece lattice.  A path's probability
is the product of its pieces' weights, normalised over all paths; a piece of rank r (the
vocabulary's merge order) weighs 1 / (r + 3)^theta, a byte fallback 1 / FALLBACK per byte.
Gumbel top-k sampling draws k distinct paths: each path's log-probability is perturbed by
Gumbel noise, and the k largest win.  An A-star search finds them without listing paths.
Its queue holds sets of paths (a path's beginning and the pieces not yet taken there);
a set's bound is the maximum of its paths' perturbed values, drawn top down: the maximum
of a set of mass m is Gumbel(log m), conditioned to stay below the bound of the set it
was cut from.  The bound is exact, so that each set popped yields the next sample.

No piece runs on past white space, so that a text's lattice is the chain of its words'
lattices; those are built once per distinct word of a block of texts.  All random
numbers are hashes of the row's key and the place where they are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import _power_tables, blocks, mix64

SPACE = "▁"
FALLBACK = 40000.0
#: Characters of the texts whose lattices are held at once.
BLOCK = 1 << 19
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, log_inclusion double"


class Vocabulary:
    """Pieces of a SentencePiece model; for encoding, as a trie over character classes."""

    def __init__(self, path: str, theta: float = 1.0, encodes: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.byte_ids = np.full(256, sp.unk_id(), dtype=np.int32)
        self.bytes_of: dict[int, int] = {}
        for i in range(size):
            if sp.is_byte(i):
                b = int(self.pieces[i][3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of[i] = b
        self._spelled = None
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if encodes:
            self._grow(sp, plain, theta)

    def _grow(self, sp, plain: list[int], theta: float) -> None:
        counts: dict[str, int] = {}
        for i in plain:
            for c in self.pieces[i]:
                counts[c] = counts.get(c, 0) + 1
        chars = sorted(counts, key=lambda c: (-counts[c], c))
        self.char_class = np.zeros(0x110000, dtype=np.int32)
        for k, c in enumerate(chars):
            self.char_class[ord(c)] = k + 1
        wide = min(256, len(chars) + 1)
        states: dict[tuple[int, int], int] = {}
        piece_at, weight_at = [-1], [0.0]
        for i in plain:
            # pieces without a rank (white space runs) rank with the first hundred
            rank = -sp.get_score(i) if sp.get_score(i) > -1e6 else 100.0
            s = 0
            for c in self.pieces[i]:
                step = (s, int(self.char_class[ord(c)]))
                s = states.get(step, 0)
                if not s:
                    s = states[step] = len(piece_at)
                    piece_at.append(-1)
                    weight_at.append(0.0)
            piece_at[s], weight_at[s] = i, -theta * float(np.log(max(rank, 0.0) + 3.0))
        self.piece_at, self.weight_at = np.array(piece_at, dtype=np.int32), np.array(weight_at)
        self.wide = wide
        self.near = np.zeros((len(piece_at), wide), dtype=np.uint16 if len(piece_at) < 1 << 16 else np.int32)
        self.root = np.zeros(len(chars) + 1, dtype=np.int32)
        far = []
        for (s, c), to in states.items():
            if s == 0:
                self.root[c] = to
            elif c < wide:
                self.near[s, c] = to
            else:
                far.append((s * (len(chars) + 1) + c, to))
        far.sort()
        self.span = len(chars) + 1
        self.far_keys = np.array([k for k, _ in far] or [-1], dtype=np.int64)
        self.far_to = np.array([t for _, t in far] or [0], dtype=np.int32)

    def step(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = self.near[state, np.where(cls < self.wide, cls, 0)].astype(np.int32)
        rare = np.flatnonzero(cls >= self.wide)
        if len(rare):
            key = state[rare].astype(np.int64) * self.span + cls[rare]
            at = np.minimum(np.searchsorted(self.far_keys, key), len(self.far_keys) - 1)
            out[rare] = np.where(self.far_keys[at] == key, self.far_to[at], 0)
        return out

    def _spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all pieces, where each begins, and their lengths."""
        if self._spelled is None:
            text = []
            for i, piece in enumerate(self.pieces):
                if i in self.bytes_of:
                    text.append(bytes([self.bytes_of[i]]))
                elif i in self.silent:
                    text.append(b"")
                else:
                    text.append((" ⁇ " if i == self.unknown else piece.replace(SPACE, " ")).encode())
            size = np.array([len(t) for t in text], dtype=np.int64)
            self._spelled = np.frombuffer(b"".join(text), dtype=np.uint8), np.cumsum(size) - size, size
        return self._spelled

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id sequences ``ids[offsets[i]:offsets[i + 1]]``; bytes that are no UTF-8 become U+FFFD."""
        data, begin, size = self._spelling()
        sizes = size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        spelled = data[np.repeat(begin[ids] - ends[:-1], sizes) + np.arange(int(ends[-1]))].tobytes()
        cuts = ends[offsets].tolist()
        texts = [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))[0]


def _uniform(key: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64-bit keys."""
    return ((mix64(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Lattices:
    """The lattices of the distinct words of a block of texts, and paths through them.

    A node is a character of a distinct word; an edge starts at a node and covers one
    piece.  Edges are held by node, nodes by their distance from the word's end.
    """

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(m) for m in marked])
        space = chars == ord(SPACE)
        first = np.zeros(len(chars), dtype=bool)
        if len(chars):
            first[1:] = space[1:] & ~space[:-1]
            starts_of_texts = (ends - [len(m) for m in marked])
            first[starts_of_texts[starts_of_texts < len(chars)]] = True
        start = np.flatnonzero(first)
        stop = np.concatenate((start[1:], [len(chars)])) if len(start) else start
        #: words of text i are word numbers text_at[i] to text_at[i + 1]
        self.text_at = np.concatenate(([0], np.searchsorted(start, ends)))
        powers, inverse = _power_tables(len(chars) + 1)
        total = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum(mix64(chars.astype(np.uint64) + np.uint64(1)) * powers[:len(chars)], out=total[1:])
        key = mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
        _, sample, self.word = np.unique(key, return_index=True, return_inverse=True)
        size = (stop - start)[sample]
        self.word_end = np.cumsum(size)
        self.word_start = self.word_end - size
        n = int(size.sum())
        self.chars = chars[np.arange(n) - np.repeat(self.word_start - start[sample], size)]
        self.end_of = np.repeat(self.word_end, size)
        self._edges(n)

    def _edges(self, n: int) -> None:
        v, chars, end_of = self.vocabulary, self.chars, self.end_of
        distance = end_of - np.arange(n)
        small = len(distance) and int(distance.max()) < 1 << 16
        order = np.argsort(distance.astype(np.uint16) if small else distance, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        cls = v.char_class[chars]
        steps = []
        at = np.arange(n)
        state = v.root[cls]
        length = 1
        while len(at):
            piece = v.piece_at[state]
            weight = v.weight_at[state]
            if length == 1:  # every character is an edge: a piece or its bytes
                bare = np.flatnonzero(piece < 0)
                c = chars[bare]
                width = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
                piece, weight = piece.copy(), weight.copy()
                piece[bare] = np.where(width == 1, v.byte_ids[np.minimum(c, 255)], -1)
                weight[bare] = -width * np.log(FALLBACK)
            hit = np.flatnonzero((piece >= 0) | (length == 1))
            steps.append((at[hit], length, piece[hit], weight[hit]))
            go = np.flatnonzero((state > 0) & (at + length < end_of[at]))
            at, state = at[go], state[go]
            state = v.step(state, cls[at + length])
            live = np.flatnonzero(state)
            at, state = at[live], state[live]
            length += 1
        count = np.zeros(n, dtype=np.int64)
        for node, *_ in steps:
            count[node] += 1
        self.count = count
        by_rank = count[order]
        offset = np.concatenate(([0], np.cumsum(by_rank)))
        self.first = offset[:-1][rank]  # a node's first edge
        m = int(offset[-1])
        length_of, self.piece = np.empty(m, dtype=np.int32), np.empty(m, dtype=np.int32)
        weight_of, src = np.empty(m), np.empty(m, dtype=np.int32)
        filled = self.first.copy()
        for node, length, piece, weight in steps:
            e = filled[node]
            length_of[e], self.piece[e], weight_of[e], src[e] = length, piece, weight, node
            filled[node] += 1
        del steps, filled
        self.source = src
        self.target = src + length_of
        mass = np.zeros(n + 1)  # log of the weight of all ways from a node to its word's end
        into = np.where(self.target == end_of[src], np.int32(n), self.target)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(distance)[1:]))) if n else np.zeros(1, dtype=np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            es, ee = int(offset[a]), int(offset[b])
            x = weight_of[es:ee] + mass[into[es:ee]]
            starts = offset[a:b] - es
            top = np.maximum.reduceat(x, starts)
            sums = np.add.reduceat(np.exp(x - np.repeat(top, by_rank[a:b])), starts)
            mass[order[a:b]] = top + np.log(sums)
        self.log_q = np.minimum(weight_of + mass[into] - mass[src], 0.0) if m else np.zeros(0)
        q = np.exp(self.log_q)
        run = np.cumsum(q)
        base = (run - q)[self.first] if n else run
        self.cumulative = run - base[src] if m else run
        del q, run, into, weight_of
        if n:
            self.cumulative[self.first + count - 1] = 2.0

    def paths(self, word: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one random path from character ``start`` to the end of each given word.

        Returns (edges, offsets): word i's edges are ``edges[offsets[i]:offsets[i + 1]]``.
        """
        end = self.word_end[word]
        here = start.copy()
        live = np.flatnonzero(here < end)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(word), dtype=np.int64)
        step = 0
        while len(live):
            u = _uniform(key[live] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            e = self.first[here[live]]
            over = np.flatnonzero(u > self.cumulative[e])
            while len(over):
                e[over] += 1
                over = over[u[over] > self.cumulative[e[over]]]
            taken.append((live, e))
            count[live] += 1
            here[live] = self.target[e]
            live = live[here[live] < end[live]]
            step += 1
        offsets = np.concatenate(([0], np.cumsum(count)))
        edges = np.empty(int(offsets[-1]), dtype=np.int64)
        for k, (who, e) in enumerate(taken):
            edges[offsets[who] + k] = e
        return edges, offsets

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; a character without a piece gives its bytes' ids."""
        out = self.piece[edges]
        bare = np.flatnonzero(out < 0)
        if not len(bare):
            return out
        parts, at = [], 0
        for k in bare.tolist():
            data = chr(int(self.chars[self.source[edges[k]]])).encode("utf-8", "surrogatepass")
            parts += [out[at:k], self.vocabulary.byte_ids[np.frombuffer(data, dtype=np.uint8)]]
            at = k + 1
        return np.concatenate([*parts, out[at:]])


def _below(log_mass: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel(log_mass) conditioned to stay below ``bound``; -inf where there is no mass."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        gap = np.exp(np.minimum(log_mass - bound, 700.0)) - np.log(u)
        return np.where(np.isneginf(log_mass), -np.inf, log_mass - np.log(gap))


def _rest(log_q: np.ndarray) -> np.ndarray:
    """Log of the mass of a node's other edges."""
    with np.errstate(divide="ignore"):
        left = -np.expm1(log_q)
        return np.where(left > 1e-12, np.log(np.maximum(left, 1e-300)), -np.inf)


class _Search:
    """The queue of one text: sets of paths that leave a known path at one node."""

    def __init__(self, seed: int):
        self.seed = seed
        self.sets: list[list] = []  # [best bound, its place, bounds, first node, path, before, taken edges]
        self.drawn = 0

    def uniforms(self, n: int) -> np.ndarray:
        return _uniform(np.arange(n, dtype=np.uint64) + np.uint64(self.stream()))

    def stream(self) -> int:
        """The key of a stream of random numbers of its own."""
        self.drawn += 1
        return (self.seed ^ 0x5851F42D4C957F2D) + (self.drawn << 40) & 0xFFFFFFFFFFFFFFFF

    def put(self, bounds: np.ndarray, first: int, path: np.ndarray, before: np.ndarray, taken: tuple = ()) -> None:
        if len(bounds):
            k = int(np.argmax(bounds))
            if bounds[k] > -np.inf:
                self.sets.append([float(bounds[k]), k, bounds, first, path, before, taken])

    def best(self) -> float:
        return max((s[0] for s in self.sets), default=-np.inf)

    def pop(self) -> tuple:
        entry = max(self.sets, key=lambda s: s[0])
        bound, k, bounds, first, path, before, taken = entry
        bounds[k] = -np.inf
        entry[1] = int(np.argmax(bounds))
        entry[0] = float(bounds[entry[1]])
        if entry[0] == -np.inf:
            self.sets.remove(entry)
        return bound, first + k, path, before, taken


def sample_block(texts: list[str], seeds: list[int], vocabulary: Vocabulary, k: int) -> list[list[tuple]]:
    """For each text, (ids, log probability, log inclusion score) of its samples, best first."""
    lattice = Lattices(texts, vocabulary)
    at = lattice.text_at
    seed = np.array(seeds, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    place = (np.arange(len(owner)) - at[owner]).astype(np.uint64)
    keys = mix64(seed[owner] + place * np.uint64(0xA0761D6478BD642F))
    word, start = lattice.word, lattice.word_start[lattice.word]
    out: list[list[tuple]] = [[] for _ in texts]
    search = [_Search(s) for s in seeds]
    # the first sample of each text: the maximum over all its paths
    edges, offsets = lattice.paths(word, start, keys)
    pending = []  # (text, bound, path, nodes known before, log probability before)
    for i in range(len(texts)):
        a, b = offsets[at[i]], offsets[at[i + 1]]
        bound = float(-np.log(-np.log(search[i].uniforms(1)[0])))
        pending.append((i, bound, edges[a:b], 0, 0.0))
    for turn in range(k):
        # the new nodes of all pending paths together: masses before and beside them, bounds below the path's own
        news = [p[2][p[3]:] for p in pending]
        sizes = np.array([len(x) for x in news], dtype=np.int64)
        ends = np.cumsum(sizes)
        whose = np.repeat(np.arange(len(pending)), sizes)
        lq = lattice.log_q[np.concatenate(news)]
        before, log_probs = np.empty(len(lq)), []
        for p, a, b in zip(pending, (ends - sizes).tolist(), ends.tolist()):  # sums of each path by itself
            run = np.cumsum(lq[a:b]) + p[4]
            before[a:b] = run - lq[a:b]
            log_probs.append(float(run[-1]) if b > a else p[4])
        noise = _uniform(np.repeat(np.array([search[p[0]].stream() for p in pending], dtype=np.uint64), sizes)
                         + np.arange(len(lq), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes))
        bounds = _below(before + _rest(lq), np.array([p[1] for p in pending])[whose], noise)
        for (i, _, path, known, _), a, b, log_prob in zip(pending, (ends - sizes).tolist(), ends.tolist(), log_probs):
            out[i].append((path, log_prob))
            search[i].put(bounds[a:b], known, path, before[a:b])
        if turn + 1 == k:
            break
        asked, words, starts, wkeys, sizes = [], [], [], [], []
        for i in sorted({p[0] for p in pending}):
            if search[i].best() == -np.inf:
                continue  # the text has no further segmentation
            bound, node, path, before, taken = search[i].pop()
            first = node - (len(path) - len(before))  # the node's place in ``before``
            old = int(path[node])
            source = int(lattice.source[old])
            e0 = int(lattice.first[source])
            excluded = (*taken, old) if not taken else taken
            free = [e for e in range(e0, e0 + int(lattice.count[source])) if e not in excluded]
            mass = np.exp(lattice.log_q[free])
            pick = float(search[i].uniforms(1)[0]) * mass.sum()
            new = free[min(int(np.searchsorted(np.cumsum(mass), pick)), len(free) - 1)]
            log_here = float(before[first])
            left = mass.sum() - float(np.exp(lattice.log_q[new]))
            if len(free) > 1 and left > 0:  # what is left at this node
                rest = np.array([log_here + np.log(left)])
                search[i].put(_below(rest, bound, search[i].uniforms(1)), node, path, before[first:],
                              (*excluded, new))
            # the words from here on are drawn afresh, the first from the new edge's end
            w = int(at[i]) + _word_of(lattice, path, node, int(at[i]))
            asked.append((i, bound, path[:node], new, log_here + float(lattice.log_q[new])))
            words.append(word[w:at[i + 1]])
            s = start[w:at[i + 1]].copy()
            s[0] = lattice.target[new]
            starts.append(s)
            wkeys.append(keys[w:at[i + 1]] + np.uint64((turn + 1) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
            sizes.append(len(s))
        if not asked:
            break
        edges, offsets = lattice.paths(np.concatenate(words), np.concatenate(starts), mix64(np.concatenate(wkeys)))
        pending, w = [], 0
        for (i, bound, head, new, log_before), size in zip(asked, sizes):
            tail = edges[offsets[w]:offsets[w + size]]
            w += size
            pending.append((i, bound, np.concatenate((head, [new], tail)), len(head) + 1, log_before))
    result = []
    for i, found in enumerate(out):
        kappa = search[i].best()
        result.append([(lattice.ids(p), lp, _log_inclusion(lp - kappa) if kappa > -np.inf else 0.0) for p, lp in found])
    return result


def _log_inclusion(above: float) -> float:
    """log(1 - exp(-exp(above))): that a Gumbel around a path's log-probability exceeds the threshold."""
    if above < -30.0:
        return above  # to double precision
    return float(np.log(-np.expm1(-np.exp(min(above, 700.0)))))


def _word_of(lattice: Lattices, path: np.ndarray, node: int, first_word: int) -> int:
    """Which of the text's words holds a path's node: the words ended before it."""
    before = path[:node]
    return int(np.count_nonzero(lattice.target[before] == lattice.end_of[lattice.source[before]]))


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, theta: float = 1.0, id_col: str = "doc_id",
                         text_col: str = "text", seed: int = 0) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text: id, sample (from 1), ids, log_prob, log_inclusion.

    ``log_prob`` is the path's log-probability among all of the text's; ``log_inclusion``
    the log-probability that it lies above the next perturbed value (its inclusion score given
    the threshold; 0 if the text has no more segmentations).  Samples come in the order
    of their perturbed values.  A row's samples depend on its id, its text, ``seed`` and
    the parameters alone.

    A null text is empty; an empty text has one segmentation, of no pieces; a null id has a
    seed of its own; repeated rows get equal samples each; an empty table gives an empty
    result; columns other than the two named are ignored.
    """
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.lit(seed)).alias("seed"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())),
                        ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_path, theta)
        for b in batches:
            rows = ((i, s % (1 << 64), b.column(2)[r].as_py())
                    for r, (i, s) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
            for group in blocks(rows, lambda r: len(r[2]), BLOCK):
                found = sample_block([r[2] for r in group], [r[1] for r in group], vocabulary, k)
                flat = [(group[g][0], n + 1, *s) for g, own in enumerate(found) for n, s in enumerate(own)]
                sizes = np.cumsum([0, *(len(f[2]) for f in flat)])
                ids = np.concatenate([f[2] for f in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(ids)),
                    pa.array([f[3] for f in flat], pa.float64()), pa.array([f[4] for f in flat], pa.float64())],
                    schema=schema)

    return frame.mapInArrow(run, SCHEMA)


def decode(frame: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``frame`` with the text that the ids stand for in place of ``ids_col``; null ids give null.

    Decoding gives back the text that was encoded (with U+2581 as a space).
    """
    kept = [c for c in frame.columns if c not in (ids_col, text_col)]
    cols = frame.select(F.col(f"`{ids_col}`").alias("ids"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model_path, encodes=False)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                column = part.column(0)
                lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
                texts = vocabulary.decode_all(column.flatten().to_numpy(), offsets)
                out = [t if known else None for t, known in zip(texts, column.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.string())],
                                                 names=[*b.schema.names[1:], "text"])

    out = cols.mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], F.col("text").alias(text_col))
