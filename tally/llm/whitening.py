"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the fit list is never formed.  A pass multiplies a block of directions Q by
it: every task takes its centred rows X and adds up X'(XQ), and only blocks of d x width numbers
travel.  A round applies a Chebyshev polynomial of V to the block by its three-term recurrence, a
pass a degree, which keeps the unwanted end of the spectrum small while the wanted end
grows; then the block is made orthonormal (QR), and Rayleigh-Ritz turns it to V's
eigenvectors.  Rounds end when every wanted pair's residual |V q - e q| is certified to be at
rounding level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import written

COMPONENTS = 16
SCALE, OFFSET = 64.0, 1_000_000
#: Directions beyond the wanted ones, degree of a round's polynomial, and the most rounds.
EXTRA, DEGREE, ROUNDS = 16, 10, 60
#: A pair is certified if its residual is at most this part of the largest eigenvalue, or at most ROUNDING and falling no more.
TOLERANCE, ROUNDING = 5e-15, 1e-11
#: How far one round's polynomial may raise the largest eigenvalue above the damped ones.
MAGNIFIED = 1e12
#: Eigenvalues of at most this part of the largest are rounding of zero: such directions are no components.
RANK_TOLERANCE = 1e-12
#: Bytes of one stored block of rows.
BLOCK = 1 << 18
#: Above so many tasks, some add up the others' sums before the driver does.
FEW = 64
_EXACT = 1 << 62
#: Quantised entries stay within this range.
_RANGE = 2.0 ** 60


@dataclass(frozen=True)
class Fit:
    """The fit list's size, sums of x per dimension, eigenvalues and unit eigenvectors (columns), and figures.

    ``trace`` is that of the covariance; ``passes`` and ``rounds`` were needed; ``residual`` is the largest
    certified one, as a part of the largest eigenvalue.
    """
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int
    rounds: int
    residual: float


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite: x = floor(scale * c) + offset, as longs.

    Beyond 2^60 scaled entries stay at that range's end.
    """
    vec = F.col(f"`{vector_col}`")
    finite = ~F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.where(vec.isNotNull() & finite)
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                    F.transform(vec, lambda c: F.floor(F.greatest(F.lit(-_RANGE), F.least(
                        F.lit(_RANGE), F.lit(scale) * c.cast("double")))).cast("long") + F.lit(offset))
                    .alias("x")))


def _rows(column: pa.ListArray, width: int, fill: int) -> np.ndarray:
    """A matrix of a batch's vectors; shorter ones are filled up."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(sizes), width), fill, dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _deviations(x: np.ndarray, n: int, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """n * x - S, exact: with mean = S // n and rest = S - n * mean it is n * (x - mean) - rest."""
    d = x - mean
    if float(np.abs(d).max(initial=0) + 1) * n >= _EXACT:
        return n * d.astype(object) - rest.astype(object)
    return n * d - rest


class _Passes:
    """The fit list's centred rows, in stored blocks, and what is summed over them."""

    def __init__(self, blocks: DataFrame, n: int, width: int):
        self.blocks, self.n, self.width, self.count = blocks, n, width, 0
        self.tasks = blocks.select(F.spark_partition_id()).distinct().count()

    def total(self, kernel, shape: tuple[int, int]) -> np.ndarray:
        """The sum over all blocks of ``kernel(rows)``, a matrix of the given shape, over n.

        Each task gives one matrix; some tasks add those up in a stated order, the driver the few that are left.
        """
        width, few = self.width, int(self.tasks ** 0.5)
        schema = pa.schema([("part", pa.int64()), ("total", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, out = TaskContext.get().partitionId(), np.zeros(shape)
            for b in batches:
                for block in b.column(0):
                    out += kernel(np.frombuffer(block.as_py(), dtype=np.float64).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([out.tobytes()], pa.binary())], schema=schema)

        def add(tables: pa.Table) -> pa.Table:
            rows = sorted(zip(tables.column("part").to_pylist(), tables.column("total").to_pylist()))
            out = np.sum([np.frombuffer(t).reshape(shape) for _, t in rows], axis=0)
            return pa.table([pa.array([rows[0][0]], pa.int64()), pa.array([out.tobytes()], pa.binary())], schema=schema)

        self.count += 1
        found = self.blocks.mapInArrow(run, "part long, total binary")
        if self.tasks > FEW:
            found = found.groupBy(F.col("part") % few).applyInArrow(add, "part long, total binary")
        parts = sorted((r.part, r.total) for r in found.collect())  # at most FEW, or the root of the tasks
        return np.sum([np.frombuffer(t).reshape(shape) for _, t in parts], axis=0) / self.n

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        return self.total(lambda x: x.T @ (x @ q), q.shape)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, and the turned block with its image."""
    small = q.T @ vq
    e, u = np.linalg.eigh((small + small.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    return e, q @ u, vq @ u


def _lower_end(times, width: int, steps: int = 8, seed: int = 7) -> float:
    """A safe lower end of the spectrum: Lanczos's least value less its last residual, at least 0."""
    q = np.random.default_rng(seed).standard_normal((width, 1))
    q /= np.linalg.norm(q)
    basis, alphas, betas = [q], [], []
    for _ in range(min(steps, width)):
        v = times(basis[-1])
        alphas.append(float((basis[-1] * v).sum()))
        for u in basis:
            v = v - u * float((u * v).sum())
        beta = float(np.linalg.norm(v))
        betas.append(beta)
        if beta <= 1e-12 * abs(alphas[0]):
            break
        basis.append(v / beta)
    k = len(alphas)
    small = np.diag(alphas) + np.diag(betas[:k - 1], 1) + np.diag(betas[:k - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(small)[0]) - betas[-1])


def chebyshev_subspace(times, width: int, wanted: int, extra: int = EXTRA, degree: int = DEGREE, rounds: int = ROUNDS,
                       tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(values, vectors, rounds, residual) of the ``wanted`` largest eigenpairs of the operator ``times``.

    The block has ``extra`` directions more.  The polynomial is small on [low, high], from a safe lower end of the
    spectrum to the block's least Ritz value, and scaled to size 1 at the largest.  Rounds end when all wanted residuals are
    within the tolerance, or within ROUNDING and falling no further: that is rounding level.  Else this fails.
    """
    k = min(width, wanted + extra)
    low = _lower_end(times, width) if k < width else 0.0
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]
    e, q, vq = _ritz(q, times(q))
    before = np.inf
    for turn in range(rounds + 1):
        residual = float(np.linalg.norm(vq - q * e, axis=0)[:wanted].max()) / max(float(e[0]), np.finfo(float).tiny)
        if residual <= tolerance or (residual <= ROUNDING and residual > before / 2):
            return e[:wanted], q[:, :wanted], turn, residual
        before = residual
        if k < width:
            high = max(float(e[-1]), low + 1e-3 * (float(e[0]) - low))
            q = np.linalg.qr(_filtered(times, q, vq, low, high, float(e[0]), degree))[0]
        else:  # the block is the whole space
            q = np.linalg.qr(q)[0]
        e, q, vq = _ritz(q, times(q))
    raise RuntimeError(f"not certified after {rounds} rounds: residual {residual:.3g} of the largest eigenvalue")


def _filtered(times, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the operator, applied to q (whose image is vq): a pass a degree beyond the first.

    The degree is held so low that the top does not outgrow the block's least wanted parts by more than MAGNIFIED.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    x = (top - centre) / half
    degree = max(2, min(degree, int(np.log(MAGNIFIED) / np.log(x + np.sqrt(x * x - 1)))))
    first = scale = half / (top - centre)
    y, z = q, (vq - centre * q) * (scale / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - scale)
        y, z = z, (times(z) - centre * z) * (2 * new / half) - (scale * new) * y
        scale = new
    return z


def fit(whole: DataFrame, components: int = COMPONENTS, fill: int = OFFSET, **options) -> Fit:
    """Fit the whitening on the distinct vectors of ``whole`` (column x)."""
    wide = whole.agg(F.max(F.size("x")).alias("d")).first().d or 0
    padded = F.concat("x", F.array_repeat(F.lit(fill).cast("long"), F.lit(wide) - F.size("x")))
    distinct = written(whole.select(padded.alias("x")).distinct())
    # one row a dimension
    sums = (distinct.select(F.posexplode("x")).groupBy("pos")
            .agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect())
    if not sums:
        return Fit(0, (), np.zeros(0), np.zeros((wide, 0)), 0.0, 0.0, 0, 0, 0.0)
    n = int(sums[0].n)
    total = [int(r.s) for r in sorted(sums, key=lambda r: r.pos)]
    mean, rest = _centre(total, n)
    schema = pa.schema([("rows", pa.binary())])
    step = max(1, BLOCK // (8 * wide))

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                x = _deviations(_rows(b.column(0).slice(at, step), wide, fill), n, mean, rest).astype(np.float64) / n
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], schema=schema)

    passes = _Passes(written(distinct.mapInArrow(centred, "rows binary")), n, wide)
    trace = float(passes.total(lambda x: np.array([[np.einsum("ij,ij->", x, x)]]), (1, 1))[0, 0])
    wanted = min(components, wide)
    if trace <= 0:
        return Fit(n, tuple(total), np.zeros(0), np.zeros((wide, 0)), trace, 0.0, passes.count, 0, 0.0)
    e, q, rounds, residual = chebyshev_subspace(passes.covariance_times, wide, wanted, **options)
    some = e > RANK_TOLERANCE * e[0]
    e, q = e[some], q[:, some]
    scaled = q / np.sqrt(e)
    unit = passes.total(lambda x: (x @ scaled).T @ (x @ scaled), (len(e), len(e)))
    error = float(np.abs(unit - np.eye(len(e))).max())
    return Fit(n, tuple(total), e, q, trace, error, passes.count, rounds, residual)


def _centre(total: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in total], dtype=np.int64), np.array([s % n for s in total], dtype=np.int64)


def transform(whole: DataFrame, model: Fit, fill: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    n, k, width, error = model.n, len(model.values), len(model.sums), model.identity_error
    mean, rest = _centre(list(model.sums), n) if n else (np.zeros(0, np.int64),) * 2
    scaled = model.vectors / np.sqrt(model.values) if k else model.vectors
    explained = model.values / model.trace if k else model.values
    step = max(1, BLOCK // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows if k else 0, step):
                ids = b.column(0).slice(at, step)
                off = _deviations(_rows(b.column(1).slice(at, step), width, fill), n, mean, rest)
                white = (off.astype(np.float64) / n) @ scaled
                m = len(ids)
                rows = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()),
                    pa.array(np.repeat(_squares(off), k)), pa.array(white.ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], schema=schema)

    return whole.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, "
                                 "explained double, identity_error double")


def _squares(off: np.ndarray) -> np.ndarray:
    """Each row's sum of squares, exact; beyond a long it stays at its end."""
    if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) < _EXACT:
        return (off * off).sum(axis=1)
    return np.array([min((1 << 63) - 1, sum(int(v) ** 2 for v in row)) for row in off], dtype=np.int64)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           **options) -> DataFrame:
    """Whitened coordinates: a row per row of ``vectors`` and component, the largest eigenvalue first.

    Each entry becomes x = floor(64 * c) + 1000000; the covariance is that of the distinct x vectors, with
    divisor n.  ``deviation`` is the sum of (n * x - S)^2, exact; ``whitened`` the centred vector's
    coordinate along the component over the square root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace; ``identity_error`` how far the whitened fit list's
    covariance is from the identity.

    Vectors that are null or hold a null or non-finite entry take no part; a null id stays null;
    repeated vectors count once in the fit and are answered each; of equal eigenvalues any basis serves;
    vectors of unequal lengths meet as if padded with zeros; directions without variance
    are no components, so that a single distinct vector or an empty table gives an empty result; columns other than
    the two named are ignored.  The driver and each task hold d x (components + 16) numbers, d the vectors' length.
    """
    whole = written(quantised(vectors, id_col, vector_col))
    return transform(whole, fit(whole, components, **options))
