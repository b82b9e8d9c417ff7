"""Exact quantiles and moments by bracketing: two scans, whatever the number of distinct values.

1. One scan builds a mergeable quantile sketch of each column (KLL).  For each wanted quantile it
   gives an interval of values that holds the wanted ranks, as far as the sketch's error goes.
2. The next scan counts the values below, between and above the intervals, and the distinct values
   inside them; outside values fold to a few rows a task, so only the insides are shuffled.
3. The exact counts show whether the wanted ranks fall inside; if not, the interval is widened and step 2
   repeated.  So the sketch decides how much is sorted, never the answer.

On very large tables an interval still holds many rows: beyond ``INSIDE`` a scan more sketches the interval
itself, and narrows it by the sketch's error again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.session import ensure_checkpoint_dir

#: The sketches' size parameter, and a generous bound of their rank error for it.
SKETCH_K = 4000
#: Rows expected in an interval, beyond which it is narrowed by a scan of its own.
INSIDE = 2_000_000
#: Rows up to which the counting scan is dealt out anew.
SPREAD = 5_000_000
#: Decimals that the exact sums carry.
EXACT_SCALE = 6
_LIMB = 27  # bits of the lower limb of a value, and of a product


def sketch_error(k: int) -> float:
    return 3.0 / k ** 0.9


def _values(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Each column as doubles; NaN is no value."""
    return {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols}


def _at(sketch: str, n: int, low: int, high: int, error: float) -> Column:
    """The sketch's values at the ranks low and high (of n), moved apart by the error."""
    places = F.array(F.lit(max(0.0, low / n - error)), F.lit(min(1.0, (high + 1) / n + error)))
    return F.kll_sketch_get_quantile_double(sketch, places)


class _Column:
    """What the driver knows of a column: its size, a rough mean, and an interval for each wanted quantile."""

    def __init__(self, n: int, centre: float, probs: Sequence[tuple[str, float]]):
        self.n, self.centre = n, centre if centre is not None and isfinite(centre) else 0.0
        self.ranks = {name: (floor((n - 1) * q), ceil((n - 1) * q)) for name, q in probs} if n else {}
        self.bounds: dict[str, tuple[float, float]] = {}

    def intervals(self) -> list[tuple[float, float]]:
        """Disjoint intervals, ascending."""
        out: list[tuple[float, float]] = []
        for a, b in sorted(self.bounds.values()):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def _sketch(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """One row: (n_i, avg_i, sketch_i) of each column."""
    out = []
    for i, v in enumerate(_values(df, cols).values()):
        out += [F.count(v).alias(f"n_{i}"), F.avg(v).alias(f"avg_{i}"), F.kll_sketch_agg_double(v, F.lit(k)).alias(f"sketch_{i}")]
    return df.agg(*out).checkpoint(eager=True)


def _bracket(i: int, column: _Column, names: Sequence[str], error: float) -> Column:
    return F.array(*[_at(f"sketch_{i}", column.n, *column.ranks[m], error) for m in names]).alias(f"b_{i}")


def _narrow(df: DataFrame, cols: Sequence[str], state: Mapping[str, _Column], k: int, wide: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One scan that sketches the insides of the intervals ``wide`` and narrows them; those that shrank."""
    values, error, aggs = _values(df, cols), sketch_error(k), []
    for j, (c, name) in enumerate(wide):
        a, b = state[c].bounds[name]
        v = values[c]
        aggs += [F.count(F.when(v < a, 1)).alias(f"below_{j}"), F.count(F.when(v.between(a, b), 1)).alias(f"in_{j}"),
                 F.kll_sketch_agg_double(F.when(v.between(a, b), v), F.lit(k)).alias(f"sketch_{j}")]
    row = df.agg(*aggs).checkpoint(eager=True)
    sizes = row.select(*[f"{x}_{j}" for j in range(len(wide)) for x in ("below", "in")]).first()
    held = {}
    for j, (c, name) in enumerate(wide):
        low, high = (r - sizes[f"below_{j}"] for r in state[c].ranks[name])
        if 0 <= low and high < sizes[f"in_{j}"]:
            held[j] = _at(f"sketch_{j}", sizes[f"in_{j}"], low, high, error).alias(f"b_{j}")
    got, shrunk = row.select(*held.values()).first() if held else None, []
    for j in held:
        (c, name), bounds, inside = wide[j], tuple(got[f"b_{j}"]), sizes[f"in_{j}"]
        if bounds != state[c].bounds[name]:
            state[c].bounds[name] = bounds
            if inside * 2 * error > INSIDE:
                shrunk.append((c, name))
    return shrunk


def _counted(df: DataFrame, cols: Sequence[str], state: Mapping[str, _Column]) -> DataFrame:
    """(k, code, value, c, moments): rows of column k below (code 0), in (1), between (2), in (3) ... its intervals.

    ``value`` is set inside, where every distinct value has a row.  One scan; repeats fold map-side.
    """
    each = []
    for i, (c, v) in enumerate(_values(df, cols).items()):
        code = F.lit(0)
        for a, b in state[c].intervals():
            code = code + (v >= a).cast("int") + (v > b).cast("int")
        each.append(F.struct(F.lit(i).alias("k"), v.alias("v"), code.alias("code")))
    rows = df.select(F.explode(F.array(*each)).alias("p")).select("p.*").where(F.col("v").isNotNull())
    unit, limb = float(10 ** EXACT_SCALE), (1 << _LIMB) - 1
    whole = F.rint(F.col("v") * unit)  # round() goes through BigDecimal
    fits = (F.abs(whole) < float(1 << 53)) & (whole / unit == F.col("v"))
    rows = rows.withColumn("u", F.when(fits, whole).cast("long"))
    rows = rows.withColumns({"a": F.shiftright("u", _LIMB), "b": F.col("u").bitwiseAND(F.lit(limb))})
    sums = {"a": F.col("a"), "b": F.col("b")}
    for name, x in (("aa", F.col("a") * F.col("a")), ("ab", F.col("a") * F.col("b")), ("bb", F.col("b") * F.col("b"))):
        sums |= {f"{name}_high": F.shiftright(x, _LIMB), f"{name}_low": x.bitwiseAND(F.lit(limb))}
    centre = F.element_at(F.array(*[F.lit(state[c].centre) for c in cols]), F.col("k") + 1)
    return (rows.groupBy("k", "code", F.when(F.col("code") % 2 == 1, F.col("v")).alias("value"))
            .agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s1"), F.sum((F.col("v") - centre) * (F.col("v") - centre)).alias("m2"),
                 F.min("v").alias("least"), F.max("v").alias("most"), F.bool_and(F.col("u").isNotNull()).alias("exact"),
                 *[F.try_sum(x).alias(n) for n, x in sums.items()]))


def bracketed_counts(df: DataFrame, cols: Sequence[str], probs: Sequence[tuple[str, float]], k: int = SKETCH_K) -> tuple[DataFrame, dict[str, _Column]]:
    """Checkpointed counts (see ``_counted``) whose intervals surely hold every wanted rank, and the columns' state."""
    ensure_checkpoint_dir(df.sparkSession)
    names, error = [name for name, _ in probs], sketch_error(k)
    row = _sketch(df, cols, k)
    sizes = row.select(*[c for i in range(len(cols)) for c in (f"n_{i}", f"avg_{i}")]).first()
    state = {c: _Column(sizes[f"n_{i}"], sizes[f"avg_{i}"], probs) for i, c in enumerate(cols)}
    first = True
    if max((x.n for x in state.values()), default=0) <= SPREAD:
        # a small table may lie in one row group, which one task reads: the counting is worth a shuffle then
        at = [F.col(f"`{c}`") for c in cols]
        df = df.select(*at).repartition(df.sparkSession.sparkContext.defaultParallelism, *at)
    while True:
        filled = [(i, c) for i, c in enumerate(cols) if state[c].n]
        if filled and names:
            found = row.select(*[_bracket(i, state[c], names, error) for i, c in filled]).first()
            for i, c in filled:
                for name, pair in zip(names, found[f"b_{i}"]):
                    a, b = pair
                    if name in state[c].bounds:  # only ever wider
                        a, b = min(a, state[c].bounds[name][0]), max(b, state[c].bounds[name][1])
                    state[c].bounds[name] = a, b
        wide = [(c, m) for _, c in filled for m in names if 2 * error * state[c].n > INSIDE] if first else []
        while wide:
            wide = _narrow(df, cols, state, k, wide)
        counts = _counted(df, cols, state).checkpoint(eager=True)
        if _certain(counts, cols, state):
            return counts, state
        error, first = error * 4, False


def _certain(counts: DataFrame, cols: Sequence[str], state: Mapping[str, _Column]) -> bool:
    """Whether each wanted rank falls inside an interval, by the exact counts: a few rows a column."""
    sums = {(r.k, r.code): r.n for r in counts.groupBy("k", "code").agg(F.sum("c").alias("n")).collect()}
    for i, c in enumerate(cols):
        ends, at = [], 0
        for code in range(2 * len(state[c].intervals()) + 1):
            at += sums.get((i, code), 0)
            ends.append(at)
        for ranks in state[c].ranks.values():
            if any(next(code for code, end in enumerate(ends) if rank < end) % 2 == 0 for rank in ranks):
                return False
    return True


def quantiles_from_counts(counts: DataFrame, cols: Sequence[str], state: Mapping[str, _Column],
                          probs: Sequence[tuple[str, float]]) -> DataFrame:
    """(k, <name> for each prob): linear interpolation between the values at the wanted ranks.

    For n values sorted v[0..n-1], quantile q is v[lo] + (v[hi] - v[lo]) * f with
    h = (n-1) q, lo = floor(h), hi = ceil(h), f = h - lo.
    """
    wanted = [(i, name, side, rank, (state[c].n - 1) * q - floor((state[c].n - 1) * q))
              for i, c in enumerate(cols) if state[c].n for name, q in probs
              for side, rank in zip(("lo", "hi"), state[c].ranks[name])]
    spark = counts.sparkSession
    wanted = spark.createDataFrame(wanted, "wk int, q_name string, side string, rank long, frac double")  # 2 a column and prob
    upto = Window.partitionBy("k").orderBy("code", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row for each value inside an interval, and for each gap
    spans = counts.select("k", "value", "c", F.sum("c").over(upto).alias("end"))
    hits = spans.join(F.broadcast(wanted), (F.col("k") == F.col("wk")) & (F.col("rank") < F.col("end"))
                      & (F.col("rank") >= F.col("end") - F.col("c")))
    per_q = hits.groupBy("k", "q_name").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("lo"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("hi"), F.max("frac").alias("frac"))
    value = F.col("lo") + F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * F.col("frac")).otherwise(0.0)
    return per_q.select("k", "q_name", value.alias("v")).groupBy("k").pivot("q_name", [n for n, _ in probs]).agg(F.first("v"))


def moments_from_counts(counts: DataFrame, cols: Sequence[str], state: Mapping[str, _Column]) -> DataFrame:
    """(k, n, mean, std, min, max) from the counts' sums.

    A column whose values all have at most EXACT_SCALE decimals (integers, money, rates) is summed exactly, as
    whole 1/10^EXACT_SCALE units and their squares in limbs: the result does not depend on the
    order or number of partitions.  Other columns, and sums beyond the limbs or 38 digits, are summed as
    floats, which depends on the order in the last bits; their std comes from the second moment about a rough mean.
    """
    limbs = ["a", "b", *[f"{p}_{h}" for p in ("aa", "ab", "bb") for h in ("high", "low")]]
    total = counts.groupBy("k").agg(
        F.sum("c").alias("n"), F.sum("s1").alias("s1"), F.sum("m2").alias("m2"), F.min("least").alias("min"),
        F.max("most").alias("max"), F.bool_and("exact").alias("exact"),
        *[F.when(F.bool_and(F.col(x).isNotNull()), F.try_sum(x)).alias(x) for x in limbs])
    big = lambda x: F.col(x).cast("decimal(38,0)")
    power = lambda bits: F.expr(f"cast({1 << bits} as decimal(38,0))")
    times, plus = F.try_multiply, F.try_add

    def joined(high: Column, low: Column) -> Column:
        return plus(times(high, power(_LIMB)), low)

    s = joined(big("a"), big("b"))
    aa, ab, bb = (joined(big(f"{p}_high"), big(f"{p}_low")) for p in ("aa", "ab", "bb"))
    q = plus(plus(times(aa, power(2 * _LIMB)), times(ab, power(_LIMB + 1))), bb)
    n, unit = F.col("n").cast("double"), float(10 ** EXACT_SCALE)
    total = total.withColumns({"s": F.when(F.col("exact"), s), "q": F.when(F.col("exact"), q)})
    centre = F.element_at(F.array(*[F.lit(state[c].centre) for c in cols]), F.col("k") + 1)
    spread = F.try_subtract(times(big("n"), F.col("q")), times(F.col("s"), F.col("s"))).cast("double")
    total = total.withColumns({"mean": F.coalesce(F.col("s").cast("double") / unit / n, F.col("s1") / n), "spread": spread})
    rough = F.greatest(F.lit(0.0), F.col("m2") - n * F.pow(F.col("s1") / n - centre, 2))
    std = F.when(F.col("n") > 1, F.sqrt(F.coalesce(F.col("spread") / (unit * unit) / (n * (n - 1)), rough / (n - 1))))
    return total.select("k", F.col("n").cast("bigint").alias("n"), "mean", std.alias("std"), "min", "max")


__all__ = ["bracketed_counts", "quantiles_from_counts", "moments_from_counts"]
