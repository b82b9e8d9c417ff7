"""How a language's sources differ in their words: chi-square divergences from one-hot level products.

A term's price in a group depends on its count there, its level, alone; so a sum over all terms for two
groups needs only their joint table: how many terms have level a in one and b in the other.  One
indicator column per (group, level) makes a 0/1 matrix X over the terms, and the product of X's
transpose with X holds every joint table of every two groups.  It is taken in blocks, groups
by groups and over shards of the terms, in exact integers.  Most of X is level 0 and is never stored: a
joint table's zero row and column follow from its margins, so that with f(a, b) the priced cell

    sum f = sum over a, b > 0 of n(a, b) * (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
            + sum over a > 0 of n(a) * (f(a, 0) - f(0, 0)) + sum over b > 0 of n(b) * (f(0, b) - f(0, 0))
            + V * f(0, 0).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import join_salted, written

LEAST_DOCS = 3       # a kept term occurs in so many documents of its language
UNIT = 1_000_000_000  # prices are whole parts of this, plus one
TOP_TERMS = 200
#: Terms of a shard and groups of a block, on average.
TERMS, GROUPS = 16384, 32
#: Nonzero products taken at once.
_PRODUCTS = 1 << 21
#: Distinct (group, term) counts that a task holds before it gives them out.
_HELD = 200_000
_SLICE = 8 << 20
# bytes: A-Z folded, other letters and all non-ASCII bytes kept, the rest blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in slices cut between terms."""
    text, at = text.translate(_FOLD), 0
    while len(text) - at > _SLICE:
        gap = text.find(b" ", at + _SLICE)
        if gap < 0:
            break
        yield text[at:gap].split()
        at = gap
    yield text[at:].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of (lang, source, text): occurrences and documents per group.

    Counted in each task first, then over the cluster.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()),
                        ("count", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, docs_) in held.items():
                n = len(count)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                    pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64()),
                    pa.array([docs_[t] for t in count], pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(b.num_rows):
                count, docs_ = held.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in _words(b.column(2)[i].as_py()):
                    count.update(words)
                    seen.update(words)
                docs_.update(seen)
            if sum(len(c) for c, _ in held.values()) > _HELD:
                yield from give()
        yield from give()

    return (docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "lang string, source string, term binary, count long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
            .withColumn("term", F.col("term").cast("string")))


def _price(count: str, n: str, v: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (n + v)); null for a language without kept terms."""
    whole = f"cast(1 + {count} as decimal(20,0)) * {UNIT}bd"
    return F.expr(f"case when {n} + {v} > 0 then 1 + ({whole}) div cast({n} + {v} as decimal(20,0)) end")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), exact in longs: prices are at most UNIT + 1."""
    return (p - q) * (p - q) // q


def joint_cells(left: tuple, right: tuple, n_cols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(column, column, terms) of the nonzero cells of one indicator block's transpose times another.

    Each block is (term, column) of its nonzero entries, sorted by term.  A term's row meets the same
    term's row in the other block; equal cells are counted, some millions of products at a time.
    """
    (t, c), (u, e) = left, right
    start, end = np.searchsorted(u, t), np.searchsorted(u, t, "right")
    width = end - start
    done = np.cumsum(width)
    at = 0
    while at < len(t):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _PRODUCTS, "right")))
        w = width[at:stop]
        own = np.repeat(np.arange(at, stop), w)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(w) - w, w)
        code, n = np.unique(c[own] * n_cols + e[start[own] + nth], return_counts=True)
        yield code // n_cols, code % n_cols, n
        at = stop


def price_block(source: np.ndarray, term: np.ndarray, level: np.ndarray, price: np.ndarray, block: np.ndarray,
                zero: np.ndarray, base: int) -> np.ndarray:
    """Ordered pairs' sums of f over a shard's terms: entry [g, h] for the groups g and h.

    ``source``, ``term``, ``level`` and ``price`` are the nonzero entries (group number, term number, count and
    its price); ``block`` is each group's block, ``zero`` its price of count 0; ``base`` times
    f(0, 0) is added.  If the groups are of two blocks, pairs within one are left 0.
    """
    out = base * divergence(zero[:, None], zero[None, :])
    columns, first, column, terms = np.unique(np.stack((source, level), axis=1), axis=0, return_index=True,
                                              return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    owner, value = columns[:, 0] if len(columns) else np.zeros(0, dtype=np.int64), price[first]
    # the margins: level a against 0, both ways
    for at in range(0, len(owner), 4096):
        o, p, n = owner[at:at + 4096], value[at:at + 4096, None], terms[at:at + 4096, None]
        none = divergence(zero[:, None], zero[None, :])
        np.add.at(out, o, n * (divergence(p, zero[None, :]) - none[o]))
        np.add.at(out.T, o, n * (divergence(zero[None, :], p) - none.T[o]))
    order = np.argsort(term, kind="stable")
    term, column, side = term[order], column[order], block[source[order]]
    low, both = side == block[0], (block != block[0]).any()
    parts = ((term[low], column[low]), (term[~low], column[~low])) if both else ((term, column), (term, column))
    for a, b, n in joint_cells(*parts, max(1, len(owner))):
        if not both:  # each unordered pair of groups once
            once = owner[a] < owner[b]
            a, b, n = a[once], b[once], n[once]
        i, j, p, q = owner[a], owner[b], value[a], value[b]
        for x, y, r, s in ((i, j, p, q), (j, i, q, p)):
            cell = divergence(r, s) - divergence(r, zero[y]) - divergence(zero[x], s) + divergence(zero[x], zero[y])
            np.add.at(out, (x, y), n * cell)
    if both:
        out[block[:, None] == block[None, :]] = 0
    np.fill_diagonal(out, 0)
    return out


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources.

    ``cells`` has (lang, source, term, count, price) of counts above 0 with the groups' columns; ``groups``
    (lang, source, v, zero, block, blocks, shards).  A block of a language's groups meets every other
    (and itself) on every shard of the terms: bounded work a task, whatever the number of sources.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    two = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard")
    rows = (cells.select("lang", shard, "source", "term", "count", "price", "block", other)
            .select("lang", "shard", *two, "source", "term", "count", "price"))
    sides = (groups.select("lang", "source", "v", "zero", "block", "shards", other)
             .select("lang", "source", "v", "zero", "block", *two,
                     F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    key = ["lang", "shard", "i", "j"]

    def meet(entries: pa.Table, sides_: pa.Table) -> pa.Table:
        names = sides_.column("source").to_pylist()
        block = sides_.column("block").to_numpy()
        zero = np.array([z or 1 for z in sides_.column("zero").to_pylist()], dtype=np.int64)
        base = sides_.column("v")[0].as_py() if sides_.column("shard")[0].as_py() == 0 else 0
        number = {s: k for k, s in enumerate(names)}
        codes = entries.column("source").combine_chunks().dictionary_encode()
        source = np.array([number[s] for s in codes.dictionary.to_pylist()], dtype=np.int64)[codes.indices.to_numpy()]
        term = entries.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        value = price_block(source, term, entries.column("count").to_numpy(), entries.column("price").to_numpy(),
                            block, zero, base)
        i, j = sides_.column("i")[0].as_py(), sides_.column("j")[0].as_py()
        x, y = np.nonzero((block[:, None] != block[None, :]) | (i == j))
        x, y = x[x != y], y[x != y]
        lang = sides_.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * len(x), pa.string()), pa.array([names[k] for k in x.tolist()], pa.string()),
                         pa.array([names[k] for k in y.tolist()], pa.string()), pa.array(value[x, y], pa.int64())],
                        schema=schema)

    # entries always have a side: every group is at every shard of its language
    partial = rows.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(
        meet, "lang string, source string, item string, value long")
    total = F.sum(F.col("value").cast("decimal(20,0)")).cast("long")
    return partial.groupBy("lang", "source", "item").agg(total.alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language departs from its others.

    Terms are runs of letters (A-Z folded) and non-ASCII characters; a language keeps those in at least ``least_docs`` of
    its documents, V in number.  A group's price of a count is p = 1 + floor(UNIT * (count + 1) / (N + V)),
    N the group's occurrences of kept terms, and two prices diverge by floor((p - q)^2 / q).
    Part ``pair`` has for every two sources of a language, in both orders, the sum over all kept terms
    (0 if there are none), ranked; part ``term`` a source's ``top_terms`` kept terms that it uses more
    than its language as a whole, by their divergence from the language's price.  Ties rank by item, in UTF-8 order.

    A null language, source or text is the empty string; an empty text adds its group without terms;
    repeated rows are documents of their own; a language's only source has no pairs; an empty table
    gives an empty result; columns other than the three named are ignored.  A task holds the distinct
    terms of one text and some 200,000 counts.
    """
    frame = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in
                          ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = written(term_counts(frame))
    kept = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"))
            .where(F.col("docs") >= least_docs).select("lang", "term", "total"))
    cells = written(counts.select("lang", "source", "term", "count").join(kept, ["lang", "term"]))
    langs = (cells.select("lang", "term", "total").distinct().groupBy("lang")
             .agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n")))
    sizes = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = (frame.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left"))
    langs = (groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left")
             .select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
                     F.ceil(F.col("sources") / GROUPS).cast("int").alias("blocks")))
    groups = written(
        join_salted(groups.withColumn("n", F.coalesce("n", F.lit(0))), langs, "lang", F.col("source"))
        .select("lang", "source", "n", "v", "lang_n", "blocks",
                F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int").alias("shards"),
                F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
                F.expr("0L").alias("none"))
        .withColumn("zero", _price("none", "n", "v")).drop("none"))
    priced = written(join_salted(cells, groups, ["lang", "source"], F.col("term"))
                     .withColumns({"price": _price("count", "n", "v"), "whole": _price("total", "lang_n", "v")}))
    pairs = pair_values(priced, groups)
    terms = (priced.where("price > whole")
             .select("lang", "source", F.col("term").alias("item"),
                     F.expr("((price - whole) * (price - whole)) div whole").alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = lambda df: df.withColumn("rank", F.row_number().over(best))
    both = (rank(pairs).withColumn("part", F.lit("pair"))
            .unionByName(rank(terms).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
