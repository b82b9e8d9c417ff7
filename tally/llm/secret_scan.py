"""Secret detection and corpus-wide ownership, in Spark SQL functions only.

Every text is scanned once for candidates (the base kinds and some vendor formats).
The candidates' value hashes are then counted over the whole corpus by distinct
repository and distinct owner.  A value that many owners hold is a widely copied
example; a value of few owners is a live-looking credential of theirs.  Each
candidate adds a span of its verdict (``live`` or ``example``) to those of its kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import join_salted, written

_KEY = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: ``group`` holds the value; ``least`` is its least length.

    ``gates`` are strings (of the lower-cased text if ``folded``) of which a text must
    hold one for a match to be possible.
    """
    name: str
    pattern: str
    group: int = 0
    least: int = 1
    gates: tuple[str, ...] = ()
    folded: bool = False


#: The base kinds, in their order.
BASE = (
    Kind("assign", _KEY, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),  # a run below the least length never matches
)
#: Formats beyond the base, each with its issuer's prefix.
VENDOR = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Kind("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39, ("AIza",)),
    Kind("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}", 0, 24, ("k_live_",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20, ("eyJ",)),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY",)),
)
#: A value of more owners than this is a copied example.
MOST_OWNERS = 2

_STEPS = "array<struct<rank:int,gap:int,len:int,value:string>>"


def _steps(text: Column, kind: Kind, rank: int) -> Column:
    """A kind's matches in order: (rank, length of the gap before, length, value hash or null if too short).

    The matches and the gaps that ``split`` leaves between them add up to the text,
    which gives the places, in code points.
    """
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(whole))
    steps = F.zip_with(F.arrays_zip(gaps.alias("gap"), whole.alias("whole")), value, lambda gw, v: F.struct(
        F.lit(rank).alias("rank"), F.length(gw["gap"]).alias("gap"), F.length(gw["whole"]).alias("len"),
        F.when(F.length(v) >= kind.least, F.sha2(v, 256)).alias("value")))
    if kind.gates:
        held = F.lit(False)
        for g in kind.gates:
            held = held | F.contains(F.lower(text) if kind.folded else text, F.lit(g))
    else:
        held = text.rlike(kind.pattern)
    return F.when(held, steps).otherwise(F.array().cast(_STEPS))


def _span_list(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of an array of (start, rank, end), sorted and joined."""
    named = F.array(*[F.lit(n) for n in names])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(named, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _names(kinds: tuple[Kind, ...]) -> list[str]:
    return [k.name for k in kinds] + ["live", "example"]


def candidates(docs: DataFrame, repo_col: str, owner_col: str, text_col: str, id_col: str,
               kinds: tuple[Kind, ...]) -> DataFrame:
    """Per row of ``docs``: its number, key, id, repository, owner and the steps of its matches.

    The key is a hash of id, repository, owner and text: rows that agree in all of them
    have the same candidates and the same verdicts.
    """
    frame = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in
                          ((id_col, "id"), (repo_col, "repo"), (owner_col, "owner"), (text_col, "text"))])
    text = F.coalesce("text", F.lit(""))
    steps = F.flatten(F.array(*[_steps(text, k, i) for i, k in enumerate(kinds)]))
    return frame.select(F.monotonically_increasing_id().alias("row"),
                        row_key(F.col("id"), F.col("repo"), F.col("owner"), F.col("text")).alias("key"),
                        "id", F.col("repo").cast("string").alias("repo"), F.col("owner").cast("string").alias("owner"),
                        steps.alias("steps"))


def spans_of(found: DataFrame) -> DataFrame:
    """(row, key, repo, owner, start, rank, end, value) of the written candidates.

    Running sums over a row's steps of a kind give the places: time in proportion to the matches, however
    many a text holds.  Matches are shuffled, texts are not.
    """
    each = (found.where(F.size("steps") > 0).select("row", "key", "repo", "owner", F.posexplode("steps").alias("place", "s"))
            .select("row", "key", "repo", "owner", "place", "s.*"))
    so_far = Window.partitionBy("row", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).where(F.col("value").isNotNull())
            .select("row", "key", "repo", "owner", (F.col("end") - F.col("len")).alias("start"), "rank", "end", "value"))


def row_key(id_: Column, repo: Column, owner: Column, text: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in (id_, repo, owner)], F.sha2(text, 256))), 256)


def verdicts(spans: DataFrame, most_owners: int) -> DataFrame:
    """The spans with their value's distinct owners and repositories, and whether it is ``live``.

    Owners and repositories are distinct per value, also a repository of several owners; they are
    aggregated map-side per (value, owner) and (value, repository) and shuffled by those, so a
    value that a third of all rows hold spreads over the tasks; in the join back
    to the candidates its rows are salted.  Owners alone decide: the copies that one
    owner keeps in many repositories are its own.
    """
    owners = spans.groupBy("value").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))
    return join_salted(spans, owners, "value", F.col("row")).withColumn("live", F.col("n_owners") <= most_owners)


def scan_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text",
                 id_col: str = "doc_id", vendor: tuple[Kind, ...] = VENDOR,
                 most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row per row of ``docs``: id, counts per base kind, base digest, all spans, verdicts.

    ``spans`` joins ``kind:start:end`` of all spans by start, then kind: the base kinds,
    the vendor formats and, for each candidate, ``live`` or ``example`` over the same
    interval.  ``n_live`` and ``n_example`` count those, ``max_owners`` and ``max_repos``
    are the largest numbers of distinct owners and repositories of a candidate's value
    (0 without any).

    A null text is empty and has no spans; a null repository or owner counts as no
    repository or owner; repeated rows are answered each; an empty table gives an empty
    result; columns other than the four named are ignored.  The text is read once and
    never shuffled: the scan's candidates are written to the checkpoint folder.
    """
    kinds = BASE + tuple(vendor)
    names = _names(kinds)
    found = written(candidates(docs, repo_col, owner_col, text_col, id_col, kinds))
    spans = written(spans_of(found))
    judged = verdicts(spans, most_owners)
    verdict = F.when(F.col("live"), F.lit(len(kinds))).otherwise(F.lit(len(kinds) + 1)).alias("rank")
    # a verdict over the same interval counts once, whatever the number of kinds
    added = judged.groupBy("row", "start", verdict, "end").agg(F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    both = (spans.select("row", "start", "rank", "end", F.lit(None).cast("long").alias("n_owners"), F.lit(None).cast("long").alias("n_repos"))
            .unionByName(added))
    place = F.struct("start", "rank", "end")
    count = lambda k: F.count_if(F.col("rank") == k)
    per_row = both.groupBy("row").agg(
        F.collect_list(place).alias("spans"), F.collect_list(F.when(F.col("rank") < len(BASE), place)).alias("base"),
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)],
        count(len(kinds)).alias("n_live"), count(len(kinds) + 1).alias("n_example"),
        F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    joined = found.select("row", "id").join(per_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("id").alias(id_col), *[zero(f"n_{k.name}") for k in BASE],
        F.sha2(_span_list(F.coalesce("base", none), names), 256).alias("base_sha256"),
        _span_list(F.coalesce("spans", none), names).alias("spans"),
        *[zero(c) for c in ("n_live", "n_example", "max_owners", "max_repos")])


#: Code points of a text that are masked together.
MASKED = 4096


def _masks(live: DataFrame) -> DataFrame:
    """(__key, __masks): what to mask in each run of MASKED code points of a text, one array entry a run.

    Overlapping intervals become one; an entry is an array of (first, last, begins), places within
    the run, first and last excluded at 0 and the run's end, and whether the mask itself stands there.
    """
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") >= before)).cast("int")
    merged = (live.select("key", "start", "end").distinct().withColumn("opens", opens)
              .withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .groupBy("key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    cut = lambda c: F.expr(f"cast(({c}) div {MASKED} as int)")
    pieces = (merged.withColumn("run", F.explode(F.sequence(cut("start"), cut("end - 1"))))
              .select("key", "run", F.struct(
                  F.greatest(F.lit(0), F.col("start") - F.col("run") * MASKED).cast("int").alias("first"),
                  F.least(F.lit(MASKED), F.col("end") - F.col("run") * MASKED).cast("int").alias("last"),
                  (F.col("start") >= F.col("run") * MASKED).alias("begins")).alias("piece")))
    # runs without a mask, up to the last one with any, have an empty entry
    runs = (merged.groupBy("key").agg(F.max(cut("end - 1")).alias("most"))
            .select("key", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("run")))
    each = (pieces.unionByName(runs.withColumn("piece", F.lit(None).cast(pieces.schema["piece"].dataType)))
            .groupBy("key", "run").agg(F.array_sort(F.collect_list("piece")).alias("pieces")))
    return each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run", "pieces"))).alias("runs")).select(
        F.col("key").alias("__key"), F.transform("runs", lambda r: r["pieces"]).alias("__masks"))


def _masked(text: Column, masks: Column, mask: str) -> Column:
    """The text with its masks, run by run: no step copies more than a run."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MASKED}}}"), F.lit(0))

    def cover(run: Column, pieces: Column) -> Column:
        done = F.aggregate(
            pieces, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, p: F.struct(p["last"].alias("at"), F.concat(
                acc["out"], F.substring(run, acc["at"] + 1, p["first"] - acc["at"]),
                F.when(p["begins"], F.lit(mask)).otherwise(F.lit(""))).alias("out")),
            lambda acc: F.concat(acc["out"], F.substring(run, acc["at"] + 1, F.lit(MASKED))))
        return F.when(F.coalesce(F.size(pieces), F.lit(0)) > 0, done).otherwise(run)

    return F.array_join(F.zip_with(runs, masks, lambda r, p: cover(r, p)), "")


def redact(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text",
           id_col: str = "doc_id", mask: str = "[SECRET]", vendor: tuple[Kind, ...] = VENDOR,
           most_owners: int = MOST_OWNERS) -> DataFrame:
    """``docs`` with the live-looking credentials in ``text_col`` masked; no row is dropped.

    Overlapping live spans are masked as one; copied examples stay.  Only rows with
    live spans meet their verdicts by a join on the row key; all columns and the row count stay.
    """
    kinds = BASE + tuple(vendor)
    found = written(candidates(docs, repo_col, owner_col, text_col, id_col, kinds).where(F.size("steps") > 0))
    live = written(_masks(verdicts(spans_of(found), most_owners).where("live")))
    col = lambda c: F.col(f"`{c}`")
    text = col(text_col)
    suspect = F.lit(False)
    for k in kinds:  # a cheap superset of the rows with candidates, decided without a shuffle
        suspect = suspect | (F.lower(text) if k.folded else text).rlike("|".join(k.gates) if k.gates else k.pattern)
    suspect = F.coalesce(suspect, F.lit(False))
    rest = docs.where(~suspect)
    keyed = docs.where(suspect).withColumn("__key", row_key(col(id_col), col(repo_col), col(owner_col), text))
    masked = (keyed.join(live, "__key", "left")
              .withColumn(text_col, F.when(F.col("__masks").isNotNull(), _masked(text, F.col("__masks"), mask)).otherwise(text)))
    return rest.unionByName(masked.select(*[col(c) for c in docs.columns]))
