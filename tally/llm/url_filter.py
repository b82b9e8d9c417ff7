"""URL verdicts: ordered path rules, then exact list membership by a Bloom filter cascade.

The cascade (levels of Bloom filters, as in CRLite) is built against the complete
key universe of the corpus.  Level 1 holds the listed keys; level 2 the corpus keys
that level 1 wrongly accepts; level 3 the listed keys that level 2 wrongly accepts;
and so on until a level has no false positive.  A key of the universe is listed iff
the first level that rejects it has an even number (or, if none does, iff the number
of levels is odd), so that membership is exact and needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import ascii_lower, written

#: Words that name an unwanted site, as a part of one of its labels ('casino-win.example.org').
UNWANTED = (
    "ad", "ads", "adult", "adware", "bet", "bets", "betting", "bingo", "casino", "click", "clickbait", "escort", "gambling",
    "jackpot", "lottery", "malware", "payday", "phishing", "pills", "poker", "popup", "porn", "replica", "scam", "slots",
    "spam", "spyware", "torrent", "viagra", "warez", "webcam", "xxx",
)
#: Largest filter (all levels) that goes into a plan as a literal.
MAX_FILTER_BYTES = 8 << 20


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    ``rules`` holds (verdict, host, path prefix); a rule fits its host and all
    subdomains if the path starts with the prefix.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rhost, rpath in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        rule = F.when(fits, F.lit(rhost + rpath)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, of at most ``most`` labels."""
    last = F.substring_index(host, ".", -most)  # cuts a host of very many labels first
    labels = F.split(last, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.concat_ws(".", F.slice(labels, k, n)))


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    data: bytes

    def accepts(self, key: Column) -> Column:
        hit = F.lit(True)
        for p in _positions(key, self.number, self.bits, self.hashes):
            byte = F.conv(F.hex(F.substring(F.lit(self.data), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10)
            hit = hit & (F.getbit(byte.cast("int"), (p % 8).cast("int")) == 1)
        return hit


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(bits).cast("long")) for j in range(hashes)]


def _level(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """A Bloom filter over ``keys`` with about the given false positive rate."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))
    places = F.explode(F.array(*[p + 1 for p in _positions(F.col("key"), number, bits, hashes)]))
    maps = (keys.select(places.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    data = bytearray((bits + 7) // 8)
    for bucket, part in maps.collect():  # the filter itself, in Spark's bitmaps of 4096 bytes
        at = (bucket - 1) * 4096
        room = len(data) - at
        data[at:at + 4096] = part[:room]
    return Level(number, bits, hashes, bytes(data))


def cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> list[Level] | None:
    """Build the levels from two frames with a string column ``key``.

    None if the first level alone would exceed ``max_bytes``: the caller then
    uses an equi-join.  Null keys are left out.
    """
    flagged = (listed.select("key", F.lit(1).alias("l"), F.lit(0).alias("c"))
               .unionByName(universe.select("key", F.lit(0).alias("l"), F.lit(1).alias("c")))
               .where("key is not null").groupBy("key").agg(F.max("l").alias("l"), F.max("c").alias("c")))
    flagged = written(flagged.where("c = 1"))
    r, s = flagged.agg(F.count(F.when(F.col("l") == 1, 1)), F.count(F.when(F.col("l") == 0, 1))).first()
    inside = flagged.where("l = 1").select("key")
    outside = flagged.where("l = 0").select("key")
    levels: list[Level] = []
    rate = min(0.5, r * math.sqrt(0.5) / s) if s else 0.5
    n = r
    while n:
        if -n * math.log(rate) / math.log(2) ** 2 > 8 * max_bytes:
            return None
        level = _level(inside, len(levels) + 1, n, rate)
        levels.append(level)
        wrong = written(outside.where(level.accepts(F.col("key"))))
        n, rate = wrong.count(), 0.5
        inside, outside = wrong, inside
    return levels


def listed_by(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.accepts(key), out).otherwise(F.lit(level.number % 2 == 0))
    return out


def unwanted_domains(hosts: DataFrame, words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(key): the domains of ``hosts`` (column host) that a word names, each from the label that holds it.

    A label holds a word if one of its parts between hyphens is the word: the list follows the corpus, a
    domain a site, whatever its subdomains.
    """
    labels = F.split("host", r"\.")
    named = F.transform(labels, lambda x: F.arrays_overlap(F.split(x, "-"), F.array(*[F.lit(w) for w in words])))
    first = F.array_position(named, F.lit(True)).cast("int")
    return (hosts.select("host").distinct().withColumns({"labels": labels, "first": first}).where("first > 0")
            .select(F.concat_ws(".", F.slice("labels", F.col("first"), F.size("labels"))).alias("key")).distinct())


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], blocklist: DataFrame | list[str] | tuple | None = None,
               url_col: str = "url", keep: list[str] = (), max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Host, path, rule and verdict of every row's URL.

    The verdict is that of the longest fitting rule, else ``block`` if the host or a
    parent domain is in ``blocklist`` (a list or a frame with a column ``key``; without one the
    domains of the pages that ``unwanted_domains`` finds), else ``allow``.  The corpus's universe (all domains of its hosts, of at most as many
    labels as the longest listed one) is gathered by Spark; the filters, whose size
    follows the list and not the corpus, are plan literals of at most ``max_bytes``;
    a list beyond that is met by an equi-join on the exact key.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is
    allowed.  Repeated rows are judged each; an empty table gives an empty result;
    columns beyond ``url_col`` and ``keep`` are ignored.
    """
    spark = pages.sparkSession
    hosts = pages.select(url_host(F.col(f"`{url_col}`")).alias("host")).distinct()
    if blocklist is None:
        blocklist = written(unwanted_domains(hosts))
    elif not isinstance(blocklist, DataFrame):
        blocklist = spark.createDataFrame([(x.lower(),) for x in blocklist], "key string")
    listed = blocklist.select("key").where("key <> ''").distinct()
    most = listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1
    frame = pages.select(*[F.col(f"`{c}`") for c in keep], url_host(F.col(f"`{url_col}`")).alias("host"),
                         url_path(F.col(f"`{url_col}`")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    frame = frame.withColumns({"rule": rule, "verdict": verdict})
    universe = hosts.select(F.explode(domain_suffixes(F.col("host"), most)).alias("key"))
    levels = cascade(listed, universe, max_bytes)
    if levels is None:
        return _judged_by_join(frame, listed, most)
    hit = F.exists(domain_suffixes(F.col("host"), most), lambda d: listed_by(levels, d))
    return frame.withColumn("verdict", F.coalesce("verdict", F.when(hit, "block").otherwise("allow")))


def _judged_by_join(frame: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """For lists beyond the filter's bound: blocked hosts by an equi-join."""
    blocked = (frame.select("host").distinct()
               .select("host", F.explode(domain_suffixes(F.col("host"), most)).alias("key"))
               .join(listed, "key").select("host", F.lit("block").alias("by_list")).distinct())
    return (frame.join(blocked, "host", "left")
            .withColumn("verdict", F.coalesce("verdict", "by_list", F.lit("allow"))).drop("by_list")
            .select(*frame.columns))
