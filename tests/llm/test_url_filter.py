from tally.llm.queries import URL_RULES
from tally.llm.url_filter import UNWANTED, cascade, judge_urls, listed_by, unwanted_domains
from tests.llm.common import empty_like
from pyspark.sql import functions as F

URLS = [
    None, "", "no scheme", "http://", "https://A.COM", "http://a.com/", "http://www.example.com/en/x?y#z", "http://example.com/en/",
    "http://example.com/enx", "http://m.a.NET/es/1", "http://a.net/fr", "ftp://a.net/fr/", "http://cheap-pills.example.com.x/",
    "http://x.spam-farm.example.org/de/1", "http://spam-farm.example.org?q=://b", "http://É.org/é", "a://b://c/d", "http://a.com:80/",
    "http://" + "a." * 2000 + "com/p", "http://..com/x", "http://a.org/" + "p" * 20000, "http://ads-track.example.org#f",
    "http://blog.adult-x.example.net/", "http://adults.example.org/", "http://x.y.casino/", "http://my-poker-site.org/a", "http://bets.bets.org/",
]


def brute(url, names=None):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = lambda h: host == h or host.endswith("." + h)
    best = max(((len(h + p), h + p, v) for v, h, p in URL_RULES if fits(h) and path.startswith(p)), default=None)
    listed = any(w in UNWANTED for label in host.split(".") for w in label.split("-")) if names is None else any(map(fits, names))
    return host, path, best and best[1], best[2] if best else "block" if listed else "allow"


def pages(spark):
    rows = [(i, u, "k", "r", "h", "p") for i, u in enumerate(URLS)] + [(2, URLS[7], "k", "r", "h", "p"), (None, URLS[7], "", "", "", "")]
    return spark.createDataFrame(rows, "page_id long, url string, key string, rule string, host string, path string")


def test_against_brute_force(spark):
    df = pages(spark)
    got = sorted(map(tuple, judge_urls(df, URL_RULES, keep=["page_id"]).collect()), key=repr)
    want = sorted(((r.page_id, *brute(r.url)) for r in df.collect()), key=repr)
    assert got == want
    assert judge_urls(empty_like(df), URL_RULES, keep=["page_id"]).count() == 0
    # a list beyond the literal's bound is met by a join, with the same answer
    joined = sorted(map(tuple, judge_urls(df, URL_RULES, keep=["page_id"], max_bytes=0).collect()), key=repr)
    assert joined == want


def test_given_list(spark):
    names = ["spam-farm.example.org", "a.org", "com.x", "elsewhere.net"]
    df = pages(spark)
    want = sorted(((r.page_id, *brute(r.url, names)) for r in df.collect()), key=repr)
    for given in (names, spark.createDataFrame([(n,) for n in [*names, None, ""]], "key string")):
        got = sorted(map(tuple, judge_urls(df, URL_RULES, given, keep=["page_id"]).collect()), key=repr)
        assert got == want


def test_unwanted_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("m.adult-x.a.net", "adult-x.a.net", "a.net", "", "casino", "x.free-bets.org", "bets.spam.io")], "host string")
    assert {r.key for r in unwanted_domains(hosts).collect()} == {"adult-x.a.net", "casino", "free-bets.org", "bets.spam.io"}


def test_list_of_some_thousands(spark):
    """The filters decide for thousands of listed keys among as many pages."""
    df = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(
        F.lit("http://"), F.when(F.col("id") % 3 == 0, "casino-").otherwise("site-"), F.col("id").cast("string"), F.lit(".org/p")).alias("url"))
    got = judge_urls(df, URL_RULES, keep=["page_id"])
    assert got.where((F.col("verdict") == "block") != (F.col("page_id") % 3 == 0)).count() == 0
    assert unwanted_domains(got).count() == 3000


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("host"), "id").alias("key"))
    listed = universe.where("crc32(key) % 11 = 0").unionByName(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    levels = cascade(listed, universe)
    assert len(levels) > 2
    wrong = universe.where(listed_by(levels, F.col("key")) != (F.crc32("key") % 11 == 0))
    assert wrong.count() == 0
    assert cascade(listed, universe, max_bytes=10) is None
    assert cascade(listed.where("1 = 0"), universe) == []


def test_no_python_in_the_plan(spark):
    plan = judge_urls(pages(spark), URL_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
