import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tally.llm import html_extract
from tally.llm.html_extract import INSIDE, OUTSIDE, all_lines, common_lines, extract, furniture, lines_of, main_text
from tests.llm.common import DATA, empty_like


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize("page,want", [
    (None, []), ("", []), ("<p>a<b>x</b> &lt;b&gt; &#8217; 5 < 6<p>b", [(0, "ax <b> ’ 5 < 6"), (0, "b")]),
    ('<nav>m</nav><div class="post comment-list"><p>c</p></div><div id=x><p class="ad">z<p>keep</div><p>last'
     "<script>if(a<b)</script>", [(0, "keep"), (0, "last")]),
    ("<article><h1>T</h1><aside>s</aside><p>x<br>y</p></article><p>after", [(1, "T"), (1, "x y"), (0, "after")]),
    ('<div title="a>b">t</div>', [(0, "t")]), ("<!-- <p>no</p> --><p>&amp&copy x&nbsp;y", [(0, "&© x y")]),
    ("<style>p{}</style><title>t</title><form>f</form><header>h</header><footer>g", []),
    ("<article><header><h1>T</h1></header>x", [(1, "T"), (1, "x")]), ("<script>never closed <p>x", []),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", [(0, "a"), (0, "b"), (0, "c"), (0, "d")]),
])
def test_lines(page, want):
    assert lines_of(page) == want


@pytest.mark.parametrize("cells", [1 << 29, 20])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "_CELLS", cells)
    rnd = random.Random(1)
    for _ in range(600):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 14))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(common_lines(a, b))
        assert len(found) == table[-1][-1]
        rest = iter(b)
        assert all(any(y == a[i] for y in rest) for i in found)


def template(path, body, host="h.org"):
    return f"http://{host}{path}", f"<div>Top line</div><div>{body}</div><div>Bottom</div>"


def test_nearest_url_differencing(spark):
    """Template lines go; the partner is the page of the host whose path is nearest."""
    rows = [(1, *template("/a/1", "one")), (2, *template("/a/2", "two")), (3, "http://h.org/b/1", "<div>Top line</div><p>three"),
            (4, *template("/a/1", "alone", "other.org")), (5, None, "<p>x<p>y"), (6, "no scheme", "<p>y<p>z"), (7, "http://h.org/c", None),
            (None, "http://h.org/z", "<p>q"), (8, *template("/a/2", "two")), (8, *template("/a/2", "two"))]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, host string, run int")
    for n in (1, 4, 9):
        got = sorted(((r.page_id, r.text) for r in extract(df, partitions=n).collect()), key=repr)
        want = {1: "one", 2: None, 3: "three", 4: "Top line\nalone\nBottom", 5: "x", 6: "z", 7: "", None: "q"}
        assert len(got) == len(rows)
        for k, text in got:
            if want.get(k) is not None:
                assert text == want[k], (n, k, text)
            elif k in (2, 8):  # equal pages beside each other: everything is shared, or all but the body
                assert text in ("", "two")
    assert extract(empty_like(df)).count() == 0


def test_partitions_do_not_matter(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(120).select(
        "page_id", "url", F.regexp_replace("html", "</?article>", "").alias("html"))
    runs = [sorted(map(tuple, extract(pages, partitions=n).collect())) for n in (1, 3, 40)]
    assert runs[0] == runs[1] == runs[2] and any(r[3] for r in runs[0])


def test_very_long_page(spark):
    page = "<p>" + "<p>".join(f"line {i % 50}" for i in range(20000))
    df = spark.createDataFrame([(1, "http://a.b/1", page), (2, "http://a.b/2", page + "<p>more")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {1: "", 2: "more"}
    assert {w for w, _ in lines_of("<main><p>a</main><p>b")} == {INSIDE, OUTSIDE}


@pytest.mark.parametrize("wrapper", ["div id=page class='has-sidebar'", "div class='no-sidebar wide'", 'div class="navbar-fixed"',
                                     "div class=menu-open", "div id=search", "form action=/x", "div class='content-sidebar-wrap'"])
def test_a_marked_wrapper_keeps_its_article(wrapper):
    page = f"<body><{wrapper}><nav>m</nav><article><p>x</p><div class='ad'>a</div></article></{wrapper.split()[0]}></body>"
    assert [t for w, t in lines_of(page) if w == INSIDE] == ["x"]


@pytest.mark.parametrize("page,want", [
    ("<aside><article>teaser</article></aside><p>x", [(0, "x")]), ("<footer><main>m</main></footer><p>x", [(0, "x")]),
    ("<template><article>t</article></template><p>x", [(0, "x")]),
    ("<article><p>x</p><div class=comments><article>c</article></div></article>", [(1, "x")]),
    ("<main><form><article>y</article></form></main>", [(1, "y")]),
    ("<div class='site-footer'>f</div><div class=ad-slot-2>a</div><div class=sidebar__inner>s</div><p>x", [(0, "x")]),
    ("<div class=has-sidebar><p>x</div><div class=menu-open><p>y</div>", [(0, "x"), (0, "y")]),
])
def test_marks(page, want):
    assert lines_of(page) == want


def test_differencing_decides_where_structure_leaves_nothing(spark):
    page = "<form><p>Top line<p>{}<p>Bottom</form>"
    rows = [(1, "http://h.org/a", page.format("one")), (2, "http://h.org/b", page.format("two")),
            (3, "http://o.org/a", "<nav>Menu</nav><form><p>three</form>"), (4, "http://o.org/b", "<nav>Menu</nav><p>four")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {1: "one", 2: "two", 3: "three", 4: "four"}


def test_deeply_nested_pages_are_linear():
    """Many unclosed elements and as many end tags of none: time in proportion to the page."""
    import time

    def seconds(n):
        page = "<div>" * n + "<article><p>text</p></article>" + "</span></section>" * n
        began = time.perf_counter()
        assert main_text(all_lines(page), None) == "text"
        return time.perf_counter() - began

    seconds(1000)
    small, large = min(seconds(4000) for _ in range(3)), min(seconds(64000) for _ in range(3))
    assert large < 16 * 6 * small + 0.5


def article(path, *lines):
    return f"http://h.org{path}", "<nav>Menu</nav><article>" + "".join(f"<p>{x}" for x in lines) + "</article><footer>f"


def test_differencing_decides_pages_with_an_article(spark):
    """Short runs that both neighbours share are template; copies of articles and text of one neighbour stay."""
    body = {k: [f"{k} says {w} " * 9 for w in ("this", "that", "more")] for k in "abcdefgh"}
    top, ad, end = "By our staff", "Advertisement", "Subscribe to our letter"
    full = {1: ("/a/1", top, *body["a"], end), 2: ("/a/2", top, body["b"][0], ad, *body["b"][1:], end),
            3: ("/a/3", top, body["c"][0], ad, *body["c"][1:], end), 4: ("/a/4", top, body["d"][0], ad, *body["d"][1:], end),
            5: ("/c/1", "Of one pair", *body["e"]), 6: ("/c/2", "Of one pair", *body["f"]),
            7: ("/d/1", top, *body["g"], end), 8: ("/d/2", top, *body["g"], end), 9: ("/d/3", top, *body["h"], end)}
    df = spark.createDataFrame([(k, *article(*v)) for k, v in full.items()], "page_id long, url string, html string")
    want = {k: list(v[1:]) for k, v in full.items()}
    want[2] = [x for x in want[2] if x not in (top, end)]  # page 1 has no advertisement
    want[3] = body["c"]  # all three stand in pages 2 and 4
    for n in (1, 3, 8):
        assert {r.page_id: r.text.split("\n") for r in extract(df, partitions=n).collect()} == {
            k: [" ".join(x.split()) for x in v] for k, v in want.items()}


def test_article_pages_are_paired_with_both_neighbours_of_their_host(spark):
    """Against a plain loop over all pages in path order."""
    rnd = random.Random(5)
    rows = []
    for k in range(150):
        body = [f"text {rnd.random()} of some length {rnd.random()}" * 2 for _ in range(rnd.randint(0, 4))]
        lines = [rnd.choice(("Read on", "Share this", "Tags")) for _ in range(rnd.randint(0, 2))] + body + ["The end"] * rnd.randint(0, 1)
        rows.append((k, f"http://h{k % 4}.org/{rnd.choice('xy')}/{rnd.randint(0, 400):04d}", "<article><p>" + "<p>".join(lines) + "</article>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string"), partitions=5).collect()}
    pages = sorted(((u.split("/")[2], u.split("/", 3)[3], k, [t for _, t in all_lines(h)]) for k, u, h in rows))
    cut = 0
    for i, (host, _, k, mine) in enumerate(pages):
        near = [pages[j][3] for j in (i - 1, i + 1) if 0 <= j < len(pages) and pages[j][0] == host]
        gone = furniture(mine, near)
        cut += len(gone)
        assert got[k] == "\n".join(t for j, t in enumerate(mine) if j not in gone)
    assert cut > 5
