"""Main text of web pages: structure first, then nearest-URL page differencing.

A page is read into text lines (its blocks), each marked by the element it stands
in.  Pages of a host are paired by URL path: of its two neighbours in path order a
page takes the one whose path shares the longer beginning.  The longest common
subsequence of the two pages' lines is template text, and deleted.  Lines in menus,
footers, adverts, forms, comments and the like are no main text, but an article within
a marked wrapper or a form is; where a page has an ``article`` or ``main`` element, only
lines within it are main text.  There, equal lines may be copies of an article, so a line
is template only if both neighbours share it (``furniture``).  Where structure leaves
nothing of a page, the differencing decides over all of its lines.
"""

from __future__ import annotations

import bisect
import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import session_partitions
from tally.llm.url_filter import url_host, url_path

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre
section summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style title textarea noscript template iframe svg math head object audio video canvas".split())
RAW = frozenset("script style title textarea".split())
#: Elements that are never main text.
CHROME = frozenset("nav aside footer form menu button select dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
#: Elements whose articles are no main text either.
CLOSED = frozenset("nav aside footer".split())
#: A word of a class, id or role that marks an element as no main text.
_MARK = re.compile(r"ad|ads|adv|advert\w*|banner|breadcrumbs?|comments?|respond|disqus|cookies?|consent|"
                   r"copyright|footer|menu|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|share|"
                   r"sharing|sidebar|social|sponsor\w*|subscribe|widget|complementary|contentinfo|search", re.I)
#: A mark names the element by itself ('ad'), as the last part of its name ('site-footer')
#: or before one of these ('comment-list'); 'navbar-fixed' and 'menu-open' tell its state.
_HOLDERS = frozenset("""area bar block body box button buttons container content form group holder icons inner item items
left link links list panel posts right row section slot text title top unit widget widgets wrap wrapper""".split())
#: First parts of a name that tell what a page has beside the text ('has-sidebar', 'content-sidebar-wrap').
_STATES = frozenset("has no with without is not show hide open close content main layout column columns col".split())
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")

OUTSIDE, INSIDE, DROPPED = 0, 1, 2


def _marks(name: str) -> bool:
    """Whether one class, id or role marks its element as no main text."""
    parts = [p for p in re.split("[-_]", name.lower()) if p]
    if not parts or parts[0] in _STATES:
        return False
    last = max((k for k, p in enumerate(parts) if _MARK.fullmatch(p)), default=None)
    return last is not None and all(p in _HOLDERS or p.isdigit() for p in parts[last + 1:])


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(where, text) of each block that may be main text, in page order.

    ``where`` is INSIDE for lines within an article or main element.  Character references are
    decoded, white space is one space, empty blocks are left out.
    """
    return [line for line in all_lines(page) if line[0] != DROPPED]


def all_lines(page: str | None) -> list[tuple[int, str]]:
    """(where, text) of each block: also, as DROPPED, what the structure calls no main text."""
    page = page or ""
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # (tag, dropped, in main, hidden, closed to articles)
    opened: dict[str, int] = {}  # how many elements of a tag the stack holds
    dropped = inside = hidden = closed = False
    quotes: dict[str, bool] = {}

    def flush() -> None:
        if buffer:
            if not hidden:
                text = " ".join("".join(buffer).split())
                if text:
                    out.append((DROPPED if dropped else INSIDE if inside else OUTSIDE, text))
            buffer.clear()

    def close(depth: int) -> None:
        nonlocal dropped, inside, hidden, closed
        flush()
        for e in stack[depth:]:
            opened[e[0]] -= 1
        del stack[depth:]
        dropped, inside, hidden, closed = stack[-1][1:] if stack else (False, False, False, False)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        text = page[at:lt] if lt >= 0 else page[at:]
        if text and not hidden:
            buffer.append(html_lib.unescape(text) if "&" in text else text)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith("<!", lt) or page.startswith("<?", lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        closing = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + closing)
        if not name:  # a bare '<' is text
            if not hidden:
                buffer.append("<")
            at = lt + 1
            continue
        tag = name[0].lower()
        end = page.find(">", name.end())
        for q in "\"'":  # a quoted attribute may hold '>'
            if 0 <= end and page.count(q, name.end(), end) % 2 and quotes.get(q, True):
                shut = page.find(q, end)
                quotes[q] = shut >= 0
                if shut >= 0:
                    end = page.find(">", shut)
        if end < 0:
            end = n
        attributes = page[name.end():end]
        at = end + 1
        if closing:
            if opened.get(tag):  # each step back closes an element: linear in the page
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            shut = re.compile(f"</{tag}", re.I).search(page, at)
            if not shut:
                at = n
            else:
                end = page.find(">", shut.end())
                at = end + 1 if end >= 0 else n
            continue
        block = tag in BLOCK
        if block:
            flush()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
        marked = tag in HIDDEN or tag in CHROME or (tag == "header" and not inside)
        if not marked and attributes and tag not in ("html", "body", "article", "main"):
            marked = any(_marks(name) for m in _ATTR.finditer(attributes) for name in m[1].strip("\"'").split())
        if block or marked or tag in HIDDEN:
            if marked and not block:
                flush()
            # a wrapper's mark ends at an article; one within an article and a marked part of it is a comment
            regained = tag in MAIN and not closed and not hidden and not opened.get("article")
            dropped = marked or dropped and not regained
            inside, hidden, closed = inside or tag in MAIN, hidden or tag in HIDDEN, closed or tag in CLOSED
            stack.append((tag, dropped, inside, hidden, closed))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


# --- longest common subsequence ------------------------------------------------------

_CELLS = 1 << 29  # bits of rows held at once; larger problems are halved


def _rows(a: list[int], where: dict[int, int], width: int, keep: bool) -> list[int]:
    """Bit rows of the dynamic programme: zero bits of row i mark the steps of LCS(a[:i], b)."""
    row = full = (1 << width) - 1
    rows = [row]
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _places(b: list[int]) -> dict[int, int]:
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    out = {}
    for x, js in at.items():
        data = bytearray(js[-1] // 8 + 1)
        for j in js:
            data[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(data, "little")
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Indices of ``a`` in one longest common subsequence of ``a`` and ``b``."""
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a -= 1
        high_b -= 1
    found = set(range(low)) | set(range(high_a, len(a)))
    shared = set(a[low:high_a]) & set(b[low:high_b])
    codes = {x: k for k, x in enumerate(shared)}
    ia = [i for i in range(low, high_a) if a[i] in codes]
    cb = [codes[x] for x in b[low:high_b] if x in codes]
    todo = [(0, len(ia), 0, len(cb))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        part, other = [codes[a[i]] for i in ia[i0:i1]], cb[j0:j1]
        if n == 1:
            if part[0] in other:
                found.add(ia[i0])
            continue
        if n * m > _CELLS:  # halve a, find where the best alignment cuts b
            half = n // 2
            ahead = _rows(part[:half], _places(other), m, False)[0]
            behind = _rows(part[half:][::-1], _places(other[::-1]), m, False)[0]
            fore, back = [0] * (m + 1), [0] * (m + 1)
            for j in range(m):
                fore[j + 1] = fore[j] + (not ahead >> j & 1)
                back[j + 1] = back[j] + (not behind >> j & 1)
            cut = max(range(m + 1), key=lambda j: fore[j] + back[m - j])
            todo += [(i0, i0 + half, j0, j0 + cut), (i0 + half, i1, j0 + cut, j1)]
            continue
        rows = _rows(part, _places(other), m, True)
        i, j = n, m
        while i and j:
            mask = (1 << j) - 1
            steps = ~rows[i] & mask
            if steps.bit_count() == (~rows[i - 1] & mask).bit_count():
                i -= 1
            else:
                found.add(ia[i0 + i - 1])
                j = steps.bit_length() - 1
                i -= 1
    return found


#: An article that shares more than one in COPY of its characters with another is a copy of it; a run of
#: shared lines is furniture if it holds at most one in SHORT of an article's characters.
COPY, SHORT = 2, 10


def _chars(lines: list[str]) -> int:
    return sum(map(len, lines))


def furniture(article: list[str], others: list[list[str]]) -> set[int]:
    """Indices of the article's lines that belong to the template of its host.

    Those are lines in the longest common subsequence with each of the two neighbours' articles, in
    runs that are short against all three.  A page beside a copy of its article, or with one neighbour
    only, loses no line: there, what is shared may be text.
    """
    if len(others) < 2:
        return set()
    least = _chars(article)
    shared = set(range(len(article)))
    for other in others:
        found = common_lines(article, other)
        least = min(least, _chars(other))
        if COPY * _chars([article[i] for i in found]) > min(_chars(article), _chars(other)):
            return set()
        shared &= found
    out: set[int] = set()
    for i in sorted(shared):
        if i - 1 not in shared:
            run = [i]
            while run[-1] + 1 in shared:
                run.append(run[-1] + 1)
            if SHORT * _chars([article[k] for k in run]) <= least:
                out.update(run)
    return out


def main_text(lines: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None,
              other: list[tuple[int, str]] | None = None) -> str:
    """Main text of a page given all its lines, its nearest neighbour's and its other neighbour's (None: no such page)."""
    if any(w == INSIDE for w, _ in lines):
        mine = [t for w, t in lines if w == INSIDE]
        shared = furniture(mine, [[t for w, t in page if w == INSIDE] for page in (neighbour, other) if page is not None])
    else:
        structured = any(w != DROPPED for w, _ in lines)  # else the structure left nothing
        mine = [t for w, t in lines if not structured or w != DROPPED]
        theirs = [t for w, t in neighbour or () if not structured or w != DROPPED]
        shared = common_lines(mine, theirs)
    return "\n".join(t for i, t in enumerate(mine) if i not in shared)


# --- the distributed job -------------------------------------------------------------

#: Ranges of a partition; they are dealt out in turn, so that partitions come out even.
RUNS = 4
_MIN = -(1 << 63)
_DEALT = "run int, host string, path string, page_key long, halo boolean, page_id long, url string, lines binary"
_OUT = "page_id long, url string, text string, n_chars long"


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _packed(lines: list[tuple[int, str]]) -> bytes:
    return zlib.compress(json.dumps(lines).encode(), 1)


def _unpacked(data: bytes) -> list[tuple[int, str]]:
    return [tuple(x) for x in json.loads(zlib.decompress(data))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            partitions: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are dealt out by ranges of (host, path, id); each range also gets the last
    page before it and the first after it, so that every page meets both neighbours
    and a host of any size spreads over all tasks.  The ranges' first and last keys,
    RUNS pairs a partition, are found on the keys alone.  Only the pages' lines are
    shuffled, compressed.

    A null page is empty and has the text ``''``; a null URL, or one without ``://``, has an empty
    host and path; repeated rows are answered each, and neighbours of equal keys are
    each other's; a page alone on its host loses no line; an empty table gives an
    empty result; columns other than the three named are ignored.
    """
    n = partitions or session_partitions(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    frame = pages.select(url_host(url).alias("host"), url_path(url).alias("path"),
                         F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"),
                         F.col(f"`{html_col}`").alias("html"))
    frame = frame.withColumn("page_key", F.coalesce("page_id", F.lit(_MIN)))
    key = F.struct("host", "path", "page_key")
    ends = (frame.select("host", "path", "page_key").repartitionByRange(RUNS * n, "host", "path", "page_key")
            .groupBy(F.spark_partition_id().alias("run")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
            .orderBy("run").collect())  # RUNS rows a partition
    firsts, lasts = [tuple(r.first) for r in ends], [tuple(r.last) for r in ends]
    dealt = pa.schema([("run", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("page_key", pa.int64()),
                       ("halo", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.binary())])
    result = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, path, page_id, link, page, page_key in zip(*(c.to_pylist() for c in b.columns)):
                own = (host, path, page_key)
                run = max(0, bisect.bisect_right(firsts, own) - 1)
                data = _packed(all_lines(page))
                rows.append((run, *own, False, page_id, link, data))
                if own == firsts[run] and run:
                    rows.append((run - 1, *own, True, page_id, link, data))
                if own == lasts[run] and run + 1 < len(firsts):
                    rows.append((run + 1, *own, True, page_id, link, data))
            if rows:
                yield batch(rows, dealt)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = current = None

        def finished(after) -> list[tuple]:
            if current is None or current[4]:
                return []
            near = [x for x in (before, after) if x is not None and x[0] == current[0] and x[1] == current[1]]
            mate = max(near, key=lambda x: _common_prefix(x[2], current[2]), default=None)  # a tie: the one before
            other = next((x for x in near if x is not mate), None)
            text = main_text(current[7], mate[7] if mate else None, other[7] if other else None)
            return [(current[5], current[6], text, len(text))]

        for b in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                row = (*row[:7], _unpacked(row[7]))
                rows += finished(row)
                before, current = current, row
            if rows:
                yield batch(rows, result)
        rows = finished(None)
        if rows:
            yield batch(rows, result)

    return (frame.select("host", "path", "page_id", "url", "html", "page_key").mapInArrow(deal, _DEALT)
            .repartitionById(n, F.pmod("run", F.lit(n))).sortWithinPartitions("run", "host", "path", "page_key", "lines")
            .mapInArrow(resolve, _OUT))
