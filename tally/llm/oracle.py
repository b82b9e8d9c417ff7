"""DuckDB statements for the queries of this package that SQL can express."""

from __future__ import annotations

from tally.llm import license_scan, secret_scan, url_filter
from tally.llm.queries import URL_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _urls() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))
    listed = f"regexp_matches(host, '(^|[.-])({'|'.join(url_filter.UNWANTED)})([.-]|$)')"
    host = _LOWER.format("regexp_extract(rest, '^[^/?#]*')")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
     b AS (SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM b"""


_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64.0 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
           FROM v AS q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def _secrets() -> str:
    """Base and vendor spans by regular expressions, verdicts by the values' distinct owners."""
    fold = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    keys = "|".join(map(fold, ("password", "passwd", "secret", "token"))) + f"|{fold('api')}_?{fold('key')}"
    patterns = {"assign": f"({keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "hex": "[0-9a-f]+"}
    kinds = secret_scan.BASE + secret_scan.VENDOR
    names = [*[k.name for k in kinds], "live", "example"]
    each = " UNION ALL ".join(
        f"SELECT rid, doc_id, source, {i} AS rank, {k.least} AS least, regexp_extract_all(t, '{q}') AS w, "
        f"regexp_extract_all(t, '{q}', {k.group}) AS v, string_split_regex(t, '{q}') AS g FROM d"
        for i, k in enumerate(kinds) for q in [patterns.get(k.name, k.pattern)])
    named = "[" + ", ".join(f"'{n}'" for n in names) + "][rank + 1]"
    joined = f"string_agg({named} || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{k.name}" for i, k in enumerate(secret_scan.BASE))
    zero = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secret_scan.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
     m AS ({each}),
     i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
     s AS (SELECT rid, doc_id, source, rank, v[i] AS value, length(w[i]) AS n,
                  coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                  + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS a
           FROM i WHERE length(v[i]) >= least),
     o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM s GROUP BY value),
     j AS (SELECT rid, CASE WHEN owners <= {secret_scan.MOST_OWNERS} THEN {len(kinds)} ELSE {len(kinds) + 1} END AS rank,
                  a, a + n AS b, owners, repos FROM s JOIN o USING (value)),
     e AS (SELECT rid, rank, a, a + n AS b FROM s UNION ALL SELECT DISTINCT rid, rank, a, b FROM j),
     r AS (SELECT rid, {joined} AS spans, {joined} FILTER (rank < {len(secret_scan.BASE)}) AS base, {counts},
                  count(*) FILTER (rank = {len(kinds)}) AS n_live, count(*) FILTER (rank = {len(kinds) + 1}) AS n_example
           FROM e GROUP BY rid),
     x AS (SELECT rid, max(owners) AS max_owners, max(repos) AS max_repos FROM j GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners,
       coalesce(max_repos, 0) AS max_repos
FROM d LEFT JOIN r USING (rid) LEFT JOIN x USING (rid)"""


def _licenses() -> str:
    """All rules on all documents that hold their keyword, then suppression by containment.

    Words are joined by two spaces, so that neighbouring matches each have one of their own.
    """
    doubled = lambda pattern: pattern[:1] + pattern[1:].replace(" ", "  ").replace("[^  ]", "[^ ]") + " "
    rules = ", ".join(f"('{r.label}', '{r.keyword}', '{doubled(r.pattern)}', {r.priority}, {r.confidence})"
                      for r in license_scan.signature_rules())
    phrases = ", ".join(f"('{label}', '{doubled(' ' + phrase)}')" for label, phrase in license_scan.PHRASES)
    lower = _LOWER.format("coalesce(text, '')")
    place = ("length(list_aggregate(g[1:i], 'string_agg', '')) "
             "+ coalesce(length(list_aggregate(w[1:i - 1], 'string_agg', '')), 0)")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
     t AS (SELECT *, CASE WHEN len(words) = 0 THEN ' ' ELSE '  ' || array_to_string(words, '  ') || '  ' END AS t FROM d),
     q(label, pattern) AS (VALUES {phrases}),
     u(label, keyword, pattern, priority, confidence) AS (VALUES {rules}),
     b0 AS (SELECT rid, label, regexp_extract_all(t, pattern) AS w, string_split_regex(t, pattern) AS g FROM t, q),
     b1 AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM b0 WHERE len(w) > 0),
     b AS (SELECT rid, label, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(
                  list_aggregate(g[1:i], 'string_agg', '') || coalesce(list_aggregate(w[1:i - 1], 'string_agg', ''), ''), '[^ ]+'))))
                  AS word FROM b1),
     f0 AS (SELECT rid, label, priority, confidence, regexp_extract_all(t, pattern) AS w, string_split_regex(t, pattern) AS g
            FROM t JOIN u ON contains(t, ' ' || keyword || ' ')),
     f1 AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f0 WHERE len(w) > 0),
     f AS (SELECT DISTINCT rid, label, priority, confidence, {place} AS a, {place} + length(w[i]) AS z FROM f1),
     k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS o WHERE o.rid = f.rid AND o.a <= f.a AND o.z >= f.z
             AND (o.priority > f.priority OR (o.priority = f.priority
                  AND (o.z - o.a > f.z - f.a OR (o.z - o.a = f.z - f.a AND o.label < f.label)))))),
     e AS (SELECT rid, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
     c AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
           FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM k) GROUP BY rid),
     s AS (SELECT rid, max(confidence) AS best FROM k GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 0.9 ELSE 0.0 END) AS DOUBLE) AS score
FROM d LEFT JOIN e USING (rid) LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)"""


def _near_dedup() -> str:
    """All pairs that share a shingle, and components by a recursive closure."""
    lower = _LOWER.format("coalesce(text, '')")
    return f"""
WITH RECURSIVE
     w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                                      WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b USING (g)
           WHERE a.doc_id <> b.doc_id GROUP BY ALL),
     l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y
           WHERE 100 * c >= 80 * (a.n + b.n - c)),
     r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
     m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(y, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id"""


def _divergence() -> str:
    """All pairs of a language's sources, term by term."""
    lower = _LOWER.format("coalesce(text, '')")
    price = "1 + (1000000000 * ({} + 1)) // ({} + {})"
    ranked = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     w AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term, CAST(count(*) AS BIGINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
     v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
     s AS (SELECT lang, source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n
           FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
     a AS (SELECT lang, s.source, k.term, coalesce(c.n, 0) AS n, {price.format('coalesce(c.n, 0)', 's.n', 'v.v')} AS p,
                  {price.format('k.total', 'v.n', 'v.v')} AS q
           FROM s JOIN v USING (lang) JOIN k USING (lang)
           LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
     f AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS BIGINT) AS value
           FROM a AS x JOIN a AS y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
     b AS (SELECT x.lang, x.source, y.source AS item, coalesce(f.value, 0) AS value FROM s AS x JOIN s AS y USING (lang)
           LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source WHERE x.source <> y.source),
     t AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM a WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {ranked} FROM b
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {ranked} FROM t) WHERE rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": _near_dedup(), "op4_secret_scan": _secrets(), "op8_license_scan": _licenses(),
            "op2_vafile_topk": _TOPK, "op10_url_filter": _urls(), "op12_source_divergence": _divergence()}
