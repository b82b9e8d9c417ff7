import re
import time

from tally.llm.license_scan import PHRASES, Rule, scan_licenses, signature_rules
from tests.llm.common import DATA, LOWER, empty_like, odd_documents

TEXTS = [
    "Under the MIT License. under the mit license", "cc by nc cc by nc sa", "All rights reserved. é CC BY-NC 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-only",
    "Licensed under the Apache License, Version 2.0.", "mit mit", "été cc-by-nc",
    "Neither the name of foo may be used to endorse or promote products", "released under the MIT license; isc license",
]


def brute(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, base = [], set()
    for label, phrase in PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    joined = " " + " ".join(words) + " " if words else " "
    found = {(r.priority, r.label, r.confidence, m.start(), m.end()) for r in rules if f" {r.keyword} " in joined
             for m in re.finditer(r.pattern + "(?= )", joined)}

    def beaten(d):
        return any(o[3] <= d[3] and o[4] >= d[4] and (o[0], o[4] - o[3]) > (d[0], d[4] - d[3])
                   or (o[:1] + o[3:] == d[:1] + d[3:] and o[1] < d[1]) for o in found)

    kept = [d for d in found if not beaten(d)]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d[1] for d in kept})), max([d[2] for d in kept] + [0.9 if places else 0.0]))


def check(df):
    rules = signature_rules()
    got = sorted((tuple(r)[:-1] for r in scan_licenses(df).collect()), key=repr)
    want = sorted(((r.doc_id, *brute(r.text, rules)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert got == want


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    check(docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], docs.schema)))


def test_odd_documents(spark):
    check(odd_documents(spark))
    assert scan_licenses(empty_like(odd_documents(spark))).count() == 0


def test_containment_and_priority(spark):
    df = spark.createDataFrame([(1, "foo bar baz"), (2, "foo bar")], "doc_id long, text string")
    rules = [Rule("long", "foo", " foo bar baz", 5, 0.5), Rule("short", "foo", " foo bar", 9, 0.4),
             Rule("inner", "bar", " bar", 1, 0.3), Rule("twin", "bar", " bar", 1, 0.3)]
    got = {r.doc_id: r.labels for r in scan_licenses(df, rules=rules).collect()}
    # 'short' does not lie within 'long' of lower priority, nor 'long' within 'short'; the twins' smaller label loses to both
    assert got == {1: "long,short", 2: "short"}


def test_rules_are_many():
    assert len(signature_rules()) > 300


def test_every_match_holds_its_rules_keyword():
    """All word forms of each pattern hold its keyword as a word, outside of optional parts and alternatives."""
    group = re.compile(r"\(\?:([^()]*)\)(\?|\{[^}]*\})?")

    def forms(pattern):
        m = group.search(pattern)
        if not m:
            return {pattern}
        inner = [*m[1].split("|"), *([""] if m[2] == "?" else [])]
        return {f for i in inner for f in forms(pattern[:m.start()] + i + pattern[m.end():])}

    for r in signature_rules():
        assert all(f" {r.keyword} " in f"{f} " for f in forms(r.pattern)), r


def test_forms_without_a_familys_word(spark):
    texts = {
        "distributed under the Eclipse Public License version 2": "epl-2", "provided under the Artistic License version 2": "artistic-2",
        "available under the Mozilla Public License version 2": "mpl-2", "published under the GNU General Public License version 3": "gpl-3",
        "License: MPL-2.0": "mpl-2", "License: EPL-2.0": "epl-2", "MS-PL licensed": "ms-pl", "License: BSL-1.0": "boost-1",
        "License: AFL-3.0": "afl-3", "PSF-2.0 licence": "psf-2", "License: 0BSD": "0bsd", "the zlib licence": "zlib",
        "Permission to use, copy, modify, and distribute this software for any purpose": "isc",
        "The software is provided as is, without warranty of any kind, express or implied": "mit",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in scan_licenses(df).collect()}
    assert [label for k, label in enumerate(texts.values()) if label not in got[k]] == []
    # and without any gate the rules find no more
    ungated = [Rule(r.label, "", r.pattern, r.priority, r.confidence) for r in signature_rules()]
    for k, text in enumerate(texts):
        words = " " + " ".join(re.findall("[0-9a-z]+", text.lower())) + " "
        found = {r.label for r in ungated if re.search(r.pattern + "(?= )", words)}
        assert set(got[k]) <= found and texts[text] in found


def test_notices_as_they_are_written(spark):
    texts = {
        "Released under the New BSD License.": "bsd-3", "GNU GPL v3": "gpl-3", "available as CC BY-SA 4.0": "cc-by-sa", "BSD-style license": "bsd",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa", "Creative Commons Attribution-NonCommercial-NoDerivs 3.0": "cc-by-nc-nd",
        "you may not use this file except in compliance with the License.": "apache-2", "https://opensource.org/licenses/MIT": "mit",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License": "gpl-3", "http://www.boost.org/LICENSE_1_0.txt": "boost-1", "LGPL v2.1 or later": "lgpl-2.1",
        "If a copy of the MPL was not distributed with this file": "mpl-2", "Business Source License 1.1": "busl-1.1",
        "The Software shall be used for Good, not Evil.": "json", "Llama 3.1 Community License": "llama", "<https://unlicense.org>": "unlicense",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in scan_licenses(df).collect()}
    assert [t for k, t in enumerate(texts) if texts[t] not in got[k]] == []
    check(df)


def test_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square: 200,000 in a text."""
    n = 200_000
    df = spark.createDataFrame([(1, "all rights reserved x under the mit license " * (n // 2)), (2, "all rights reserved")],
                               "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word) == (4 * n, n // 2, 4, 4 * n - 4)
    assert rows[1].labels == "mit,proprietary" and len(rows[1].detections) == n and rows[2].labels == "proprietary"
    assert time.time() - began < 240
