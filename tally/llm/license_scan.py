"""License detection by ordered signature rules, in Spark SQL functions only.

A text becomes its normalised words, joined by single spaces.  Base phrases count at
every place.  Beside them some hundreds of signature rules (one per license and form
of words) are regular expressions over the normalised words, each gated by a keyword:
a rule runs only on documents that hold its keyword as a word, which every match of
its pattern does, so that the gate drops no match.  Overlapping
detections are resolved by priority: a detection whose interval lies within that of
a detection of higher priority (equal priority: a longer one, then the smaller label)
is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.llm.common import ascii_lower, join_salted

#: (label, phrase): the base phrases.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs over ' w1 w2 ... wn ' and must start with a space and stop before one."""
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


# (label, name as words, SPDX identifier as words); hand-written, one line a license.
_LICENSES = (
    ("mit", "mit", "mit"),
    ("mit-0", "mit no attribution", "mit 0"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib"),
    ("bsd-2", "bsd 2 clause", "bsd 2 clause"),
    ("bsd-3", "bsd 3 clause", "bsd 3 clause"),
    ("bsd-4", "bsd 4 clause", "bsd 4 clause"),
    ("0bsd", "bsd zero clause", "0bsd"),
    ("apache-1.1", "apache software license version 1 1", "apache 1 1"),
    ("apache-2", "apache license version 2", "apache 2 0"),
    ("gpl-1", "gnu general public license version 1", "gpl 1 0"),
    ("gpl-2", "gnu general public license version 2", "gpl 2 0"),
    ("gpl-3", "gnu general public license version 3", "gpl 3 0"),
    ("lgpl-2", "gnu library general public license version 2", "lgpl 2 0"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "lgpl 2 1"),
    ("lgpl-3", "gnu lesser general public license version 3", "lgpl 3 0"),
    ("agpl-3", "gnu affero general public license version 3", "agpl 3 0"),
    ("gfdl-1.3", "gnu free documentation license version 1 3", "gfdl 1 3"),
    ("mpl-1.1", "mozilla public license version 1 1", "mpl 1 1"),
    ("mpl-2", "mozilla public license version 2", "mpl 2 0"),
    ("epl-1", "eclipse public license version 1", "epl 1 0"),
    ("epl-2", "eclipse public license version 2", "epl 2 0"),
    ("cddl-1", "common development and distribution license version 1", "cddl 1 0"),
    ("cpl-1", "common public license version 1", "cpl 1 0"),
    ("eupl-1.2", "european union public licence version 1 2", "eupl 1 2"),
    ("artistic-1", "artistic license version 1", "artistic 1 0"),
    ("artistic-2", "artistic license version 2", "artistic 2 0"),
    ("boost-1", "boost software license version 1", "bsl 1 0"),
    ("psf-2", "python software foundation license version 2", "psf 2 0"),
    ("php-3", "php license version 3", "php 3 01"),
    ("ruby", "ruby license", "ruby"),
    ("openssl", "openssl license", "openssl"),
    ("postgresql", "postgresql license", "postgresql"),
    ("ms-pl", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "ms rl"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl"),
    ("unlicense", "the unlicense", "unlicense"),
    ("ofl-1.1", "sil open font license version 1 1", "ofl 1 1"),
    ("afl-3", "academic free license version 3", "afl 3 0"),
    ("osl-3", "open software license version 3", "osl 3 0"),
    ("odbl-1", "open database license version 1", "odbl 1 0"),
    ("cc0", "creative commons zero", "cc0 1 0"),
    ("cc-by", "creative commons attribution", "cc by"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa"),
    ("cc-by-nd", "creative commons attribution no ?derivatives", "cc by nd"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "cc by nc sa"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?derivatives", "cc by nc nd"),
)

_VERBS = ("released", "distributed", "published", "available", "provided")

# (keyword or None for the SPDX identifier's first word, pattern with {name} and {spdx}, priority, confidence): the
# forms of words.  Every match of a pattern holds its keyword as a word: what has alternatives is a form for each.
_FORMS = (
    ("spdx", " spdx license identifier {spdx}(?: only| or later)?", 90, 1.0),
    ("licensed", " (?:dual )?licensed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: 0)?", 80, 0.95),
    *((verb, f" {verb} under (?:the )?(?:terms of (?:the )?)?" "{name}(?: licen[sc]e)?(?: 0)?", 80, 0.95)
      for verb in _VERBS),
    *((word, " licen[sc]ed? (?:is|under|type|text|file)? ?(?:the )?{name} " + word, 70, 0.9)
      for word in ("license", "licence")),
    *((word, " {name} " + word + "(?: version)?", 40, 0.8) for word in ("license", "licence")),
    (None, " {spdx} licen[sc]ed?", 45, 0.85),
    (None, " licen[sc]e {spdx}", 50, 0.85),
)

# Signatures of license texts and families, each written for itself.
_TEXTS = (
    Rule("mit", "granted", " permission is hereby granted free of charge to any person obtaining a copy", 85, 0.95),
    Rule("mit", "warranty", " the software is provided as is without warranty of any kind express or implied", 30, 0.6),
    Rule("isc", "permission", " permission to use copy modify and(?: or)? distribute this software for any purpose", 85, 0.9),
    Rule("bsd-2", "redistributions", " redistributions of source code must retain the above copyright notice", 60, 0.7),
    Rule("bsd-3", "endorse", " neither the name of(?: [^ ]+){1,16} may be used to endorse or promote products", 86, 0.95),
    Rule("bsd-4", "advertising", " all advertising materials mentioning features or use of this software", 87, 0.95),
    Rule("zlib", "misrepresented", " the origin of this software must not be misrepresented", 85, 0.95),
    Rule("apache-2", "apache", " www apache org licenses license 2 0", 82, 0.95),
    Rule("apache-2", "apache", " apache license 2 0", 62, 0.9),
    Rule("apache-2", "apache", " apache 2(?: 0)? licen[sc]e", 62, 0.9),
    Rule("gpl", "general", " gnu general public licen[sc]e", 35, 0.75),
    Rule("gpl-2", "general", " gnu general public licen[sc]e(?: as published by the free software foundation)?"
                             " (?:either )?version 2", 65, 0.9),
    Rule("gpl-3", "general", " gnu general public licen[sc]e(?: as published by the free software foundation)?"
                             " (?:either )?version 3", 65, 0.9),
    Rule("gpl-2", "gplv2", " gplv2(?: or later)?", 60, 0.85),
    Rule("gpl-3", "gplv3", " gplv3(?: or later)?", 60, 0.85),
    Rule("gpl", "gnu", " www gnu org licenses gpl", 55, 0.8),
    Rule("lgpl", "lesser", " gnu lesser general public licen[sc]e", 42, 0.8),
    Rule("lgpl-2.1", "lgplv2", " lgplv2(?: 1)?", 60, 0.85),
    Rule("lgpl-3", "lgplv3", " lgplv3", 60, 0.85),
    Rule("agpl-3", "agplv3", " agplv3", 60, 0.85),
    Rule("agpl-3", "affero", " gnu affero general public licen[sc]e", 42, 0.8),
    Rule("mpl-2", "mozilla", " mozilla org mpl 2 0", 82, 0.95),
    Rule("mpl-2", "mozilla", " subject to the terms of the mozilla public licen[sc]e v 2 0", 84, 0.95),
    Rule("epl-2", "eclipse", " www eclipse org legal epl 2 0", 82, 0.95),
    Rule("unlicense", "unencumbered", " this is free and unencumbered software released into the public domain", 88, 1.0),
    Rule("public-domain", "domain", " (?:released|dedicated|placed|put) (?:in|into|to) the public domain", 50, 0.8),
    Rule("cc0", "publicdomain", " creativecommons org publicdomain zero 1 0", 88, 1.0),
    Rule("cc-by", "creativecommons", " creativecommons org licenses by [1-4] [0-9]", 84, 0.95),
    Rule("cc-by-sa", "creativecommons", " creativecommons org licenses by sa [1-4] [0-9]", 85, 0.95),
    Rule("cc-by-nd", "creativecommons", " creativecommons org licenses by nd [1-4] [0-9]", 85, 0.95),
    Rule("cc-by-nc", "creativecommons", " creativecommons org licenses by nc [1-4] [0-9]", 85, 0.95),
    Rule("cc-by-nc-sa", "creativecommons", " creativecommons org licenses by nc sa [1-4] [0-9]", 86, 0.95),
    Rule("cc-by-nc-nd", "creativecommons", " creativecommons org licenses by nc nd [1-4] [0-9]", 86, 0.95),
    # names and short forms as notices write them
    Rule("bsd", "bsd", " bsd licen[sc]e", 36, 0.75),
    Rule("bsd", "bsd", " bsd style licen[sc]e", 38, 0.7),
    Rule("bsd-2", "bsd", " simplified bsd licen[sc]e", 63, 0.9),
    Rule("bsd-2", "freebsd", " freebsd licen[sc]e", 63, 0.85),
    Rule("bsd-3", "bsd", " (?:new|modified|revised) bsd licen[sc]e", 63, 0.9),
    Rule("bsd-4", "bsd", " (?:original|old) bsd licen[sc]e", 63, 0.9),
    Rule("gpl-2", "gpl", " gpl (?:v2|version 2)(?: 0)?(?: only| or later)?", 61, 0.9),
    Rule("gpl-3", "gpl", " gpl (?:v3|version 3)(?: 0)?(?: only| or later)?", 61, 0.9),
    Rule("gpl-2", "general", " gnu general public licen[sc]e v2(?: 0)?", 65, 0.9),
    Rule("gpl-3", "general", " gnu general public licen[sc]e v3(?: 0)?", 65, 0.9),
    Rule("lgpl-2.1", "lgpl", " lgpl (?:v2|version 2) 1(?: only| or later)?", 62, 0.9),
    Rule("lgpl-3", "lgpl", " lgpl (?:v3|version 3)(?: 0)?(?: only| or later)?", 62, 0.9),
    Rule("agpl-3", "agpl", " agpl (?:v3|version 3)(?: 0)?(?: only| or later)?", 62, 0.9),
    Rule("mpl-2", "mpl", " mpl (?:v2|version 2)(?: 0)?", 62, 0.9),
    Rule("boost-1", "boost", " boost software licen[sc]e", 38, 0.8),
    Rule("mit", "expat", " expat licen[sc]e", 55, 0.8),
    Rule("apache-2", "asl", " asl 2 0", 55, 0.75),
    Rule("apache-2", "apache", " apache software licen[sc]e (?:v2|version 2)(?: 0)?", 63, 0.9),
    Rule("cc-by", "cc", " cc by [1-4] [0-9]", 64, 0.9),
    Rule("cc-by-sa", "cc", " cc by sa [1-4] [0-9]", 65, 0.9),
    Rule("cc-by-nd", "cc", " cc by nd [1-4] [0-9]", 65, 0.9),
    Rule("cc-by-nc", "cc", " cc by nc [1-4] [0-9]", 65, 0.9),
    Rule("cc-by-nc-sa", "cc", " cc by nc sa [1-4] [0-9]", 66, 0.9),
    Rule("cc-by-nc-nd", "cc", " cc by nc nd [1-4] [0-9]", 66, 0.9),
    Rule("cc-by", "creative", " creative commons attribution [1-4] [0-9](?: international| unported| generic)?(?: licen[sc]e)?", 66, 0.95),
    Rule("cc-by-sa", "creative", " creative commons attribution (?:sharealike|share alike) [1-4] [0-9]"
                                 "(?: international| unported| generic)?(?: licen[sc]e)?", 67, 0.95),
    Rule("cc-by-nd", "creative", " creative commons attribution (?:noderivatives|no derivatives|noderivs) [1-4] [0-9]"
                                 "(?: international| unported| generic)?(?: licen[sc]e)?", 67, 0.95),
    Rule("cc-by-nc", "creative", " creative commons attribution (?:noncommercial|non commercial) [1-4] [0-9]"
                                 "(?: international| unported| generic)?(?: licen[sc]e)?", 67, 0.95),
    Rule("cc-by-nc-sa", "creative", " creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike) [1-4] [0-9]"
                                    "(?: international| unported| generic)?(?: licen[sc]e)?", 68, 0.95),
    Rule("cc-by-nc-nd", "creative", " creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|no derivatives|noderivs)"
                                    " [1-4] [0-9](?: international| unported| generic)?(?: licen[sc]e)?", 68, 0.95),
    Rule("cc0", "cc0", " cc0 1 0 universal", 66, 0.95),
    Rule("busl-1.1", "business", " business source licen[sc]e(?: 1 1)?", 60, 0.9),
    Rule("elastic-2", "elastic", " elastic licen[sc]e 2 0", 60, 0.9),
    Rule("sspl-1", "server", " server side public licen[sc]e", 60, 0.9),
    Rule("polyform-nc", "polyform", " polyform noncommercial licen[sc]e", 60, 0.9),
    Rule("openrail-m", "creativeml", " creativeml open rail m", 60, 0.9),
    Rule("openrail-m", "bigscience", " bigscience (?:open rail m|rail licen[sc]e)", 60, 0.9),
    Rule("llama", "community", " llama [2-9](?: [0-9])? community licen[sc]e", 60, 0.9),
    Rule("beerware", "beer", " the beer ware licen[sc]e", 60, 0.9),
    Rule("cecill", "cecill", " cecill (?:[abc] )?licen[sc]e", 60, 0.85),
    # sentences of headers and texts
    Rule("apache-2", "compliance", " you may not use this file except in compliance with the licen[sc]e", 70, 0.9),
    Rule("apache-2", "applicable", " unless required by applicable law or agreed to in writing software distributed under the licen[sc]e", 70, 0.9),
    Rule("mpl-2", "mozilla", " this source code form is subject to the terms of the mozilla public licen[sc]e", 84, 0.95),
    Rule("mpl-2", "mpl", " if a copy of the mpl was not distributed with this file", 84, 0.95),
    Rule("gpl", "redistribute", " you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 37, 0.85),
    Rule("gpl-2", "redistribute", " you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"
                                  " as published by the free software foundation either version 2", 86, 0.95),
    Rule("gpl-3", "redistribute", " you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"
                                  " as published by the free software foundation either version 3", 86, 0.95),
    Rule("lgpl", "redistribute", " you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 43, 0.85),
    Rule("agpl-3", "redistribute", " you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 86, 0.95),
    Rule("gpl", "received", " you should have received a copy of the gnu general public licen[sc]e", 37, 0.8),
    Rule("epl", "accompanying", " this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 43, 0.9),
    Rule("zlib", "altered", " altered source versions must be plainly marked as such", 85, 0.95),
    Rule("artistic-1", "perl", " under the same terms as perl itself", 60, 0.85),
    Rule("ofl-1.1", "font", " this font software is licensed under the sil open font licen[sc]e", 85, 0.95),
    Rule("json", "evil", " the software shall be used for good not evil", 88, 0.95),
    Rule("eupl-1.2", "eupl", " licensed under the eupl", 60, 0.8),
    Rule("public-domain", "domain", " this work is in the public domain", 52, 0.85),
    # addresses, whose marks fall away
    Rule("mit", "opensource", " opensource org licenses? mit", 82, 0.95),
    Rule("bsd-3", "opensource", " opensource org licenses? bsd 3 clause", 82, 0.95),
    Rule("bsd-2", "opensource", " opensource org licenses? bsd 2 clause", 82, 0.95),
    Rule("agpl-3", "agpl", " gnu org licenses agpl", 82, 0.9),
    Rule("lgpl", "lgpl", " gnu org licenses lgpl", 56, 0.8),
    Rule("boost-1", "boost", " boost org license 1 0", 82, 0.95),
    Rule("unlicense", "unlicense", " unlicense org", 82, 0.95),
    Rule("wtfpl", "wtfpl", " wtfpl net", 82, 0.95),
    Rule("ofl-1.1", "ofl", " scripts sil org ofl", 82, 0.9),
    Rule("odbl-1", "opendatacommons", " opendatacommons org licenses odbl", 82, 0.95),
    Rule("odc-by-1", "opendatacommons", " opendatacommons org licenses by", 82, 0.95),
    Rule("pddl-1", "opendatacommons", " opendatacommons org licenses pddl", 82, 0.95),
    Rule("proprietary", "unauthorized", " unauthorized copying of this file via any medium is strictly prohibited", 60, 0.9),
    Rule("proprietary", "reserved", " all rights reserved", 10, 0.3),
    Rule("proprietary", "confidential", " (?:confidential and proprietary|proprietary and confidential)", 20, 0.5),
)


def signature_rules() -> list[Rule]:
    """All rules: every license in every form of words, then the signatures of texts."""
    out = []
    for label, name, spdx in _LICENSES:
        own = name.removesuffix(" license").removesuffix(" licence")
        for gate, form, priority, confidence in _FORMS:
            # of two names that both match, the longer (more precise) one has priority
            out.append(Rule(label, gate or spdx.split()[0], form.format(name=own, spdx=spdx),
                            priority + min(9, len(spdx.split())), confidence))
    return [*out, *_TEXTS]


def words_text(text: Column) -> Column:
    """' w1 w2 ... wn ' of the lower-cased text's words, a single space without words."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")),
                            NOT_WORD, " ")


def _count_words(spaced: Column) -> Column:
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1).cast("long")


def _steps(words: Column, pattern: Column) -> Column:
    """The matches of ``pattern`` (not overlapping) in order: length of the gap before, and of the match.

    Matches and the gaps between them add up to the text, which gives the places.
    """
    found = F.regexp_extract_all(words, pattern, F.lit(0))
    gaps = F.split(words, pattern, -1)
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                      lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))


def _ends_of(words: Column, pattern: Column) -> Column:
    """(n, first, last): how many matches, and where the first and the last start."""
    found = F.regexp_extract_all(words, pattern, F.lit(0))
    gaps = F.split(words, pattern, -1)
    return F.struct(F.size(found).alias("n"), F.length(F.element_at(gaps, 1)).alias("first"),
                    (F.length(words) - F.length(F.element_at(gaps, -1)) - F.length(F.element_at(found, -1))).alias("last"))


def _any_word(words: set[str]) -> str:
    """A pattern of any of the words, grouped by first letter so that most places fail soon."""
    first: dict[str, list[str]] = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(w[1:])
    return " (" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")(?= )"


def detections(words: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, kept array<struct<start, end, priority, label, confidence>>) of the rows with detections.

    ``words`` holds the key (one per text) and ``words``.  Documents meet the rules (a
    fixed table, broadcast) on the rules' keywords; suppression follows per text, in one ordered pass.
    """
    spark = words.sparkSession
    levels = {p: k for k, p in enumerate(sorted({r.priority for r in rules}))}
    table = spark.createDataFrame(
        [(i, r.label, r.keyword, f"{r.pattern}(?= )", r.priority, r.confidence, levels[r.priority]) for i, r in enumerate(rules)],
        "rule int, label string, keyword string, pattern string, priority int, confidence double, level int")
    # one pass finds the keywords that a document holds; most hold none
    hits = F.array_distinct(F.regexp_extract_all("words", F.lit(_any_word({r.keyword for r in rules})), F.lit(1)))
    found = (words.select(key, "words", F.explode(hits).alias("keyword"))
             .join(F.broadcast(table), "keyword")
             .where(F.expr("regexp_like(words, pattern)"))
             .groupBy(key, "rule").agg(F.first(_steps(F.col("words"), F.col("pattern"))).alias("steps"),
                                       *[F.first(c).alias(c) for c in ("label", "priority", "confidence", "level")])
             .select(key, "rule", "label", "priority", "confidence", "level", F.posexplode("steps").alias("place", "s")))
    # running sums give the places: time in proportion to the matches, however many a text holds
    so_far = Window.partitionBy(key, "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (found.withColumn("end", F.sum(F.col("s.gap") + F.col("s.len")).over(so_far).cast("int"))
             .select(key, "label", "priority", "confidence", "level", (F.col("end") - F.col("s.len")).alias("start"), "end")
             .distinct())
    # in this order whatever suppresses a detection comes before it; per level, how far the detections of that
    # priority or a higher one have reached
    before = (Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("priority"), "label", F.desc("confidence"), "level")
              .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.array(*[F.max(F.when(F.col("level") >= k, F.col("end"))).over(before) for k in range(len(levels))])
    kept = (spans.withColumn("reach", F.element_at(reach, F.col("level") + 1))
            .where(F.col("reach").isNull() | (F.col("reach") < F.col("end"))))
    one = F.struct("start", "end", "priority", "label", "confidence")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("kept"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: tuple[tuple[str, str], ...] = PHRASES, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``score`` is the largest confidence of a kept detection or of a base phrase (0.9).
    A null or empty text has no words, no labels and score 0; repeated rows are scanned
    each (also with equal or null ids); an empty table gives an empty result; columns
    other than the two named are ignored.  Texts are never shuffled, only counts and
    detections.
    """
    rules = signature_rules() if rules is None else rules
    frame = docs.select(F.col(f"`{id_col}`").alias(id_col), words_text(F.col(f"`{text_col}`")).alias("words"))
    # equal texts have equal detections: the text's hash is the key, and copies' detections fold map-side
    frame = frame.withColumn("scan_key", F.sha2("words", 256))
    found = detections(frame.select("scan_key", "words"), "scan_key", rules)
    base, ends = frame, []
    for k, (label, phrase) in enumerate(phrases):
        pattern = F.lit(f" {phrase}(?= )")
        base = base.withColumn(f"b{k}", F.when(F.contains("words", F.lit(f" {phrase} ")), _ends_of(F.col("words"), pattern)))
        ends.append(F.col(f"b{k}"))

    def word_index(start: Column) -> Column:
        """Words before a place: the spaces up to its own, less one."""
        return F.when(start.isNotNull(), _count_words(F.substring("words", F.lit(1), start + 1)))

    none = F.lit(None).cast("int")
    base = base.select(
        id_col, "scan_key", _count_words(F.col("words")).alias("n_words"),
        sum((F.coalesce(e["n"], F.lit(0)) for e in ends), F.lit(0)).cast("long").alias("n_base"),
        word_index(F.array_min(F.array(none, *[e["first"] for e in ends]))).alias("first_word"),
        word_index(F.array_max(F.array(none, *[e["last"] for e in ends]))).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[
            F.when(e.isNotNull(), F.lit(label)) for e, (label, _) in zip(ends, phrases)])))).alias("base"))
    # copies of one text may be many: their rows are salted
    joined = join_salted(base, found, "scan_key", F.col(f"`{id_col}`"), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(
        F.transform("kept", lambda d: d["label"]), F.array().cast("array<string>")))))
    best = F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0))
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce("kept", F.array().cast("array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"))
         .alias("detections"))
