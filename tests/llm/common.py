"""Small fixtures and plain references for the operators of tally.llm."""

from __future__ import annotations

import re

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

#: Null, empty, blank, tied, repeated and very long texts, in odd scripts too.
ODD_TEXTS = [None, "", " \n\t", "One", "one ", "a b c", "A B c", "a b c", "é🙂 ß", "x" * 40000, "the cat " * 9000,
             "word\u00a0word\u2028end", "<|endoftext|> a", "\x00nul", "tab\tand\nline"]


def odd_documents(spark):
    """Documents with every awkward text, repeated rows, a null id, and clashing extra columns."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[0], (None, "one", None, None, None), (None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ("key string, id string, words string, digest string, sig string, n long, rep long, component string, label string, "
             "spans string, rule string, host string, score double, value string, run int, place string, sample int")
    df = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("?" if c.split()[1] == "string" else 1).cast(c.split()[1]).alias(c.split()[0])
                            for c in extra.split(", ")])


def empty_like(df):
    return df.where("1 = 0")
