"""Small awkward tables shared by the tests."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the cat and the dog went over the hill to the old town and they were there with that thing "
DE = "der hund und die katze gingen über den hügel in die alte stadt und sie waren nicht mehr dort "


def awkward_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and columns whose names clash with the operators' own."""
    long_text = EN * 1500
    rows = [
        (1, EN, "en", "web", 10),
        (2, EN, "en", "web", 10),
        (3, DE, "de", "books", 10),
        (4, None, "en", "web", None),
        (5, "", "en", None, 0),
        (6, " \t\n ", None, "web", 4),
        (7, long_text, "en", "web", 9),
        (7, long_text, "en", "web", 9),
        (8, DE + "noch ein wort", "de", "books", 1),
        (9, "1234 5678 !!", "en", "web", 12),
        (10, "Ünïcode 😀 日本語 it's <|endoftext|> x'll", None, None, 5),
        (None, EN + "one more", "en", "web", 3),
        (None, None, None, None, None),
    ]
    rows += [(k, f"{EN} number {k} {k * k} {DE if k % 2 else ''}", "de" if k % 2 else "en", f"s{k % 4}", k) for k in range(20, 60)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "size", "row", "target", "score", "places", "pick", "a.b", "h"):
        df = df.withColumn(name, df["n_chars"].cast("string"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def n_words(text):
    return len(WORDS.findall(text or ""))
