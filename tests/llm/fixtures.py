"""Small tables for the operator tests."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").encode())


def table(spark, rows, extra=""):
    """Documents from (doc_id, text[, lang, source]) tuples; ``extra`` adds columns that
    carry names the operators use inside (their values must come through untouched)."""
    full = [(r[0], r[1], *(r[2:4] or (None, None)), len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in full], SCHEMA)
    for name in filter(None, extra.split(",")):
        df = df.selectExpr("*", f"concat('x', doc_id) AS `{name}`")
    return df


def edge_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "no id here", "en", "b"),
        (4, "one", None, "a"), (5, "One", "de", None), (6, long_text, "en", "b"), (7, long_text, "en", "b"),
        (8, "same row", "en", "a"), (8, "same row", "en", "a"), (8, "other text, same id", "en", "a"),
        (9, "äöü 中文 😀   \x0b x y", "fr", "c"), (10, "a" * 5000, "fr", "c"), (11, "12 34 !!", "es", "c"),
    ]
