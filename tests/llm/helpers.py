"""Documents with awkward rows, for every operator's edge cases."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, size STRING, fp STRING, root STRING, h INT"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def row(doc_id, text, lang="en", source="a"):
    # The last columns clash with names that operators use inside.
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, "x", "y", "z", 1)


def awkward(spark, more=()):
    """Nulls in any column, empty and very long texts, repeated rows, odd white space and characters."""
    long = " ".join(f"word{i % 977} Ünïcode" for i in range(60_000)) + "\n" + "x" * 200_000
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t\x0b "), row(4, "one"), row(5, "Same text here, with five words and more."), row(5, "Same text here, with five words and more."),
        row(None, "no id at all but with text that is long enough"), row(None, None, None, None), row(6, long), row(7, "12345 !!! ???"), row(8, "É\u00a0È ÀÉ\u2028x\ny", None, None),
        row(9, "\n\n\n"), row(-3, "negative ids are ids as well\nNEGATIVE IDS ARE IDS AS WELL\n"), row(10, "\x00\x01 control"), row(20, "twenty " * 30, "de", "b"),
        *more,
    ]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
