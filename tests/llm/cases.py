"""Awkward rows that every operator has to take: nulls, blanks, long texts, ties, repeats, clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["node", "key", "hub", "size", "h", "cell", "rank", "start", "taken", "component", "kept", "blob", "gram", "tiles", "score", "_id", "_h"]

_rng = random.Random(7)
_STEMS = "ar bel cor dun est fir gol han ith jor kel lum mor nis".split()
_COMMON = "the of and to in is that it was for on with as".split()


def prose(words: int, rng=_rng) -> str:
    """Plain English-like sentences."""
    out = []
    for i in range(words):
        w = rng.choice(_COMMON) if rng.random() < 0.4 else rng.choice(_STEMS) + rng.choice(_STEMS) + rng.choice(_STEMS)
        out.append(w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def edited(text: str, every: int) -> str:
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def awkward_rows():
    base, long = prose(120), prose(6000)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, edited(base, 40), "en", None), (4, edited(base, 4), "en", "b"),
        (5, None, "en", "a"), (6, "", None, "b"), (7, " \t\n\x0b\x0c\r ", "xx", None), (8, "one", "en", "c"), (9, "One", "en", "c"),
        (10, long, "en", "a"), (11, long + " end", None, "a"), (12, "é ß 日本  x", "de", "é"), (12, "é ß 日本  x", "de", "é"),
        (13, prose(60), "en", "b"), (13, prose(60), "en", "b"), (None, prose(60), "en", "b"), (None, None, None, None),
        (14, "two words", "fr", ""), (15, base.upper(), "en", "a"),
    ]


def table(spark, rows=None, extra=True):
    rows = awkward_rows() if rows is None else rows
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHING}) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
