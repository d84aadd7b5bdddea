"""Quality rules: Jensen-Shannon distance from the histograms of the language.

One pass over the whole texts counts, per document, the plain figures (words,
symbols, repeated lines, repeated word windows) and two histograms: characters by
class and words by common word, everything else in one bin. The documents that
pass the plain rules, all of them, give the reference histograms of each language.
A document that is long enough for its own histogram to mean something (the
minimum-length guards) is rejected when either distance exceeds its limit.

Languages without a word list share one reference, so there are always at most
five reference rows, which is what is broadcast.

Defined results: null and empty texts have zero counts and fail for want of
words; a null or unknown lang is judged against the shared reference. Repeated
rows are judged alike and counted as often as they occur. Without any passing
document in a language there is no reference and only the plain rules count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagelake.session import cut_lineage
from .words import list_column, map_batches, mix, utf8

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Guards of the two distances, and their limits: a base plus a scatter over the root of the
#: counted words or characters, since the histogram of a shorter text strays further by chance.
WORDS_FROM, WORD_LIMIT, WORD_SCATTER = 40, 0.13, 2.0
CHARS_FROM, CHAR_LIMIT, CHAR_SCATTER = 150, 0.16, 2.0

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in is that it for was on are as with be by this from or at he an have not they but had which you all",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais ou son",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque",
}
# Character classes over UTF-8 bytes; the rest is listed by range below.
SYMBOLS, MARKS = b"#*$%&|<>", b".,;:!?'\"()-"

_WORDS = sorted({w.encode() for words in COMMON.values() for w in words.split()})
_BIN = {w: i + 1 for i, w in enumerate(_WORDS)}
WORD_BINS = len(_WORDS) + 1
_CONT, _SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _OTHER, _WIDE = range(9)
CHAR_BINS = 9


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[list(MARKS)] = _MARK
    table[list(SYMBOLS)] = _SYMBOL
    table[0x80:0xC0] = _CONT
    table[0xC0:] = _WIDE
    return table


_CLASS = _classes()


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of eight that occurs at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    step = 1
    with np.errstate(over="ignore"):
        while step < WINDOW:
            h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
            step *= 2
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(counts) == len(h):
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[back] > 1)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms."""
    text = text or b""
    words = text.split()
    chars = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CHAR_BINS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    get = _BIN.get
    bins = np.bincount(np.fromiter((get(w, 0) for w in text.lower().split()), np.int64, len(words)), minlength=WORD_BINS)
    return (len(words), int(len(text) - chars[_CONT] - chars[_SPACE]), int(chars[_SYMBOL]), len(lines) - len(set(lines)),
            repeat_words(words), chars[1:].astype(np.int64), bins.astype(np.int64))


_PLAIN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*map(measure, utf8(batch.column("text")))))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), batch.column("ref"), *[pa.array(x, pa.int64()) for x in found[:5]],
             *[list_column(list(x), pa.int64()) for x in found[5:]]],
            names=["doc_id", "h", "ref", *_PLAIN, "chars", "bins"],
        )

    known = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("other")
    plain = ", ".join(f"{c} long" for c in _PLAIN)
    return map_batches(
        docs.select("doc_id", F.xxhash64("text").alias("h"), known.alias("ref"), "text"), run,
        f"doc_id long, h long, ref string, {plain}, chars array<long>, bins array<long>",
    )


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Distance of two count arrays; the shares are half the sum of p log2(2p / (p + q)) and its mirror."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (term(x, y) + term(y, x)) / 2)
    return F.sqrt(F.greatest(_total(terms), F.lit(0.0)))


def references(found: DataFrame) -> DataFrame:
    """Shares per language over all documents that pass the plain rules (five rows at most)."""
    sums = [F.array(*[F.sum(F.col(c)[i]).cast("double") for i in range(n)]).alias(f"ref_{c}")
            for c, n in (("chars", CHAR_BINS - 1), ("bins", WORD_BINS))]
    return found.where("NOT base_failed").groupBy("ref").agg(*sums).select("ref", _shares("ref_chars"), _shares("ref_bins"))


def _shares(name: str) -> Column:
    return F.transform(name, lambda x: x / _total(F.col(name))).alias(name)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the plain figures, base_failed, both distances (null below the guard), kept and h (the text's hash)."""
    repeated = F.expr(f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    found = cut_lineage(
        features(docs).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeated), "quality"
    )
    both = found.join(F.broadcast(references(found)), "ref", "left")
    for name, source, enough in (
        ("word_distance", "bins", F.col("n_words") >= WORDS_FROM), ("char_distance", "chars", F.col("word_chars") >= CHARS_FROM)
    ):
        both = both.withColumn(f"own_{source}", F.transform(source, lambda x: x.cast("double")))
        both = both.withColumn(f"own_{source}", _shares(f"own_{source}"))
        both = both.withColumn(name, F.when(enough, js_distance(F.col(f"own_{source}"), F.col(f"ref_{source}"))))
    far = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(name) > base + scatter / F.sqrt(size), F.lit(False)) for name, base, scatter, size in (
            ("word_distance", WORD_LIMIT, WORD_SCATTER, "n_words"), ("char_distance", CHAR_LIMIT, CHAR_SCATTER, "word_chars"))
    ])
    return both.withColumn("kept", ~F.col("base_failed") & ~far).select(
        "doc_id", *_PLAIN, "base_failed", "word_distance", "char_distance", "kept", "h"
    )
