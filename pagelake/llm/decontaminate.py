"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of passages with test items.

Words are lowered (A-Z) and stripped of ASCII punctuation. The test items' word
trigrams go into a bitmap of fixed size, the only thing sent to all tasks; one
scan of the documents keeps the positions whose trigram may be one of them. Every
position whose trigram an item has is a seed, so any three words in a row that a
copy leaves unedited suffice, whatever else the corpus holds. Seeds that point to
the same place of a document and an item give one window, and the window's words
are aligned with the whole item: match +2, mismatch and gap -1. The score is the
share of the best possible one. Windows that lack too many of the item's words to
reach it are not aligned.

Texts travel once more, dealt out by their own id, and only those with a window.

Defined results: null, empty and short texts match nothing; items of fewer than
three words cannot be found. Rows without doc_id or item_id are not reported.
Rows that repeat an id count under it with their best score. Equal items are
reported each under its own id.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelake.session import cut_lineage
from .words import map_batches, signed, utf8, window_hashes, word_hashes

GRAM, SCORE, SLACK = 3, 0.5, 8
MATCH, MISMATCH, GAP = 2, -1, 1
MAP_BITS = 24
# Punctuation that edits come and go with.
PUNCTUATION = b".,;:!?\"'()[]{}*_"


def plain_words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split() if text else []


def grams(text: bytes | None) -> np.ndarray:
    h = word_hashes(plain_words(text))
    return window_hashes(h, GRAM) if len(h) >= GRAM else h[:0]


def item_grams(items: DataFrame) -> DataFrame:
    """item_id, n_words, place and gram of every trigram."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, places, keys = [], [], [], []
        for i, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text"))):
            g = signed(grams(text)).tolist()
            ids += [i] * len(g)
            sizes += [len(g) + GRAM - 1] * len(g)
            places += range(len(g))
            keys += g
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(keys, pa.int64())],
            names=["item_id", "n_words", "place", "gram"],
        )

    named = items.where("item_id IS NOT NULL").select("item_id", "text")
    return map_batches(named, run, "item_id long, n_words long, place long, gram long")


def bitmap(keys: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A bit for the top ``bits`` bits of each key: 2^bits bits whatever the number of keys (at most 2^(bits-6) rows are fetched)."""
    bit = f"shiftrightunsigned({column}, {64 - bits})"
    rows = keys.selectExpr(f"{bit} div 64 AS at", f"shiftleft(1L, CAST({bit} % 64 AS INT)) AS one")
    found = np.zeros(1 << (bits - 6), np.uint64)
    for at, mask in rows.groupBy("at").agg(F.bit_or("one")).collect():
        found[at] = np.uint64(mask & (1 << 64) - 1)
    return found


def possible_hits(docs: DataFrame, found: np.ndarray, bits: int = MAP_BITS) -> DataFrame:
    """doc_id, pos and gram where the bitmap has the trigram's bit."""
    down, low = np.uint64(64 - bits), np.uint64(63)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, places, keys = [], [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            g = grams(text)
            bit = g >> down
            at = np.flatnonzero(found[bit >> np.uint64(6)] >> (bit & low) & np.uint64(1))
            if len(at):
                ids.append(np.full(len(at), i, np.int64))
                places.append(at)
                keys.append(signed(g[at]))
        if not ids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, places, keys)], names=["doc_id", "pos", "gram"])

    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return map_batches(named, run, "doc_id long, pos long, gram long")


def align(passage: list[bytes], item: list[bytes]) -> tuple[float, int, int]:
    """Best local alignment: share of the possible score, and the passage's words [from, to) in it."""
    numbers: dict[bytes, int] = {}
    a = np.array([numbers.setdefault(w, len(numbers)) for w in passage])
    b = [numbers.setdefault(w, len(numbers)) for w in item]
    n = len(a)
    slope = GAP * np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, at = 0, (0, 0)
    for w in b:
        step = np.where(a == w, MATCH, MISMATCH)
        down, across = row - GAP, row[:-1] + step
        new, origin = np.maximum(down, 0), np.where(down > 0, start, np.arange(n + 1))
        better = across > new[1:]
        new[1:][better], origin[1:][better] = across[better], start[:-1][better]
        lifted = new + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, start = top - slope, origin[source]
        end = int(np.argmax(row))
        if row[end] > best:
            best, at = int(row[end]), (int(start[end]), end)
    return best / (MATCH * max(1, len(b))), *at


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score and words [word_from, word_to) of the best aligned passage of every contaminated pair."""
    own = cut_lineage(item_grams(items), "item-grams")
    hits = cut_lineage(possible_hits(docs, bitmap(own, "gram")), "gram-hits")
    places = hits.join(own, "gram").select(
        "doc_id", "item_id", F.greatest(F.col("pos") - F.col("place") - SLACK, F.lit(0)).alias("a"),
        (F.col("pos") - F.col("place") + F.col("n_words") + SLACK).alias("b"), "n_words",
    )
    # Windows of one document and item that start within half an item of each other are one window.
    cell = F.floor(F.col("a") / F.greatest(F.col("n_words") / 2, F.lit(1))).alias("cell")
    windows = places.groupBy("doc_id", "item_id", cell).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    texts = items.where("item_id IS NOT NULL").select("item_id", F.col("text").alias("item"))
    asked = windows.join(texts, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "a", "b")).alias("asked"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, text, asked in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("asked").to_pylist()):
            words = plain_words(text)
            for q in asked:
                passage, item = words[q["a"] : q["b"]], plain_words((q["item"] or "").encode())
                if (Counter(passage) & Counter(item)).total() < score * len(item):
                    continue  # the score is at most the share of matched words
                share, start, end = align(passage, item)
                if share >= score:
                    rows.append((i, q["item_id"], share, q["a"] + start, q["a"] + end))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
            names=["doc_id", "item_id", "score", "word_from", "word_to"],
        )

    found = map_batches(
        docs.select("doc_id", "text").join(asked.hint("shuffle_hash"), "doc_id"), run,
        "doc_id long, item_id long, score double, word_from long, word_to long",
    )
    best = F.max(F.struct("score", (-F.col("word_from")).alias("early"), "word_to")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", (-F.col("best.early")).alias("word_from"), "best.word_to"
    )
