"""Ranked lexical search over an inverted index, by Block-Max MaxScore.

``build_index`` cuts the documents into shards of about SHARD_BYTES of text, each built
inside one task: no posting is shuffled. A row of the index is a term's list in a
shard, cut into blocks of BLOCK postings; a block is described by its first document and its
largest term frequency. Documents of a shard are numbered by ascending length, so that
the first document of a block is its shortest, and block bounds are tight. A row
without term holds the shard's doc_ids and lengths.

``search`` weighs the queries' terms with the frequencies of the whole index, joins them to
the lists and hands each shard the lists that a block of queries asks for. There, for
each query, lists are taken by descending bound and scored whole while the bounds of the
rest could still carry an unseen document into the best k (essential lists). For the lists
that remain, every document seen so far gets the bounds of the blocks it would stand in; those
that cannot reach the k-th best are rejected before any such block is decoded, and again after each
list. A shard returns its k best per query; the best of all shards are ranked.

A score is an integer: the sum over the query's terms, once each, of
w * (1000000000 * tf div (1000 * tf + 20 * m)), with w = floor(1000 * ln((2N+2) / (2df+1))) and
m = 50 + 50 * n * N div L. As a block's bound is that of its largest tf and shortest document, and
everything is rounded down alike, bounds are exact and no result is lost.

Defined results: null and empty texts, and texts without a term, are not counted in N and not
found. Queries without a term, or null, have no rows; rows of queries that share an id are one
query; a null id is one, too. Equal scores rank by ascending doc_id, null last; documents that repeat a
doc_id are ranked each. Very long texts form a shard of their own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from pagelake.session import cut_lineage
from .words import bounded_batches

BLOCK, TOP = 128, 50
SHARD_BYTES, SHARD_ROWS = 16 << 20, 1 << 16
#: Queries that a task works on at a time, about.
QUERY_BLOCK = 256
INDEX_SCHEMA = "shard long, term string, df int, blocks binary, gaps binary, tfs binary, doc_ids array<long>, lengths array<int>"
#: Bytes of text to a term byte or a blank: digits, letters with A-Z lowered, and all of non-ASCII.
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def term_lists(texts: pa.Array) -> pa.ListArray:
    """Terms of every text, repeats included; a null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, ends, data = texts.buffers()
    flat = _TERM_BYTES[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    clean = pa.Array.from_buffers(pa.large_string(), len(texts), [None, ends, pa.py_buffer(flat)])
    return pc.ascii_split_whitespace(clean)


def width_of(largest: int) -> np.dtype:
    return np.dtype("<u1" if largest < 1 << 8 else "<u2" if largest < 1 << 16 else "<u4")


def binary_parts(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of values from each start to the next as one binary column."""
    ends = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def shard_index(shard: int, doc_ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard."""
    lists = term_lists(texts)
    flat, row = lists.values, np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    real = pc.not_equal(pc.binary_length(flat), 0)
    flat, row = flat.filter(real), row[real.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(row, minlength=len(lists))
    if not len(flat):
        return
    order = np.argsort(lengths, kind="stable")
    ordinal = np.empty(len(order), np.int64)
    ordinal[order] = np.arange(len(order))
    coded = flat.dictionary_encode()
    terms, docs = coded.dictionary, len(lists)
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + ordinal[row], return_counts=True)
    code, doc = pairs // docs, pairs % docs
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    df = np.diff(np.append(start, len(code)))
    place = np.arange(len(code)) - np.repeat(start, df)
    heads = np.flatnonzero(place % BLOCK == 0)
    gaps = np.diff(doc, prepend=0)
    gaps[heads] = 0
    meta = np.stack([doc[heads], np.maximum.reduceat(tf, heads)], axis=1).astype("<u4").ravel()
    first = np.searchsorted(heads, start)
    yield _rows(shard, terms.take(pa.array(code[start])).cast(pa.string()), df, binary_parts(meta, 2 * first),
                binary_parts(gaps.astype(width_of(gaps.max())), start), binary_parts(tf.astype(width_of(tf.max())), start))
    own, sizes = doc_ids.take(pa.array(order)), pa.array(lengths[order], pa.int32())
    yield _rows(shard, None, np.array([docs]), None, None, None, own, sizes)


def _rows(shard: int, term, df, blocks, gaps, tfs, doc_ids=None, lengths=None) -> pa.RecordBatch:
    n = len(df)
    one = lambda x: pa.array([x.to_pylist()], pa.list_(x.type)) if x is not None else None
    named = [("shard", pa.array([shard] * n, pa.int64()), None), ("term", term, pa.string()), ("df", pa.array(df, pa.int32()), None), ("blocks", blocks, pa.binary()),
             ("gaps", gaps, pa.binary()), ("tfs", tfs, pa.binary()), ("doc_ids", one(doc_ids), pa.list_(pa.int64())), ("lengths", one(lengths), pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else x for _, x, t in named], names=[k for k, _, _ in named])


def build_index(docs: DataFrame) -> DataFrame:
    """INDEX_SCHEMA of doc_id and text, written below the shared folder."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            if held and (size + batch.nbytes > SHARD_BYTES or rows + batch.num_rows > SHARD_ROWS):
                yield from _shard(shard, held)
                shard, held, size, rows = shard + 1, [], 0, 0
            held.append(batch)
            size, rows = size + batch.nbytes, rows + batch.num_rows
        if held:
            yield from _shard(shard, held)

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA), "index")


def _shard(shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks()
    texts = whole["text"].combine_chunks() if whole.num_rows else pa.array([], pa.string())
    for rows in shard_index(shard, whole["doc_id"].combine_chunks(), texts):
        for at in range(0, rows.num_rows, 20_000):
            yield rows.slice(at, 20_000)


def query_terms(queries: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item and term, each pair once."""
    bounded_batches(queries.sparkSession)
    kind = dict(queries.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = term_lists(batch.column(1))
            items = batch.column(0).take(pc.list_parent_indices(lists))
            yield pa.RecordBatch.from_arrays([items, lists.flatten().cast(pa.string())], names=["item", "term"])

    return queries.select(item, text).mapInArrow(run, f"item {kind}, term string").where("term != ''").distinct()


class TermList:
    """A term's list in a shard; blocks are decoded when asked for, and ``decoded`` counts them."""

    def __init__(self, weight: int, df: int, blocks: bytes, gaps: bytes, tfs: bytes, pads: np.ndarray):
        self.df, self.pads, self.weight, self.decoded = df, pads, weight, 0
        meta = np.frombuffer(blocks, "<u4").reshape(-1, 2).astype(np.int64)
        self.first, self.n = meta[:, 0], len(meta)
        self.gaps = np.frombuffer(gaps, f"<u{len(gaps) // df}")
        self.tfs = np.frombuffer(tfs, f"<u{len(tfs) // df}")
        self.bounds = self.part(meta[:, 1], self.first)
        self.bound, self.all = int(self.bounds.max()), None

    def part(self, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return self.weight * (1_000_000_000 * tf // (1000 * tf + self.pads[doc]))

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their part of the score, kept for the next query."""
        if self.all is None:
            self.all = self.decode(np.arange(self.n))
        return self.all

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.all is not None:
            at = np.concatenate([np.arange(b * BLOCK, min((b + 1) * BLOCK, self.df)) for b in blocks])
            return self.all[0][at], self.all[1][at]
        self.decoded += len(blocks)
        if len(blocks) == self.n:
            gaps, tfs, size = self.gaps, self.tfs, np.full(self.n, BLOCK)
        else:
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < self.df]
            gaps, tfs, size = self.gaps[at], self.tfs[at], np.full(len(blocks), BLOCK)
        size[-1] = len(gaps) - BLOCK * (len(blocks) - 1)
        run = np.cumsum(gaps, dtype=np.int64)  # the first gap of a block is 0
        starts = np.cumsum(size) - size
        docs = run + np.repeat(self.first[blocks] - run[starts], size)
        return docs, self.part(tfs.astype(np.int64), docs)

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block each document would stand in, -1 before the first one."""
        return np.searchsorted(self.first, docs, side="right") - 1


def best(lists: list[TermList], n_docs: int, rank: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of highest score above 0, equal ones by ``rank``, and their scores."""
    lists = sorted(lists, key=lambda t: t.bound)
    below = np.cumsum([t.bound for t in lists])
    score, seen, least, at = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), 1, len(lists) - 1
    while at >= 0 and below[at] >= least:  # essential: the lists up to this one could carry an unseen document
        docs, parts = lists[at].whole()
        score[docs] += parts
        seen[docs] = True
        least, at = max(least, kth(score[seen], k)), at - 1
    found = np.flatnonzero(seen)
    if at >= 0 and len(found):
        found = found[score[found] + below[at] >= least]
        where = [lists[i].block_of(found) for i in range(at + 1)]
        caps = [np.where(w >= 0, lists[i].bounds[w], 0) for i, w in enumerate(where)]
        rest = np.sum(caps, axis=0)
        for i in range(at, -1, -1):
            keep = score[found] + rest >= least  # rejected before the block is decoded
            found, rest = found[keep], rest[keep]
            where, caps = [w[keep] for w in where], [c[keep] for c in caps]
            if not len(found):
                break
            blocks = np.unique(where[i])
            blocks = blocks[blocks >= 0]
            if len(blocks):
                docs, parts = lists[i].decode(blocks)
                score[docs] += parts
            rest = rest - caps[i]
            least = max(least, kth(score[found], k))
    found = found[score[found] >= least]
    found = found[np.lexsort([rank[found], -score[found]])][:k]
    return found, score[found]


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest score, or 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def search(index: DataFrame, queries: DataFrame, k: int = TOP, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every query."""
    spark, kind = index.sparkSession, dict(queries.dtypes)[item]
    bounded_batches(spark)
    counts = index.where("term IS NULL").select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("n"), F.sum("n")).first()
    n_docs, n_terms = int(counts[0]), int(counts[1] or 1)
    wanted = cut_lineage(query_terms(queries, item, text), "query_terms")
    blocks = max(1, -(-wanted.select("item").distinct().count() // QUERY_BLOCK))
    lists = index.where("term IS NOT NULL")
    df = lists.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    uses = cut_lineage(
        wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))).join(df.select("term", weight.alias("w")), "term")
        .groupBy("term", "w", "block").agg(F.collect_list(F.struct("item")).alias("items")), "uses")
    parts = lists.drop("doc_ids", "lengths").join(uses, "term")
    whole = index.where("term IS NULL").select("shard", "doc_ids", "lengths").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    groups = parts.unionByName(whole.withColumn("block", F.col("block").cast("long")), allowMissingColumns=True).drop("term")
    found = groups.groupBy("shard", "block").applyInArrow(lambda t: _best_of_shard(t, n_docs, n_terms, k), f"item_id {kind}, doc_id long, score long")
    by = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _best_of_shard(group: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    rows = group.combine_chunks()
    lengths = rows["lengths"].combine_chunks()
    (own,) = np.flatnonzero(lengths.is_valid().to_numpy(zero_copy_only=False))
    sizes, ids = lengths[own].values.to_numpy(), rows["doc_ids"].combine_chunks()[own].values
    rank = np.empty(len(sizes), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(sizes))
    pads = 20 * (50 + 50 * sizes.astype(np.int64) * n_docs // n_terms)
    asked: dict = {}
    for row in rows.select(["w", "df", "blocks", "gaps", "tfs", "items"]).to_pylist():
        if row["items"]:
            one = TermList(row["w"], row["df"], row["blocks"], row["gaps"], row["tfs"], pads)
            for use in row["items"]:
                asked.setdefault(use["item"], []).append(one)
    items, docs, scores = [], [], []
    for item, lists in asked.items():
        found, score = best(lists, len(sizes), rank, k)
        items += [item] * len(found)
        docs.append(found)
        scores.append(score)
    kind = rows.schema.field("items").type.value_type.field("item").type
    at = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    return pa.table({"item_id": pa.array(items, kind), "doc_id": ids.take(pa.array(at)),
                     "score": pa.array(np.concatenate(scores) if scores else at, pa.int64())})
