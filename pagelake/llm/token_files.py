"""Token ids as Parquet list columns, in ascending doc_id order.

The texts are dealt out by ranges of doc_id and sorted, so that file after file
holds ascending ids. A row is doc_id, n_tokens and tokens. Token ids are
dictionary-coded (a page of bit-packed indexes into the ids that occur), doc_id
and n_tokens delta-coded; the size of row groups and pages is set here and page
indexes are written, so a reader of some documents, or of lengths only, skips
what it does not need. Files come from Spark's own writer: commit, retries and
lost executors are its matter, in whatever store the path names.

Reading back gives each document's start, the ids of all documents before it in
the files, from file totals and positions inside a file.

Encoding uses the tokenizers library on whole texts. Where its splitter is the usual one of byte-level
vocabularies, it never joins a space that stands between two non-space characters to what is
left of it; then the texts of a batch are cut into the stretches between such spaces, every different stretch
is looked up once a batch, and its ids are kept for the next time it occurs. A text with any other
white space next to a space, and every text under another splitter, is encoded in one piece.

Defined results: null and empty texts have the end id alone. Null doc_ids come
first; rows that repeat a doc_id follow each other in the order of their text's
hash. An empty table gives files without rows.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelake.session import scratch_path
from .ranks import before_in_order
from .words import map_batches

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 20_000
# ASCII marks, without the apostrophe.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words and other stretches a worker remembers in one generation; it keeps the one before, too.
REMEMBERED = 500_000
#: Bytes of text that are cut into stretches at a time, about.
SLICE_BYTES = 3 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the named vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as one letter: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Stretches(dict):
    """Ids of a stretch as bytes, or None if it touches other white space; encoded on first sight.

    Words of Latin letters are one piece for the splitter and go to the vocabulary's
    model at once. Marks after a letter or digit are a piece of their own, and so is
    a single line end between two others, so that such parts are looked up apart.
    """

    def __init__(self, encoder: "Encoder", space: str):
        super().__init__()
        self.encoder, self.space, self.before = encoder, space, {}

    def __missing__(self, part: str) -> bytes | None:
        mark, word = self.encoder.marks.get(part[-1:]), part[:-1]
        if mark is not None and word.isalpha():
            return self[word] + mark  # put together again each time, so that words alone fill the memory
        ids = self.before.get(part)
        if ids is None:
            if part.isalpha():
                ids = self.encoder.word(self.space, part)
            elif "\n" in part:
                return self.found(part)
            else:
                ids = self.found(part)
        if len(self) >= REMEMBERED:
            self.turn()
        self[part] = ids
        return ids

    def all_of(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each of these stretches; words that are not known yet are encoded in one call."""
        out, fresh, open_ = list(map(self.get, parts)), {}, []
        get, before, mark_of = self.get, self.before, self.encoder.marks.get
        for n, ids in enumerate(out):
            if ids is None:
                part = parts[n]
                mark = mark_of(part[-1:])
                word = part if mark is None else part[:-1]
                if word.isalpha():
                    ids = get(word) if mark is not None else None
                    if ids is not None:
                        out[n] = ids + mark
                        continue
                    if word not in before:
                        fresh[word] = None
                open_.append(n)
        if fresh and self.space:
            self.encoder.learn(fresh)
        for n in open_:
            out[n] = self[parts[n]]
        return out

    def turn(self) -> None:
        """Begin a generation; what is asked for again comes back from the one before."""
        self.before = dict(self)
        self.clear()

    def found(self, part: str) -> bytes | None:
        if part[-1:].isspace() or (self.space and (not part or part[0].isspace())):
            return None
        if self.encoder.special(part):
            return self.encoder.whole(self.space + part)
        cut = len(part.rstrip(MARKS))
        if 0 < cut < len(part) and part[cut - 1].isalnum():
            return _joined(self[part[:cut]], self.encoder.first[part[cut:]])
        head, line_end, rest = part.partition("\n")
        if line_end and head and not head[-1].isspace() and not rest[0].isspace():
            return _joined(self[head], self.encoder.line_end, self.encoder.first[rest])
        return self.encoder.whole(self.space + part)


def _joined(*parts: bytes | None) -> bytes | None:
    return None if None in parts else b"".join(parts)


class Encoder:
    """Whole texts to ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        #: Whether stretches between spaces can be encoded apart.
        self.apart = made.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        #: Ids whose spelling begins with a space.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(byte_letters()[32])]] = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.line_end, self.marks = self.whole("\n"), {m: self.whole(m) for m in MARKS}
        self.first, self.rest = _Stretches(self, ""), _Stretches(self, " ")

    def whole(self, text: str) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array("I", found.ids).tobytes()

    def word(self, space: str, letters: str) -> bytes:
        """A word of letters; ASCII letters spell themselves."""
        if letters.isascii():
            spelt = self.letters[32] + letters if space else letters
        elif max(letters) < "\u0250":
            spelt = (space + letters).encode().decode("latin-1").translate(self.letters)
        else:
            return self.whole(space + letters)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids of one text, as little-endian unsigned 32-bit integers."""
        ids, _ = self.batch(pa.array([text]), 0)
        return ids[:-1].astype("<u4").tobytes()

    def learn(self, fresh: dict[str, None]) -> None:
        """Encode these words, which are not known yet, all in one call.

        A word's first id is the only one that spells a space, which tells the words apart.
        """
        known = self.rest
        data = self.whole(" " + " ".join(fresh))
        starts = 4 * np.flatnonzero(self.spaced[np.frombuffer(data, "<u4")])
        if len(known) + len(fresh) >= REMEMBERED:
            known.turn()
        for word, a, b in zip(fresh, starts.tolist(), [*starts[1:].tolist(), len(data)]):
            known[word] = data[a:b]

    def in_pieces(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts cut at every space: all ids one after another, the number of ids of each text, and where it cannot be told like this."""
        starts = lists.offsets.to_numpy()[:-1]
        coded = lists.values.dictionary_encode()
        parts, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        head = np.zeros(len(code), bool)
        head[starts] = True  # a text has one stretch at least
        found, piece = [], np.empty(len(code), np.int64)
        for at, table in ((head, self.first), (~head, self.rest)):
            own, seen = code[at], np.zeros(len(parts), bool)
            seen[own] = True
            piece[at] = (np.cumsum(seen) + (len(found) - 1))[own]
            found += table.all_of([parts[k] for k in np.flatnonzero(seen).tolist()])
        unknown = np.zeros(len(found), bool)
        if None in found:
            unknown[[n for n, ids in enumerate(found) if ids is None]] = True
            found = [ids or b"" for ids in found]
        ids = np.frombuffer(b"".join(found), "<i4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, size = (np.cumsum(sizes) - sizes)[piece], sizes[piece]
        before = np.cumsum(size) - size
        wide = np.int32 if size.sum() < 1 << 31 else np.int64
        take = np.repeat((begin - before).astype(wide), size)
        take += np.arange(len(take), dtype=wide)
        flat = ids[take]
        return flat, np.add.reduceat(size, starts), np.logical_or.reduceat(unknown[piece], starts)

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with ``end_id`` after each, and the number of ids of each text."""
        texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
        flat, sizes, whole = self.in_pieces(pc.split_pattern(texts, " ")) if self.apart else (np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.ones(len(texts), bool))
        ends = np.cumsum(sizes)
        if whole.any():
            at = np.flatnonzero(whole)
            parts = [flat[e - n : e] for e, n in zip(ends, sizes)]
            for i, one in zip(at, self.tokenizer.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)):
                parts[i] = np.array(one.ids, np.int32)
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        sizes = sizes + 1
        out = np.full(sizes.sum(), end_id, np.int32)
        mark = np.ones(len(out), bool)
        mark[np.cumsum(sizes) - 1] = False
        out[mark] = flat
        return out, sizes


@lru_cache(maxsize=2)
def _encoder(path: str | None, name: str) -> Encoder:
    return Encoder(path or tokenizer_path(name))


def encode(docs: DataFrame, path: str | None = None, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens and tokens (with the end id) of every row, in the order of the rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, step = batch.column("text"), max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        parts = [_encoder(path, name).batch(texts.slice(at, step), end_id) for at in range(0, batch.num_rows, step)]
        ids, sizes = (np.concatenate(p) for p in zip(*parts))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(ids))], names=["doc_id", "n_tokens", "tokens"]
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, tokens array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, name: str = TOKENIZER) -> None:
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"))
    ordered = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        encode(ordered, tokenizer, name).write
        .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def _placed(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(
        *columns, F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """file, row, doc_id and start of every document, from lengths alone: no token page is read."""
    lengths = _placed(spark, path, "doc_id", "n_tokens").withColumn("g", F.lit(0))
    return before_in_order(lengths, ["g"], "file", ["row"], F.col("n_tokens"), "start").drop("g", "n_tokens")


def _checksums(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column("tokens")
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
    sums = [crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column("file"), batch.column("row"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
        names=["file", "row", "n_tokens", "ids_crc32"],
    )


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    sums = map_batches(
        _placed(spark, path, "tokens"), _checksums, "file int, row long, n_tokens long, ids_crc32 long"
    )
    return token_index(spark, path).join(sums, ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files below the shared folder, or at ``path``, and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path)
    return read_checked(spark, path)
