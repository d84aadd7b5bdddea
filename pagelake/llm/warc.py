"""WARC archives in Zstandard form as a Spark source and sink.

An archive is a sequence of Zstandard frames, one per record, so that a record can be
read from its offset alone. Its dictionary stands in a leading skippable frame (magic
0x184D2A5D), itself compressed. The writer fits it to the first TRAIN_BYTES of the
file's own payloads: no sample is gathered anywhere, and every file can be read alone.

    records.write.format("warc").mode("append").save(path)
    spark.read.format("warc").load(path)

``register(spark)`` makes the format known. Writing takes the columns of WRITE_SCHEMA;
reading gives READ_SCHEMA, one row per record. A file is read as a stream, one frame at
a time, by one task. What is not right is reported in ``error``, with file and position,
and reading goes on: after a frame that cannot be decoded, at the next frame's magic number.
Checked are the dictionary, the frame's own checksum, version and header lines, the fields
that every record needs, the declared length against the block, the closing line ends,
that a frame holds one record, and the block and payload digests.

Defined results: a null payload is empty; a null date is EPOCH; a null address is
``about:blank``; white space and control characters in addresses are percent-encoded. An
empty table gives no archive or archives with their opening record only. Very long payloads
need memory for one record at a time. Other columns are not written.

``mark_revisits`` makes records of pages: of equal payloads from MIN_BYTES on, that of the
least page_id is a response, the others name it and carry no payload. Rows that repeat both the least
page_id and the payload are the same record and are all responses. A null page_id comes last:
such rows revisit the least one that is not null, and are responses where there is none.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagelake.session import scratch_path
from pagelake.stores import Staged, StagedFolder, list_files, open_store
from .words import bounded_batches

MIN_BYTES = 100
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 20, 32 << 10, 3
#: A file is closed after so many written bytes; reading takes so many at a time and returns batches of about as many.
FILE_BYTES, CHUNK_BYTES, BATCH_BYTES = 1 << 30, 1 << 20, 8 << 20
EPOCH = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITE_SCHEMA = "record_id string, type string, uri string, date string, payload binary, payload_bytes long, payload_digest string, refers_to string"
READ_SCHEMA = (
    "file string, position long, length long, record_id string, type string, uri string, date string, refers_to string, "
    "payload_digest string, http_length long, headers map<string,string>, payload binary, error string"
)
NEEDED = ("warc-record-id", "warc-type", "warc-date", "content-length")


def address(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else "about:blank"


def record(kind: str, record_id: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, **fields,
            "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone; both state the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    fields = {"WARC-Date": row["date"] or EPOCH, "WARC-Target-URI": address(row["uri"]), "Content-Type": "application/http;msgtype=response",
              "WARC-Payload-Digest": f"sha256:{row['payload_digest']}"}
    if row["type"] == "revisit":
        return record("revisit", row["record_id"], fields | {"WARC-Profile": REVISIT, "WARC-Refers-To": row["refers_to"]}, http)
    return record("response", row["record_id"], fields, http + (row["payload"] or b""))


def fitted(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for these records, or none where there are too few to fit one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:
        return None


def skippable(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.folder = StagedFolder(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        done, rows = Staged({}, 0), self._records(iterator)
        first = next(rows, None)
        while first is not None:
            name = f"{TaskContext.get().partitionId():05d}-{len(done.files):03d}-{self.folder.job[:12]}.warc.zst"
            with self.folder.create(name) as (staged, out):
                first, written = self._file(out, name, first, rows)
            done.files[staged] = name
            done.rows += written
        return done

    @staticmethod
    def _records(iterator: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in iterator:
            for row in batch.to_pylist():
                yield page_record(row)

    @staticmethod
    def _file(out, name: str, first: bytes, rows: Iterator[bytes]) -> tuple[bytes | None, int]:
        """Fill one archive; returns the record that begins the next one, if any, and how many were written."""
        waiting, size = [first], len(first)
        while size < TRAIN_BYTES and (more := next(rows, None)) is not None:
            waiting.append(more)
            size += len(more)
        about = dict(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=1, write_checksum=1))
        if (words := fitted(waiting)) is not None:
            out.write(skippable(zstandard.ZstdCompressor(level=19).compress(words.as_bytes())))
            words.precompute_compress(compression_params=about["compression_params"])
            about["dict_data"] = words
        press = zstandard.ZstdCompressor(**about).compress
        info = {"WARC-Date": EPOCH, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
        opening = record("warcinfo", f"<urn:sha256:{hashlib.sha256(name.encode()).hexdigest()}>", info, b"format: WARC File Format 1.1\r\n")
        written = out.write(press(opening))
        for one in waiting:
            written += out.write(press(one))
        count = len(waiting)
        for one in rows:
            if written >= FILE_BYTES:
                return one, count
            written += out.write(press(one))
            count += 1
        return None, count

    def commit(self, messages: list[Staged | None]) -> None:
        self.folder.commit(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self.folder.abort()


class Frames:
    """Frames of a stream with their positions: (position, length, bytes or None, what is wrong or None)."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.ended = stream, b"", 0, False

    def more(self) -> bool:
        chunk = b"" if self.ended else self.stream.read(CHUNK_BYTES)
        self.ended = not chunk
        self.held += chunk
        return bool(chunk)

    def need(self, n: int) -> bool:
        while len(self.held) < n and self.more():
            pass
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n

    def resume(self) -> None:
        """Go on at the next frame's magic number, or to the end."""
        magic = struct.pack("<I", FRAME_MAGIC)
        self.drop(1)
        while (found := self.held.find(magic)) < 0:
            self.drop(max(0, len(self.held) - 3))
            if not self.more():
                found = len(self.held)
                break
        self.drop(found)

    def skippable(self) -> bytes | None:
        """The content of the skippable frame that stands here, read past; none if it is cut off."""
        (size,) = struct.unpack("<I", self.held[4:8]) if self.need(8) else (0,)
        whole = self.need(8 + size) and len(self.held) >= 8
        data = self.held[8 : 8 + size] if whole else None
        self.drop(8 + size if whole else len(self.held))
        return data

    def decoder(self) -> tuple[zstandard.ZstdDecompressor, str | None]:
        """Loaded with the dictionary, if the stream begins with one, and what is wrong with that."""
        plain = zstandard.ZstdDecompressor()
        if not self.need(4) or struct.unpack("<I", self.held[:4])[0] != DICTIONARY_MAGIC:
            return plain, None
        data = self.skippable()
        try:
            if data and struct.unpack("<I", data[:4])[0] == FRAME_MAGIC:
                data = plain.decompress(data)
            return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)), None
        except (zstandard.ZstdError, TypeError, ValueError, struct.error):
            return plain, "dictionary"

    def __iter__(self) -> Iterator[tuple[int, int, bytes | None, str | None]]:
        unpack, wrong = self.decoder()
        if wrong:
            yield 0, self.at, None, wrong
        while self.need(4) or self.held:
            start, magic = self.at, int.from_bytes(self.held[:4], "little")
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if self.skippable() is None:
                    yield start, self.at - start, None, "frame is cut off"
                continue
            one, parts, wrong = unpack.decompressobj(), [], None
            try:
                # What was read beyond the frame comes back and begins the next one.
                data = self.held
                while True:
                    parts.append(one.decompress(data))
                    if one.eof:
                        used = len(self.held) - len(one.unused_data)
                        break
                    before = len(self.held)
                    if not self.more():
                        wrong, used = "frame is cut off", len(self.held)
                        break
                    data = self.held[before:]
            except zstandard.ZstdError:
                wrong = "frame cannot be decoded"
            if wrong == "frame cannot be decoded" or (wrong and self.held.find(struct.pack("<I", FRAME_MAGIC), 1) > 0):
                self.resume()
            else:
                self.drop(used)
            yield start, self.at - start, None if wrong else b"".join(parts), wrong


def parse(data: bytes) -> dict:
    """The record in a frame, with ``error`` where something is not as it must be."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {"error": "header has no end"}
    version, *lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", version):
        return {"error": "version"}
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            return {"error": "header line"}
        try:
            headers[name.decode().lower()] = value.strip(b" \t").decode()
        except UnicodeDecodeError:
            return {"error": "header line"}
    out = {"headers": headers, "record_id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "uri": headers.get("warc-target-uri"),
           "date": headers.get("warc-date"), "refers_to": headers.get("warc-refers-to"), "error": None}
    if missing := [n for n in NEEDED if n not in headers]:
        return out | {"error": f"no {missing[0]}"}
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        return out | {"error": "length"}
    length, rest = int(headers["content-length"]), data[end + 4 :]
    if len(rest) != length + 4:
        return out | {"error": "length" if len(rest) < length + 4 else "more than one record in a frame"}
    if rest[length:] != b"\r\n\r\n":
        return out | {"error": "no closing line ends"}
    block = rest[:length]
    return out | {"error": wrong_digest(headers.get("warc-block-digest"), block)} | http_parts(headers, block, out["type"])


def wrong_digest(stated: str | None, data: bytes, what: str = "block digest") -> str | None:
    """None where the digest is right, absent, or of a kind that is not known here."""
    if stated and stated.lower().startswith("sha256:") and len(stated) == 71 and stated[7:].lower() != hashlib.sha256(data).hexdigest():
        return what
    return None


def http_parts(headers: dict[str, str], block: bytes, kind: str | None) -> dict:
    stated = headers.get("warc-payload-digest")
    digest = stated[7:].lower() if stated and stated.lower().startswith("sha256:") else None
    out: dict = {"payload_digest": digest, "payload": block, "http_length": None}
    if not headers.get("content-type", "").startswith("application/http"):
        return out
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return out | {"payload": None, "error": "HTTP header has no end"}
    if found := re.search(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", block[:end]):
        out["http_length"] = int(found[1])
    payload = block[end + 4 :]
    if kind == "revisit":
        return out | {"payload": None}
    out["payload"] = payload
    if wrong := wrong_digest(stated, payload, "payload digest"):
        out["error"] = wrong
    if out["http_length"] not in (None, len(payload)):
        out["error"] = "HTTP length"
    return out


ARROW = pa.schema([
    ("file", pa.string()), ("position", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()),
    ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("error", pa.string()),
])


def read_archive(path: str, name: str) -> Iterator[pa.RecordBatch]:
    store, inner = open_store(path)
    rows, size = [], 0
    with store.open_input_stream(inner, compression=None) as stream:
        for position, length, data, wrong in Frames(stream):
            found = parse(data) if data is not None else {"error": wrong}
            found["headers"] = list(found.get("headers", {}).items())
            rows.append({"file": name, "position": position, "length": length, **found})
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class ArchiveReader(DataSourceReader):
    """One partition per archive."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f.base_name) for f in list_files(self.path, ".warc.zst")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_archive(f"{self.path}/{partition.value}", partition.value) if partition.value else iter(())


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("archives are added to, not replaced: use mode append")
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """WRITE_SCHEMA of pages with page_id, url and html.

    Only digests and ids are grouped; a payload that half of all pages share is one
    row there, and the pages meet it in a join whose hot side can be split.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("uri"), body.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.substring("payload_digest", 1, 32), F.lit(">"))
    return rows.join(first, "payload_digest", "left").select(
        name("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("type"), "uri",
        F.lit(EPOCH).alias("date"), F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, name("_first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    bounded_batches(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").load(path)


def resolve(records: DataFrame) -> DataFrame:
    """Responses and revisits with payload_bytes and payload_digest of the full payload.

    A revisit takes both from the response it names; where that is missing, or differs from what
    the revisit states, ``error`` says so. Responses that hundreds of thousands revisit meet them in a join.
    """
    own = records.where("type = 'response'").select(
        "record_id", "type", "uri", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "error")
    known = own.where("error IS NULL").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    stated = records.where("type = 'revisit'").select("record_id", "type", "uri", "refers_to", "error", F.col("http_length").alias("_n"), F.col("payload_digest").alias("_d"))
    wrong = F.when(F.col("payload_digest").isNull(), "no response").when(
        ~(F.col("_n").eqNullSafe(F.col("payload_bytes")) & F.col("_d").eqNullSafe(F.col("payload_digest"))), "differs from its response")
    again = stated.join(known, "refers_to", "left").withColumn("error", F.coalesce("error", wrong)).select(*own.columns)
    return own.unionByName(again)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives below the shared folder, or at ``path``, read them back, and give one row a page.

    Anything that reading finds wrong ends the query, as a row would be missing.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(mark_revisits(pages), path)
    found = read_archives(spark, path)
    broken = found.where("error IS NOT NULL AND coalesce(type, '') NOT IN ('response', 'revisit')").select(
        "record_id", F.lit("damaged").alias("type"), "uri", "refers_to", F.lit(None).cast("long").alias("payload_bytes"), "payload_digest", "error")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1)
    whole = F.when(F.col("error").isNull(), F.col("record_id")).otherwise(F.raise_error(F.concat(F.lit("archive: "), F.col("error"))).cast("string"))
    return resolve(found).unionByName(broken).withColumn("record_id", whole).select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), number("refers_to").cast("long").alias("refers_to"),
    )
