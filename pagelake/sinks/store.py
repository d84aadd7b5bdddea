"""Files as a Spark sink, in any store that ``stores`` reaches.

    files.write.format("files").mode("append").option("path", folder).option("job", job).save()

takes rows of name and content. A task stages its files, each under a name of its own, and one
manifest; its commit message names the manifest only, so that the driver gets one line a task. ``commit`` accepts
the manifests of the attempts that Spark counts, ``abort`` clears everything. ``publish`` then gives the accepted files their
names, in tasks again: a move can be repeated, so that a lost executor does no harm, and files of failed or
speculative attempts are in no accepted manifest and go with the staging folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..arrows import bound_batches, map_arrow
from ..session import cut_lineage
from ..stores import StagedFolder, open_store, read_text

ACCEPTED = "ACCEPTED"


@dataclass
class Manifest(WriterCommitMessage):
    staged: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.folder = StagedFolder(path, job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Manifest:
        lines = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with self.folder.create() as (staged, out):
                    out.write(content or b"")
                lines.append(json.dumps({"staged": staged, "name": name, "bytes": len(content or b"")}))
        with self.folder.create() as (manifest, out):
            out.write("\n".join(lines).encode())
        return Manifest(manifest)

    def commit(self, messages: list[Manifest | None]) -> None:
        store, _ = open_store(self.folder.path)
        store.create_dir(self.folder.staging, recursive=True)
        with store.open_output_stream(f"{self.folder.staging}/{ACCEPTED}") as out:
            out.write("\n".join(m.staged for m in messages if m).encode())

    def abort(self, messages: list[Manifest | None]) -> None:
        self.folder.abort()


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("a file takes the place of one of the same name; the folder is not cleared: use mode append")
        return FileWriter(self.options["path"], self.options["job"])


def _published(folder: StagedFolder):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes = [], []
        for manifest in batch.column("manifest").to_pylist():
            for line in filter(None, (read_text(f"{folder.staging_path}/{manifest}") or "").split("\n")):
                one = json.loads(line)
                folder.publish(one["staged"], one["name"], one["bytes"])
                names.append(one["name"])
                sizes.append(one["bytes"])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return run


def publish(spark: SparkSession, folder: StagedFolder) -> DataFrame:
    """Receipts (name, bytes) of the files that now have their names, stored before the staging folder goes."""
    accepted = (read_text(f"{folder.staging_path}/{ACCEPTED}") or "").split("\n")
    rows = spark.createDataFrame([(m,) for m in accepted if m], "manifest string").repartition(max(1, len(accepted)))
    receipts = cut_lineage(map_arrow(rows, _published(folder), "name string, bytes long"), "receipts")
    folder.abort()
    return receipts


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write (name, content) rows under their names; receipts (name, bytes) of what can now be read. Names must be unique."""
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    bound_batches(spark)
    folder = StagedFolder(path, uuid.uuid4().hex)
    files.selectExpr("CAST(name AS STRING) AS name", "CAST(content AS BINARY) AS content").write.format("files").mode("append").option(
        "path", path).option("job", folder.job).save()
    return publish(spark, folder)


def write_streamed(parts: DataFrame, path: str) -> DataFrame:
    """Documents given as (name, offset, content) parts, for stores where a file cannot be written in places.

    The parts of a document pass through one task in order of their offsets, one batch at a time;
    a gap or an overlap ends the job before anything gets its name. Receipts as ``write_parts``.
    """
    spark, folder = parts.sparkSession, StagedFolder(path)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, name, size = None, None, 0
        done: list[tuple[str, str, int]] = []

        def close() -> None:
            if open_one is not None:
                open_one.__exit__(None, None, None)
                done.append((staged, name, size))

        try:
            for batch in batches:
                for one, offset, content in zip(*(batch.column(c).to_pylist() for c in ("name", "offset", "content"))):
                    if one != name:
                        close()
                        open_one = folder.create()
                        (staged, out), name, size = open_one.__enter__(), one, 0
                    if offset != size:
                        raise ValueError(f"{name}: the part at {offset} does not follow {size} bytes")
                    out.write(content)
                    size += len(content)
            close()
        except BaseException as error:
            if open_one is not None:
                open_one.__exit__(type(error), error, error.__traceback__)
            raise
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["staged", "name", "bytes"])

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        for row in batch.to_pylist():
            folder.publish(row["staged"], row["name"], row["bytes"])
        return pa.RecordBatch.from_arrays([batch.column("name"), batch.column("bytes"), pa.array([True] * batch.num_rows)], names=["name", "bytes", "complete"])

    try:
        ordered = parts.select("name", "offset", "content").repartition("name").sortWithinPartitions("name", "offset")
        staged = cut_lineage(ordered.mapInArrow(run, "staged string, name string, bytes long"), "staged")
        return cut_lineage(map_arrow(staged, named, "name string, bytes long, complete boolean"), "published")
    finally:
        folder.abort()
