"""Folder listings by tasks, and as a stream.

Spark's own file listing runs on the driver and passes over names that begin with ``_``. Here a
folder is listed by a task, and what it holds of sub-folders goes to further tasks; only names that
begin with ``.`` are passed over.

As a stream (format ``folder``), a modification time is the whole offset: nothing that was seen is
remembered, and what is removed after its hand-off changes nothing. A file is offered once it is ``settle_ms`` old, so that
one that is renamed into the folder a little after it was written is not behind the offset; files that appear with an
older time than that are not seen. A stream that is started again must not be given a larger ``settle_ms``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..arrows import map_arrow
from ..stores import children, open_store

FACTS = "name string, bytes long, modified_ms long, path string, depth int"
_ARROW = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("modified_ms", pa.int64()), ("path", pa.string()), ("depth", pa.int32()), ("open", pa.bool_())])


def _prefix(path: str) -> str:
    """What a store leaves out of the paths it gives back."""
    return path.removesuffix(open_store(path)[1])


def _entries(path: str, depth: int, last: int) -> Iterator[tuple]:
    """Files of a folder, and its sub-folders, to be opened where they are not too deep."""
    prefix = _prefix(path)
    for f in children(path):
        if f.base_name.startswith("."):
            continue
        full = prefix + f.path
        if f.type == fs.FileType.File:
            yield f.base_name, f.size, f.mtime_ns // 1_000_000, full, depth, False
        elif f.type == fs.FileType.Directory and depth < last:
            yield f.base_name, None, None, full, depth + 1, True


def _opened(last: int, all_levels: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, waiting = [], []
        for row in batch.to_pylist():
            (waiting if row["open"] else rows).append(tuple(row.values()))
        while waiting:
            *_, path, depth, _ = waiting.pop()
            for entry in _entries(path, depth, last):
                (waiting if entry[-1] and all_levels else rows).append(entry)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(_ARROW), _ARROW)], schema=_ARROW)

    return run


def folder_files(spark: SparkSession, folder: str, max_depth: int = 0) -> DataFrame:
    """FACTS of every file, at most ``max_depth`` folders down. The first level's folders are dealt over the tasks."""
    schema = f"{FACTS}, open boolean"
    root = spark.createDataFrame([(None, None, None, folder.rstrip("/") or "/", 0, True)], schema).coalesce(1)
    found = map_arrow(root, _opened(max_depth, False), schema)
    if max_depth:
        found = map_arrow(found.repartition("path"), _opened(max_depth, True), schema)
    return found.where("NOT open").drop("open")


class FolderStream(DataSourceStreamReader):
    def __init__(self, folders: list[str], settle_ms: int):
        self.folders, self.settle_ms, self.last = folders, settle_ms, None

    def initialOffset(self) -> dict:
        return {"at": -1}

    def latestOffset(self) -> dict:
        """The time up to which files are settled; it moves on only where there are new ones.

        It never comes from the files themselves: when they are removed, it stays.
        """
        until = time.time_ns() // 1_000_000 - self.settle_ms
        if self.last is None or any(self.last < e[2] <= until for folder in self.folders for e in _entries(folder, 0, 0)):
            self.last = until
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((folder, start["at"], end["at"])) for folder in self.folders]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder, start, end = partition.value
        return (entry[:-1] for entry in _entries(folder, 0, 0) if start < entry[2] <= end)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Options: ``path``, one or more folders by line, a partition each; ``settle_ms``."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return FACTS

    def streamReader(self, schema: StructType) -> FolderStream:
        folders = [p.rstrip("/") for p in self.options["path"].split("\n") if p]
        return FolderStream(folders, int(self.options.get("settle_ms", "10000")))


def folder_stream(spark: SparkSession, folder: str, settle_ms: int = 10_000) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").option("settle_ms", settle_ms).load(folder)
