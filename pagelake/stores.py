"""Files in whatever store a path names, from tasks and from the driver.

A path is a plain folder or the URI of a store that pyarrow knows (``file``, ``hdfs``,
``s3``, ``gs``, ``abfs``); nothing here needs a folder that all machines mount.

Writers stage: a task writes below ``_staging-<job>`` and hands its receipt to the
driver with its commit message. Only ``commit`` moves staged files to their names,
and only those of the attempts that Spark accepted; ``abort`` removes the whole
staging folder, so that a failed, repeated or speculative attempt leaves nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyarrow import NativeFile, fs
from pyspark.sql.datasource import WriterCommitMessage

STAGING = "_staging-"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path inside it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def list_files(path: str, suffix: str = "") -> list[fs.FileInfo]:
    """Finished files of a folder by name, without hidden and staged ones; none where the folder is missing."""
    store, inner = open_store(path)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    wanted = (f for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")
    return sorted(wanted, key=lambda f: f.base_name)


def children(path: str, recursive: bool = False) -> list[fs.FileInfo]:
    """Everything below a folder; none where it is missing."""
    store, inner = open_store(path)
    return store.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=recursive))


def remove_file(path: str) -> None:
    """One that is already gone counts as removed."""
    store, inner = open_store(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        store.delete_file(inner)


def read_text(path: str) -> str | None:
    store, inner = open_store(path)
    if store.get_file_info(inner).type != fs.FileType.File:
        return None
    with store.open_input_stream(inner) as f:
        return f.read().decode()


def replace_text(path: str, text: str) -> None:
    """A small file in one step: readers see the old or the new content."""
    folder, _, name = path.rpartition("/")
    job = StagedFolder(folder)
    with job.create() as (staged, out):
        out.write(text.encode())
    job.commit([Staged({staged: name}, 1)])


@dataclass
class Staged(WriterCommitMessage):
    """What a task hands over: staged name -> final name, and how many rows they hold."""

    files: dict[str, str]
    rows: int


class StagedFolder:
    """One write job into a folder; the same object serves its tasks and its driver."""

    def __init__(self, path: str, job: str | None = None):
        self.path, self.job = path.rstrip("/"), job or uuid.uuid4().hex

    @property
    def staging_path(self) -> str:
        return f"{self.path}/{STAGING}{self.job}"

    @property
    def staging(self) -> str:
        return open_store(self.staging_path)[1]

    @contextmanager
    def create(self, label: str = "") -> Iterator[tuple[str, NativeFile]]:
        """A new staged file's name, which ends in ``label``, and the file to write; removed if the block fails."""
        store, _ = open_store(self.path)
        staged = uuid.uuid4().hex + label
        store.create_dir(self.staging, recursive=True)
        try:
            with store.open_output_stream(f"{self.staging}/{staged}", compression=None) as out:
                yield staged, out
        except BaseException:
            if store.get_file_info(f"{self.staging}/{staged}").type == fs.FileType.File:
                store.delete_file(f"{self.staging}/{staged}")
            raise

    def publish(self, staged: str, name: str, size: int | None = None) -> None:
        """Give a staged file its name, in place of what has it. Done twice, with its size known, it is done once."""
        store, inner = open_store(self.path)
        if size is not None and store.get_file_info(f"{self.staging}/{staged}").type == fs.FileType.NotFound:
            if store.get_file_info(f"{inner}/{name}").size == size:
                return
        store.move(f"{self.staging}/{staged}", f"{inner}/{name}")

    def commit(self, messages: list[Staged | None]) -> None:
        """Publish what the accepted tasks hand over, from the driver: for a few files a task."""
        for message in filter(None, messages):
            for staged, name in message.files.items():
                self.publish(staged, name)
        self.abort()

    def abort(self) -> None:
        store, _ = open_store(self.path)
        if store.get_file_info(self.staging).type == fs.FileType.Directory:
            store.delete_dir(self.staging)
