"""Folder listings, the file sink and its failed attempts; stores named by URI."""

import os
import time

import pyarrow as pa
import pytest

from pagelake import stores
from pagelake.session import scratch_path
from pagelake.sinks import files as sinks, store
from pagelake.sources import folders
from pagelake.streaming import jobs

FILE = "name string, content binary"


def batch(*rows):
    return pa.RecordBatch.from_pylist([{"name": n, "content": c} for n, c in rows], pa.schema([("name", pa.string()), ("content", pa.binary())]))


def tree(root, *paths):
    for p in paths:
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "wb") as f:
            f.write(p.encode())


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_listing_equals_a_walk(spark, tmp_path, depth, scheme):
    tree(tmp_path, "a.pdf", "_b.pdf", ".c.pdf", "x/d.pdf", "_y/_z/e.pdf", "x/.h/f.pdf", "1/2/3/g.pdf", "1/2/3/4/i.pdf")
    want = set()
    for at, dirs, names in os.walk(tmp_path):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        below = os.path.relpath(at, tmp_path)
        level = 0 if below == "." else below.count("/") + 1
        if level <= depth:
            want |= {(n, level, f"{scheme}{at}/{n}") for n in names if not n.startswith(".")}
    got = folders.folder_files(spark, f"{scheme}{tmp_path}", depth).collect()
    assert {(r.name, r.depth, r.path) for r in got} == want and all(r.bytes > 0 and r.modified_ms > 1e12 for r in got)
    assert folders.folder_files(spark, f"{tmp_path}/missing").collect() == []


def test_nothing_is_listed_by_the_driver(spark, tmp_path, monkeypatch):
    tree(tmp_path, "a.pdf", "x/d.pdf")
    df = folders.folder_files(spark, str(tmp_path), 2)
    monkeypatch.setattr(folders, "children", None)  # the driver's copy only
    assert df.count() == 2


def test_stream_sees_underscored_and_later_files(spark, tmp_path):
    root, out, state = tmp_path / "in", scratch_path(spark, "seen"), scratch_path(spark, "state")
    tree(root, "a.pdf", "_b.txt", ".hidden.pdf", "deep/c.pdf")

    def run():
        time.sleep(0.6)
        stream = jobs.intake_stream(spark, str(root), 500)
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.name for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert run() == ["_b.txt", "a.pdf"]
    for name in ("a.pdf", "_b.txt"):  # handed off and cleaned up: the offset stays
        os.remove(root / name)
    assert run() == ["_b.txt", "a.pdf"]
    tree(root, "_d.pdf", "a.pdf")  # a file that is written anew comes again
    assert run() == ["_b.txt", "_d.pdf", "a.pdf", "a.pdf"]
    assert run() == ["_b.txt", "_d.pdf", "a.pdf", "a.pdf"]


def test_files_settle_before_they_are_offered(tmp_path):
    tree(tmp_path, "a")
    reader = folders.FolderStream([str(tmp_path)], 60_000)
    start, end = reader.initialOffset(), reader.latestOffset()
    (part,) = reader.partitions(start, end)
    assert list(reader.read(part)) == [] and reader.latestOffset() == end
    reader.settle_ms = 0
    time.sleep(0.01)
    later = reader.latestOffset()
    assert [e[0] for e in reader.read(reader.partitions(end, later)[0])] == ["a"] and reader.latestOffset() == later


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_files_get_their_names(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/out"
    rows = [(f"f{i}.pdf", bytearray(b"x" * i)) for i in range(50)] + [("ü" * 120, bytearray(b"long name")), ("none", None)]
    got = store.write_files(spark.createDataFrame(rows, FILE).repartition(4), path)
    assert {(r.name, r.bytes) for r in got.collect()} == {(n, len(c or b"")) for n, c in rows}
    assert {n: open(tmp_path / "out" / n, "rb").read() for n in os.listdir(tmp_path / "out")} == {n: bytes(c or b"") for n, c in rows}
    store.write_files(spark.createDataFrame([("f3.pdf", bytearray(b"new"))], FILE), path).collect()
    assert open(tmp_path / "out" / "f3.pdf").read() == "new" and len(os.listdir(tmp_path / "out")) == len(rows)
    assert store.write_files(spark.createDataFrame([], FILE), path).collect() == []


def test_failed_and_repeated_attempts_leave_nothing(spark, tmp_path):
    path = str(tmp_path)

    def broken():
        yield batch(("a", b"half of the task"))
        raise OSError("executor lost")

    writer = store.FileWriter(path, "job")
    with pytest.raises(OSError):
        writer.write(broken())
    twice = [writer.write(iter([batch(("a", b"first try"), ("b", b"b"))])) for _ in range(2)]  # both attempts end, one is accepted
    assert [n for n in os.listdir(path) if not n.startswith("_staging-")] == []
    writer.commit([twice[1], None])
    folder = stores.StagedFolder(path, "job")
    assert sorted(map(tuple, store.publish(spark, folder).collect())) == [("a", 9), ("b", 1)]
    assert sorted(os.listdir(path)) == ["a", "b"]

    other = store.FileWriter(path, "other")
    other.write(iter([batch(("c", b"c"))]))
    other.abort([None])
    assert sorted(os.listdir(path)) == ["a", "b"]


def test_a_failing_job_is_aborted(spark, tmp_path):
    rows = spark.range(8).selectExpr("concat('f', id) AS name", "CAST(if(id = 7, raise_error('lost'), 'x') AS BINARY) AS content")
    with pytest.raises(Exception, match="lost"):
        store.write_files(rows, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_move_done_twice_is_done_once(tmp_path):
    folder = stores.StagedFolder(str(tmp_path))
    with folder.create() as (staged, out):
        out.write(b"abc")
    folder.publish(staged, "x", 3)
    folder.publish(staged, "x", 3)
    assert open(tmp_path / "x").read() == "abc"
    with pytest.raises(FileNotFoundError):
        folder.publish(staged, "x", 4)


def test_streamed_documents(spark, tmp_path):
    parts = [(f"d{k}", 10 * i, bytearray([65 + i]) * 10) for k in range(5) for i in range(k + 1)]
    df = spark.createDataFrame(parts, "name string, offset long, content binary").repartition(3)
    got = store.write_streamed(df, f"file://{tmp_path}")
    assert {(r.name, r.bytes, r.complete) for r in got.collect()} == {(f"d{k}", 10 * (k + 1), True) for k in range(5)}
    mounted = scratch_path(spark, "parts")
    sinks.write_parts(df, mounted)
    for k in range(5):
        assert open(tmp_path / f"d{k}", "rb").read() == open(f"{mounted.removeprefix('file://')}/d{k}", "rb").read()
    with pytest.raises(Exception, match="does not follow"):
        store.write_streamed(df.where("offset <> 10"), f"{tmp_path}/gap")
    assert [n for n in os.listdir(tmp_path / "gap")] == []


def test_small_files_are_replaced_in_one_step(tmp_path):
    assert stores.read_text(f"{tmp_path}/CURRENT") is None
    for text in ("one", "two"):
        stores.replace_text(f"file:{tmp_path}/CURRENT", text)
        assert stores.read_text(f"{tmp_path}/CURRENT") == text and os.listdir(tmp_path) == ["CURRENT"]


def test_images_keep_their_scan_resolution(spark, tmp_path):
    from pagelake.catalog.flow import _png
    from pagelake.sources import files as sources

    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(_png(list(range(64))))
    (tmp_path / "c.png").write_bytes(b"broken")
    dpi = spark.createDataFrame([("a.png", 300), ("c.png", 150)], "name string, scan_dpi int")
    lines, refused = sources.page_images(spark, str(tmp_path), resolutions=dpi)
    assert {(r.name, r.scan_dpi, r.src_w, r.src_h) for r in lines.collect()} == {("a.png", 300, 8, 8), ("b.png", None, 8, 8)}
    assert [(r.name, r.reason) for r in refused.collect()] == [("c.png", "unreadable")]
    assert {r.scan_dpi for r in sources.page_images(spark, str(tmp_path))[0].collect()} == {None}


def test_an_import_replaces_the_whole_profile(spark):
    from pagelake.operators import profile
    from pagelake.sources import files as sources

    docs = [(1, '{"app":"x","signatures":[{"id":"a"}],"stamps":[],"settings":{"p":1}}'), (2, '{"app":"other","signatures":[]}'), (3, '{"app":"x","signatures":[]}')]
    stored = [(1, "signatures", "[9]"), (1, "more", "old"), (2, "settings", "{}"), (4, "stamps", "[4]")]
    now, taken = profile.profile_replace(spark.createDataFrame(stored, "owner long, key string, value string"),
                                         sources.profile_parse(spark.createDataFrame(docs, "owner long, document string"), "x"))
    assert {tuple(r) for r in now.collect()} == {(1, "signatures", '[{"id":"a"}]'), (1, "stamps", "[]"), (1, "settings", '{"p":1}'), (2, "settings", "{}"),
                                                 (3, "signatures", "[]"), (3, "stamps", "[]"), (3, "settings", "{}"), (4, "stamps", "[4]")}
    assert {tuple(r) for r in taken.collect()} == {(1, 1), (3, 0)}
