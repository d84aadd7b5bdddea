"""Writers for finished documents, intake files and profiles.

All of them write to any store that ``stores`` reaches. A file becomes visible only
when a staged, complete one gets its name, so a repeated or lost task can never leave half
a file under a final name. On a mounted folder the parts of a document are written in place.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..fixed import PROFILE_LIMIT
from ..functions import names as n
from ..functions.text import valid_json
from ..operators.intake import allocate_names, validate_upload
from ..session import cut_lineage, local_path
from ..stores import open_store, remove_file, replace_text
from .store import write_files, write_streamed


def handoff(results: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Deliver (seq, name, content, now_ms) under cleaned names: (receipts, rejects).

    Names may repeat and the last one wins. The winner is found without the
    contents; only winning contents are moved.
    """
    named = results.withColumn("name", F.expr(n.safe_pdf_name("name", "now_ms"))).withColumn("bytes", F.length("content"))
    rejects = named.where("coalesce(bytes, 0) = 0").selectExpr("seq", "name", "'empty' AS reason")
    full = named.where("bytes > 0")
    winners = full.groupBy("name").agg(F.max("seq").alias("seq"))
    return write_files(full.join(winners, ["name", "seq"], "left_semi"), folder), rejects


def raw_drop(files: DataFrame, existing: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Add (seq, name, content, now_ms) to the intake folder under free names: (receipts, rejects)."""
    safe = files.withColumn("name", F.expr(n.safe_raw_name("name", "now_ms"))).withColumn("bytes", F.length("content"))
    checked = validate_upload(safe)
    good = checked.where("reason IS NULL")
    free = allocate_names(good.select("seq", "name", "now_ms"), existing).select("seq", "free_name")
    placed = good.join(free, "seq").select(F.col("free_name").alias("name"), "content")
    return write_files(placed, folder), checked.where("reason IS NOT NULL").select("seq", "name", "reason")


def save_results(results: DataFrame, folder: str) -> None:
    """Successful results as parquet, one folder a month.

    Rows are gathered by month and a busy month is split by size, into as many
    files as it needs.
    """
    out = results.where("error IS NULL").withColumn("month", F.date_format("finished_at", "yyyy-MM"))
    out.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(folder)


def _put_parts(folder: str, run_id: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for name, offset, content in zip(pdf["name"], pdf["offset"], pdf["content"]):
                fd = os.open(os.path.join(folder, f".{name}.{run_id}.part"), os.O_CREAT | os.O_WRONLY)
                try:
                    os.pwrite(fd, content, offset)
                finally:
                    os.close(fd)
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    return run


def _publish(folder: str, run_id: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for name, size in zip(pdf["name"], pdf["bytes"]):
                part, final = os.path.join(folder, f".{name}.{run_id}.part"), os.path.join(folder, name)
                if os.path.exists(part) and os.path.getsize(part) == size:
                    os.replace(part, final)
                ok.append(os.path.exists(final) and os.path.getsize(final) == size)
            yield pdf.assign(complete=ok)

    return run


def write_parts(parts: DataFrame, folder: str) -> DataFrame:
    """Write documents given as (name, offset, content) parts of any length.

    On a mounted folder every part goes to its own offset, so one long document is written by many
    tasks. Files are renamed only after all part receipts are stored. Other stores have no
    writing in places: there a document passes through one task as a stream.
    """
    if not isinstance(open_store(folder)[0], fs.LocalFileSystem):
        return write_streamed(parts, folder)
    run_id = uuid.uuid4().hex[:8]
    put = cut_lineage(parts.select("name", "offset", "content").mapInPandas(_put_parts(local_path(folder), run_id), "name string, bytes long"), "parts")
    whole = put.groupBy("name").agg(F.sum("bytes").alias("bytes"))
    return cut_lineage(whole.mapInPandas(_publish(local_path(folder), run_id), "name string, bytes long, complete boolean"), "published")


def delete_files(files: DataFrame, folder: str) -> DataFrame:
    """Remove intake files by name; one that is already gone counts as removed."""
    folder = folder.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["name"]:
                remove_file(f"{folder}/{os.path.basename(name)}")
            yield pd.DataFrame({"name": pdf["name"], "removed": True})

    return cut_lineage(files.select("name").mapInPandas(run, "name string, removed boolean"), "removed")


def profile_check(profiles: DataFrame) -> DataFrame:
    """Reason a profile document is refused, null for valid ones."""
    return profiles.withColumn(
        "reason",
        F.expr(f"""CASE WHEN octet_length(document) > {PROFILE_LIMIT} THEN 'too large'
                     WHEN NOT ({valid_json('document')}) THEN 'not json' END"""),
    )


def profile_write(profiles: DataFrame, folder: str) -> DataFrame:
    """Replace all stored profiles (owner, document) in one step; refused rows are returned.

    A new version is written beside the old one; a one-line pointer file is
    then swapped, so readers see the old or the new state, never a mixture.
    """
    checked = profile_check(profiles)
    version = f"v-{uuid.uuid4().hex[:12]}"
    checked.where("reason IS NULL").select("owner", "document").write.parquet(f"{folder}/{version}")
    replace_text(f"{folder}/CURRENT", version)
    return checked.where("reason IS NOT NULL")
