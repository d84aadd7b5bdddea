"""Secret scans over an incremental blob ledger.

Every historical version of a path is addressed by the SHA-256 of its text: equal
texts, wherever and whenever they occur, are one blob. The ledger records which
blob was scanned by which rule version; a run reads only the pairs it lacks, adds
one row for each (also for blobs without a finding), and joins the findings back
to every path and version that carries the blob. The ledger is a folder of
Parquet files; a run adds one new folder per batch and replaces none, so a
repeated or broken run can only repeat rows, and readers take distinct rows.

One representative (path, version) per blob fetches the text, so that texts are
dealt out by a unique key: neither a hot path nor a blob that a third of all
versions share gathers in a task.

Spans are kind:start:end in code points, end exclusive, of the whole match.

Defined results: null is the empty text, a blob like any other. Rows that repeat
path and version count as one text each. Null paths or versions keep their rows.
"""

from __future__ import annotations

import re
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagelake.session import cut_lineage, scratch_path
from .words import map_batches

# Kind, pattern, the group whose length counts, the least length. Scanned in this order.
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
# Further published token shapes, added by rule version 2.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
]
RULES = {"1": BASE_RULES, "2": BASE_RULES + MORE_RULES}

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
LEDGER = "blob string, rules string, spans array<struct<kind:string,start:long,end:long>>"


def compiled(rules: list[tuple[str, str, int, int]]) -> list[tuple]:
    """Keywords of assignments match in either case, of ASCII letters only."""
    return [(k, re.compile(p, re.A | re.I if k == "assign" else re.A), g, n) for k, p, g, n in rules]


def scan_text(text: str, rules: list[tuple]) -> list[dict]:
    """All spans by start, then by the order of the rules; a match that is too short is dropped but consumed."""
    found = []
    for i, (kind, pattern, group, least) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), i, kind, m.end()))
    return [{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(found)]


def _scan(batch: pa.RecordBatch, version: str) -> pa.RecordBatch:
    rules = compiled(RULES[version])
    spans = [scan_text(t or "", rules) for t in batch.column("text").to_pylist()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("blob"), pa.array([version] * batch.num_rows, pa.string()), pa.array(spans, kind)],
        names=["blob", "rules", "spans"],
    )


def empty_ledger(spark: SparkSession) -> str:
    path = scratch_path(spark, "ledger")
    spark.createDataFrame([], LEDGER).write.parquet(f"{path}/batch=0")
    return path


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{path}/batch=*")


def scan_versions(
    versions: DataFrame, ledger: str, path: str = "path", version: str = "version", rules: str = "2"
) -> DataFrame:
    """path, version, blob and spans of every version; scans what the ledger lacks and adds it there.

    ``versions`` has the path and version columns and ``text``.
    """
    spark = versions.sparkSession
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = versions.select(F.col(path).alias("path"), F.col(version).alias("version"), "text").withColumn("blob", blob)
    paths = cut_lineage(rows.drop("text"), "paths")
    seen = read_ledger(spark, ledger).where(F.col("rules") == rules).select("blob").distinct()
    unseen = (
        paths.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at")).join(seen, "blob", "left_anti")
        .select(F.col("at.path").alias("path"), F.col("at.version").alias("version"), F.col("blob").alias("asked"))
    )
    same = rows["path"].eqNullSafe(unseen["path"]) & rows["version"].eqNullSafe(unseen["version"]) & (
        rows["blob"] == unseen["asked"])
    texts = rows.join(unseen.hint("shuffle_hash"), same, "left_semi").select("blob", "text")
    batch = scratch_path(spark, "batch").rpartition("/")[2]
    map_batches(texts, partial(_scan, version=rules), LEDGER).write.parquet(f"{ledger}/batch={batch}")
    known = read_ledger(spark, ledger).where(F.col("rules") == rules).dropDuplicates(["blob"]).select("blob", "spans")
    return paths.join(known, "blob")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*[r[0] for r in BASE_RULES]))
    return found.select(
        F.col("path").alias("doc_id"), *[count(r[0]) for r in BASE_RULES],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), "blob",
    )
