"""Attempt logs, streams, sources, sinks and document assembly."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from .. import inputs as i
from ..operators import assemble, attempts, profile
from ..plans import chains
from ..session import local_path, scratch_path
from ..sinks import files as sinks
from ..sources import files as sources
from ..streaming import jobs
from .bilevel import _bits
from .profile import SQL as PROFILE_SQL, q_export
from .views import sql

NOW = 1717243200000
TOTAL = 12
KINDS = ["view", "signup", "error", "click", "purchase"]
GAP = "6 hours"


def q_outcome(spark, d):
    return attempts.batch_outcome(i.scan_attempt(spark, d), TOTAL)


def q_outcome_folder(spark, d):
    return attempts.batch_outcome(i.scan_attempt(spark, d), TOTAL, first_tries=3)


def q_summary(spark, d):
    return attempts.batch_summary(i.scan_attempt(spark, d), TOTAL)


def q_retry(spark, d):
    log = i._numbered_events(spark, d, "job_id").selectExpr(
        "job_id", "seq", "CASE event_type WHEN 'view' THEN 503 WHEN 'error' THEN 503 WHEN 'click' THEN 409 WHEN 'purchase' THEN 201 ELSE 400 END AS status")
    return attempts.retry_policy(log)


def q_debounce(spark, d):
    return jobs.debounced_profile(i.profile_change(spark, d), KINDS, GAP)


def q_requests(spark, d):
    return jobs.coalesced_requests(i.profile_change(spark, d), GAP)


def q_pending(spark, d):
    return jobs.collapse_pending(i.profile_change(spark, d))


def _stream(spark, d, name):
    """A table as a stream, be it one file or a folder of them: a pattern may name either, a plain path only a folder."""
    schema = i.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def q_intake_stream(spark, d):
    src = _stream(spark, d, "pages").selectExpr(
        """concat(CASE WHEN page_id % 17 = 0 THEN '.' ELSE '' END, url,
             CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '' END) AS name""",
        "CAST(CASE WHEN page_id % 29 = 0 THEN 0 ELSE length(html) END AS BIGINT) AS bytes")
    return jobs.drain(jobs.intake_rules(src), "intake")


def q_collector(spark, d):
    src = _stream(spark, d, "events").selectExpr(
        "user_id AS batch_id", "ts", "event_id", "event_type <> 'error' AS ok", "value > 200 AS cancel")
    out = scratch_path(spark, "collector")
    jobs.drain_batches(jobs.scan_batch_collector(src, TOTAL), "collector",
                       lambda b, k: b.withColumn("tick", F.lit(k)).write.mode("overwrite").parquet(f"{out}/t={k}"), "update")
    return spark.read.parquet(out).groupBy("batch_id").agg(
        *[F.max_by(c, "tick").alias(c) for c in ("n_pages", "status", "failed_page")])


def _frames(spark, d):
    return i.table(spark, d, "documents").selectExpr(
        "doc_id", "lang AS camera", "timestamp_millis(1704067200000 + doc_id * 60) AS ts")


def q_frames(spark, d):
    return jobs.newest_frames(_frames(spark, d))


def q_frame_corners(spark, d):
    return jobs.frame_corners(jobs.newest_frames(_frames(spark, d)), i.text_lines(spark, d)).selectExpr(
        "camera", "tick", "doc_id", *[f"round(doc_quad[{k}].{a}, 6) AS {a}{k}" for k in range(4) for a in "xy"])


def q_frame_stream(spark, d):
    """The same frames as a stream; frames of a clock in the far future let the watermark close the last tick."""
    clock = "named_struct('doc_id', CAST(NULL AS BIGINT), 'camera', 'clock', 'ts', timestamp'2100-01-01')"
    frame = "named_struct('doc_id', doc_id, 'camera', lang, 'ts', timestamp_millis(1704067200000 + doc_id * 60))"
    stream = _stream(spark, d, "documents").selectExpr(f"explode(if(doc_id % 100 = 0, array({frame}, {clock}), array({frame}))) AS f").select("f.*")
    out = scratch_path(spark, "corners")
    jobs.frame_corner_stream(stream, i.text_lines(spark, d), out)
    return spark.read.parquet(out).selectExpr(
        "camera", "tick", "doc_id", *[f"round(doc_quad[{k}].{a}, 6) AS {a}{k}" for k in range(4) for a in "xy"])


def _finished(spark, d):
    return i.table(spark, d, "pages").selectExpr(
        "page_id AS seq", "concat('Akte ', page_id % 40, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE ' ü.pdf' END) AS name",
        "CAST(CASE WHEN page_id % 31 = 0 THEN '' ELSE html END AS BINARY) AS content", f"{NOW}L AS now_ms")


def q_handoff(spark, d):
    return sinks.handoff(_finished(spark, d), scratch_path(spark, "consume"))[0]


def q_handoff_stream(spark, d):
    src = _stream(spark, d, "pages").selectExpr(
        "page_id AS seq", "concat('Akte ', page_id % 40, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE ' ü.pdf' END) AS name",
        "CAST(CASE WHEN page_id % 31 = 0 THEN '' ELSE html END AS BINARY) AS content", f"{NOW}L AS now_ms")
    receipts = scratch_path(spark, "receipts")
    jobs.auto_handoff_stream(src, scratch_path(spark, "consume"), receipts)
    return spark.read.parquet(receipts).select("name", "bytes")


def q_raw_drop(spark, d):
    existing = i.table(spark, d, "pages").selectExpr("concat('Akte_', page_id % 7, '.pdf') AS name")
    docs = i.table(spark, d, "pages").selectExpr(
        "page_id AS seq", "concat('x/Akte:', page_id % 40, '.pdf') AS name",
        "CAST(CASE WHEN page_id % 31 = 0 THEN '' ELSE html END AS BINARY) AS content", f"{NOW}L + page_id AS now_ms")
    return sinks.raw_drop(docs, existing, scratch_path(spark, "raw"))[0]


def q_save(spark, d):
    out = scratch_path(spark, "saved")
    sinks.save_results(i.table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "concat(o_orderkey, '.pdf') AS out_name", "o_orderdate AS finished_at",
        "CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS error"), out)
    return spark.read.parquet(out).selectExpr("doc_id", "out_name", "CAST(month AS STRING) AS month")


def q_profile_write(spark, d):
    """Write, read back: what a snapshot sees after a replace."""
    out = scratch_path(spark, "profiles")
    docs = q_export(spark, d).withColumn("document", F.expr("CASE WHEN owner % 7 = 0 THEN substring(document, 2, 50) ELSE document END"))
    import os

    os.makedirs(local_path(out), exist_ok=True)
    sinks.profile_write(docs, out)
    return sources.profile_snapshot(spark, out)


def _imported(spark, d):
    docs = q_export(spark, d).withColumn(
        "document", F.expr("""CASE owner % 5 WHEN 0 THEN replace(document, '"app":"pagelake"', '"app":"other"') WHEN 1 THEN replace(document, '"signatures"', '"sigs"') ELSE document END"""))
    return sources.profile_parse(docs, "pagelake")


def q_profile_import(spark, d):
    return _imported(spark, d).select("owner", "reason", "n_signatures")


def q_profile_replace(spark, d):
    stored = i.table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr(
        "c_custkey AS owner", "explode(array('signatures', 'stamps', 'settings')) AS key", "'old' AS value")
    now, _ = profile.profile_replace(stored, _imported(spark, d))
    return now.selectExpr("owner", "key", "value = 'old' AS kept")


def _png(g) -> bytes:
    """8x8 grey page as an RGB PNG file."""
    rows = b"".join(b"\0" + bytes(v for v in g[k * 8:k * 8 + 8] for _ in range(3)) for k in range(8))

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def q_page_images(spark, d):
    """Embeddings written as PNG files by the executors, read back as scanlines."""
    import pandas as pd

    def png(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "content": [b"broken" if bad else _png(g) for g, bad in zip(pdf["g"], pdf["bad"])]})

    src = i.table(spark, d, "embeddings").selectExpr(
        "concat('p', vec_id, '.png') AS name", "vec_id % 50 = 0 AS bad",
        "transform(embedding, v -> greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) * 3 + 1) * 127.5) AS INT)))) AS g")
    folder = scratch_path(spark, "images")
    sinks.write_files(src.mapInPandas(png, "name string, content binary"), folder).count()
    lines, _ = sources.page_images(spark, folder)
    return lines.selectExpr("CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) AS doc_id", "y",
                            "aggregate(g, 0, (a, v) -> a + v) AS total", "src_w", "src_h")


def q_import_folder(spark, d):
    """Page bodies written into a folder tree, found again by the recursive search."""
    import os
    import pandas as pd

    root = local_path(scratch_path(spark, "tree"))

    def put(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:
                    f.write(content)
            yield pdf[["path"]]

    src = i.table(spark, d, "pages").selectExpr(
        "concat(repeat('sub/', CAST(page_id % 5 AS INT)), 'p', page_id, CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END) AS path",
        "CAST(html AS BINARY) AS content")
    src.mapInPandas(put, "path string").count()
    return sources.import_folder(spark, root).select("name", "bytes", "depth")


def _encoded(spark, d):
    """Text rasters as pages of documents of four pages each."""
    pages = assemble.encode_bilevel(_bits(spark, d))
    return pages.selectExpr("doc_id div 4 AS doc_id", "CAST(doc_id % 4 + 1 AS INT) AS page_no", "595.28D AS w_pt", "841.89D AS h_pt",
                            "w_px", "h_px", "codec", "stream", "palette")


def q_assemble(spark, d):
    parts = assemble.assemble_documents(_encoded(spark, d))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("content")).alias("n_bytes"),
                                       F.max(F.col("offset") + F.length("content")).alias("end"))


def q_compress(spark, d):
    """Texts as pages of documents of four: black-and-white, palette, or a picture stream that some pages lack."""
    at = ["doc_id div 4 AS doc_id", "CAST(doc_id % 4 + 1 AS INT) AS page_no"]
    docs = i.table(spark, d, "documents").select("doc_id", "text")
    rgb = i.as_rgb(i.text_lines(spark, d)).selectExpr(*at, "y", "r", "g", "b")
    own = docs.where("doc_id % 3 < 2").selectExpr(
        *at, "CASE doc_id % 3 WHEN 0 THEN 'extrem-sw' ELSE 'extrem-farbe' END AS preset", "CAST(doc_id % 41 AS INT) - 20 AS bias")
    pictures = docs.where("doc_id % 3 = 2 AND doc_id % 5 <> 0").selectExpr(*at, "64 AS w_px", "64 AS h_px", "CAST(text AS BINARY) AS stream")
    parts, left = chains.compress(
        docs.selectExpr(*at, "595.28D AS w_pt", "841.89D AS h_pt"), rgb, own, {"mode": "raster", "color_mode": "color", "dpi": 150}, pictures)
    made = parts.groupBy("doc_id").agg(
        F.sum(F.expr("CAST(part = 'page' AS INT)")).alias("n_pages"),
        (F.sum(F.length("content")) == F.max(F.col("offset") + F.length("content"))).alias("gapless"))
    missed = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_left"))
    return made.join(missed, "doc_id", "full_outer").selectExpr(
        "doc_id", "coalesce(n_pages, 0L) AS n_pages", "coalesce(n_left, 0L) AS n_left", "gapless")


QUERIES = {
    "compress_documents": q_compress,
    "batch_outcome": q_outcome, "batch_outcome_folder": q_outcome_folder, "batch_summary": q_summary, "retry_policy": q_retry,
    "debounced_profile": q_debounce, "coalesced_requests": q_requests, "collapse_pending": q_pending,
    "intake_stream": q_intake_stream, "scan_batch_collector": q_collector, "newest_frames": q_frames,
    "frame_corners": q_frame_corners, "frame_corner_stream": q_frame_stream, "handoff": q_handoff, "auto_handoff_stream": q_handoff_stream, "raw_drop": q_raw_drop,
    "save_results": q_save, "profile_write": q_profile_write, "profile_import": q_profile_import, "profile_replace": q_profile_replace,
    "page_images": q_page_images, "import_folder": q_import_folder, "assemble_documents": q_assemble,
}

_STOP = """
SELECT *, count(*) FILTER (ok) OVER (PARTITION BY batch_id ORDER BY seq) AS done,
  NOT ok AND NOT lag(ok, 1, true) OVER w AND NOT lag(ok, 2, true) OVER w AS third
FROM scan_attempt WINDOW w AS (PARTITION BY batch_id ORDER BY seq)"""


def _ends(first: str) -> str:
    return f"""
SELECT batch_id, min(seq) AS stop, arg_min(why, seq) AS why FROM (
  SELECT batch_id, seq, CASE WHEN {first} THEN 'failed' WHEN cancel THEN 'cancelled' WHEN third THEN 'failed' ELSE 'finished' END AS why
  FROM marks WHERE {first} OR cancel OR third OR (ok AND done = {TOTAL})) GROUP BY batch_id"""


_FIRST = "(seq = 1 AND NOT ok)"
_OUT = """SELECT m.batch_id, seq, done AS page FROM marks m LEFT JOIN ends e ON e.batch_id = m.batch_id WHERE ok AND (stop IS NULL OR seq <= stop)"""
_SUM = """
SELECT m.batch_id, count(*) FILTER (ok AND (stop IS NULL OR seq <= stop)) AS n_pages, coalesce(any_value(why), 'open') AS status,
  CASE WHEN any_value(why) = 'failed' THEN count(*) FILTER (ok AND (stop IS NULL OR seq <= stop)) + 1 END AS failed_page
FROM marks m LEFT JOIN ends e ON e.batch_id = m.batch_id GROUP BY m.batch_id"""
_SESS = """
SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY ts, seq) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
  FROM profile_change WINDOW w AS (PARTITION BY owner ORDER BY ts, seq))"""
_RECEIPTS = rf"""
SELECT name, bytes FROM (SELECT name, bytes, row_number() OVER (PARTITION BY name ORDER BY page_id DESC) AS r
  FROM (SELECT page_id, 'Akte ' || page_id % 40 || CASE WHEN page_id % 3 = 2 THEN ' _.pdf' ELSE '.pdf' END AS name, CAST(strlen(html) AS BIGINT) AS bytes
        FROM pages WHERE page_id % 31 <> 0)) WHERE r = 1"""
_EXPORT = """SELECT c_custkey // 5 AS owner, count(*) FILTER (c_custkey % 5 < 2) AS n FROM customer GROUP BY 1"""

SQL = {
    "compress_documents": """
SELECT doc_id, n_pages, n_left, CASE WHEN n_pages > 0 THEN true END AS gapless FROM (
  SELECT doc_id // 4 AS doc_id, count(*) FILTER (kept) AS n_pages, count(*) FILTER (NOT kept) AS n_left
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text IS NOT NULL ELSE doc_id % 5 <> 0 AND coalesce(length(text), 0) > 0 END AS kept FROM documents)
  GROUP BY 1)""",
    "batch_outcome": sql(_OUT, "scan_attempt", marks=_STOP, ends=_ends(_FIRST)),
    "batch_outcome_folder": sql(_OUT, "scan_attempt", marks=_STOP, ends=_ends("false")),
    "batch_summary": sql(_SUM, "scan_attempt", marks=_STOP, ends=_ends(_FIRST)),
    "scan_batch_collector": sql(_SUM, "scan_attempt", marks=_STOP, ends=_ends(_FIRST)),
    "retry_policy": """
WITH log AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'view' THEN 503 WHEN 'error' THEN 503 WHEN 'click' THEN 409 WHEN 'purchase' THEN 201 ELSE 400 END AS status FROM events)
SELECT job_id, seq, status, 1.5::DOUBLE * (seq - 1) AS wait_s, CASE WHEN status = 201 THEN 'started' WHEN status IN (503, 409) AND seq < 4 THEN 'retry' ELSE 'rejected' END AS result
FROM log l WHERE seq <= 4 AND NOT EXISTS (SELECT 1 FROM log p WHERE p.job_id = l.job_id AND p.seq < l.seq AND p.status NOT IN (503, 409))""",
    "debounced_profile": sql("SELECT owner, flush_at, n_changes, "
        + ", ".join(f"last_value({k} IGNORE NULLS) OVER w AS {k}" for k in KINDS)
        + " FROM (SELECT owner, max(ts) + INTERVAL 6 HOUR AS flush_at, count(*) AS n_changes, "
        + ", ".join(f"arg_max(value, seq) FILTER (key = '{k}') AS {k}" for k in KINDS)
        + " FROM sess GROUP BY owner, s) WINDOW w AS (PARTITION BY owner ORDER BY flush_at ROWS UNBOUNDED PRECEDING)", "profile_change", sess=_SESS),
    "coalesced_requests": sql("""SELECT owner, max(ts) + INTERVAL 6 HOUR AS run_at, count(*) AS n_requests, arg_max(value, seq) AS value
FROM sess GROUP BY owner, s""", "profile_change", sess=_SESS),
    "collapse_pending": sql("SELECT owner, count(*) AS n_requests, arg_max(value, seq) AS value FROM profile_change GROUP BY owner", "profile_change"),
    "intake_stream": r"""
SELECT *, CASE WHEN name ILIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS kind,
  CASE WHEN bytes = 0 THEN 'empty' WHEN bytes > 209715200 THEN 'too large' WHEN NOT regexp_matches(name, '(?i)\.(pdf|jpe?g|png|webp|heic|heif|tiff?|bmp)$') THEN 'unknown ending' END AS reason
FROM (SELECT url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '' END AS name,
  CAST(CASE WHEN page_id % 29 = 0 THEN 0 ELSE length(html) END AS BIGINT) AS bytes FROM pages WHERE page_id % 17 <> 0)""",
    "newest_frames": """
SELECT camera, make_timestamp(t * 1000) AS tick, max(doc_id) AS doc_id
FROM (SELECT doc_id, lang AS camera, (1704067200000 + doc_id * 60) // 350 * 350 AS t FROM documents) GROUP BY camera, t""",
    "handoff": _RECEIPTS,
    "auto_handoff_stream": _RECEIPTS,
    # As the names run out at 498 a stem, later arrivals take their stamp, which no other arrival has.
    "raw_drop": f"""
WITH arr AS (SELECT page_id, strlen(html) AS bytes, 'Akte_' || page_id % 40 AS stem, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS k
  FROM pages WHERE page_id % 31 <> 0), have AS (SELECT DISTINCT page_id % 7 AS h FROM pages)
SELECT CASE WHEN n = 1 THEN stem WHEN n <= 498 THEN stem || '_' || n ELSE stem || '_' || ({NOW} + page_id) END || '.pdf' AS name, bytes
FROM (SELECT page_id, stem, bytes, CASE WHEN h IS NULL THEN k ELSE k + 1 END AS n FROM arr LEFT JOIN have ON 'Akte_' || h = stem)""",
    "save_results": """SELECT o_orderkey AS doc_id, o_orderkey || '.pdf' AS out_name, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderstatus <> 'P'""",
    "profile_write": f"SELECT * FROM ({PROFILE_SQL['profile_export']}) WHERE owner % 7 <> 0",
    "profile_import": f"""SELECT owner, CASE owner % 5 WHEN 0 THEN 'wrong application' WHEN 1 THEN 'no signatures' END AS reason,
  CAST(CASE WHEN owner % 5 > 1 THEN n END AS INT) AS n_signatures FROM ({_EXPORT})""",
    "profile_replace": f"""
WITH imp AS (SELECT owner FROM ({_EXPORT}) WHERE owner % 5 > 1), k AS (SELECT * FROM (VALUES ('signatures'), ('stamps'), ('settings')) v(key))
SELECT owner, key, false AS kept FROM imp, k UNION ALL
SELECT c_custkey, key, true FROM customer, k WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT owner FROM imp)""",
    "page_images": sql("""SELECT doc_id, y, CAST(sum(g) AS INT) AS total, 8 AS src_w, 8 AS src_h FROM e_gray WHERE doc_id % 50 <> 0 GROUP BY doc_id, y""", "e_gray"),
    "import_folder": """SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' ELSE '.PDF' END AS name, strlen(html) AS bytes, CAST(page_id % 5 AS INT) AS depth
FROM pages WHERE page_id % 3 < 2 AND page_id % 5 <= 2""",
}
