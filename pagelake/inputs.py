"""Logical inputs (pages, scanlines, files, words, ...) over the driver tables.

Every input is the whole table and the whole text. A document's text is its
raster: 64 characters per scanline, the last line padded with white.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .arrows import as_lists, bound_batches
from .keys import ordered_index

TEXT_WIDTH = 64
TEXT_LINES = 8192  # lines of a piece of text
TEXT_BLOCK = 8
PAGE_BYTES = 2 << 20  # of documents as they are stored, for a partition of their lines
EMBED_BLOCK = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows over the cores: expanding a text or vector into pixels multiplies the work per input byte."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def raw_file(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr(
        """concat(CASE WHEN page_id % 17 = 0 THEN '.' ELSE '' END, url,
             CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.txt' ELSE '' END) AS name""",
        "CAST(length(html) AS BIGINT) AS bytes",
        "1704067200000 + ((page_id * 37) % 101) * 60000 AS modified_ms",
    )


def page(spark, sf_dir):
    """One row per line item: a page of the document named by the order."""
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_shipdate",
    )
    numbered = ordered_index(
        items, ["doc_id"], F.floor(F.col("l_linenumber") / 1024),
        ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"],
        "page_no",
    )
    return numbered.selectExpr(
        "doc_id", "CAST(page_no AS INT) AS page_no",
        "200 + l_quantity * 60 AS w_pt",
        "CAST(280 + (l_partkey % 40) * 60 AS DOUBLE) AS h_pt",
        "CAST(floor(l_extendedprice) AS BIGINT) AS orig_bytes",
    )


_FACTORS = [
    ("verlustfrei", 0.97), ("leicht", 0.6), ("mittel", 0.4), ("stark", 0.25),
    ("extrem-grau", 0.15), ("extrem-farbe", 0.1), ("extrem-sw", 0.05),
]


def page_bytes(pages: DataFrame) -> DataFrame:
    """Measured size of every page under every preset (seven rows per page)."""
    factors = ", ".join(f"struct('{k}' AS preset, {f}D AS factor)" for k, f in _FACTORS)
    return pages.selectExpr(
        "doc_id", "page_no", "orig_bytes", f"explode(array({factors})) AS m"
    ).selectExpr(
        "doc_id", "page_no", "m.preset AS preset",
        "CAST(floor(orig_bytes * m.factor) AS BIGINT) AS bytes",
    )


def page_override(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "1 + quality AS page_no",
        """CASE doc_id % 8 WHEN 0 THEN 'verlustfrei' WHEN 1 THEN 'leicht' WHEN 2 THEN 'mittel'
             WHEN 3 THEN 'stark' WHEN 4 THEN 'extrem-grau' WHEN 5 THEN 'extrem-farbe'
             WHEN 6 THEN 'extrem-sw' ELSE 'unknown' END AS preset""",
        "CAST(doc_id % 81 AS INT) - 40 AS bias",
    )


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _rasters(pieces: pa.Array) -> pa.Array:
    """Lines of code points modulo 256 of each piece of text, the last one padded; one line where there is no text."""
    px, rows = [], []
    for raw in pieces.cast(pa.binary()).to_pylist():
        line = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) % 256
        rows.append(max(1, -(-len(line) // TEXT_WIDTH)))
        px.append(np.pad(line.astype(np.int32), (0, rows[-1] * TEXT_WIDTH - len(line)), constant_values=255))
    ends = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
    lines = as_lists(np.concatenate([*px, np.zeros(0, np.int32)]), np.full(ends[-1], TEXT_WIDTH), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends), lines)


def sized_text_lines(spark, sf_dir, dealt=True):
    """Grey scanlines of every whole document text (doc_id, page_no, h, y, px); h is known before lines are made.

    Characters become numbers in Arrow batches, of pieces of a text; rows stay where their document is, or
    where it was read if it is not ``dealt`` out over the cores first.
    """
    bound_batches(spark)
    piece = TEXT_LINES * TEXT_WIDTH
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    docs = spread(docs, "doc_id") if dealt else docs
    cut = docs.selectExpr(
        "doc_id", f"CAST(greatest(1, (length(text) + {TEXT_WIDTH - 1}) div {TEXT_WIDTH}) AS INT) AS h",
        f"""posexplode(CASE WHEN length(text) <= {piece} THEN array(text) ELSE
            transform(sequence(0, CAST((length(text) - 1) div {piece} AS INT)), k -> substring(text, k * {piece} + 1, {piece})) END) AS (part, piece)""")
    return cut.select("doc_id", "h", "part", F.posexplode(_rasters("piece")).alias("at", "px")).selectExpr(
        "doc_id", "1 AS page_no", "h", f"CAST(part * {TEXT_LINES} + at AS INT) AS y", "px")


def text_lines(spark, sf_dir):
    return sized_text_lines(spark, sf_dir).drop("h")


def page_lines(spark, sf_dir, doc_id="doc_id", page_no="1"):
    """``text_lines``, each page's lines in one partition: they are exchanged once, one narrow plane, and joins by page leave them where they are.

    For steps that join by page before they run Python: a Python function forgets how its input lies. ``doc_id`` and ``page_no`` name the page.
    """
    size = int(table(spark, sf_dir, "documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PAGE_BYTES)
    narrow = sized_text_lines(spark, sf_dir, dealt=False).selectExpr(
        f"{doc_id} AS doc_id", f"CAST({page_no} AS INT) AS page_no", "y", "CAST(px AS ARRAY<SMALLINT>) AS px")
    return narrow.repartition(n, "doc_id", *([] if page_no == "1" else ["page_no"])).selectExpr(
        "doc_id", "1 AS page_no" if page_no == "1" else "page_no", "y", "CAST(px AS ARRAY<INT>) AS px")


def embed_lines(spark, sf_dir):
    """Embeddings as 8x8 grey pages."""
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id").selectExpr(
        "vec_id AS doc_id",
        """transform(embedding, v -> greatest(0, least(255,
             CAST(floor((CAST(v AS DOUBLE) * 3 + 1) * 127.5) AS INT)))) AS g""",
    ).selectExpr(
        "doc_id", "1 AS page_no", "posexplode(transform(sequence(0, 7), y -> slice(g, y * 8 + 1, 8))) AS (y, px)"
    )


def as_rgb(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "doc_id", "page_no", "y", "px AS r",
        "transform(px, g -> (g * 7) % 256) AS g", "transform(px, g -> (g * 13) % 256) AS b",
    )


def embed_rgb(spark, sf_dir):
    return as_rgb(embed_lines(spark, sf_dir))


def word(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) + 1 AS page_no",
        r"posexplode(split(text, '[ \\n\\t]+')) AS (idx, text)",
    ).selectExpr(
        "doc_id", "page_no", "idx", "text",
        "CAST((idx * 13 + length(text) * 7) % 100 AS INT) AS confidence",
        "CAST((idx % 12) * 50 AS DOUBLE) AS x0", "CAST(floor(idx / 12) * 14 AS DOUBLE) AS y0",
        "CAST((idx % 12) * 50 + length(text) * 6 AS DOUBLE) AS x1",
        "CAST(floor(idx / 12) * 14 + 12 AS DOUBLE) AS y1",
    )


def redaction(spark, sf_dir):
    """One black box per page for every third conversation."""
    return table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) + 1 AS page_no", "40.0D AS rx", "0.0D AS ry",
        "180.0D AS rw", "30.0D AS rh",
    ).distinct()


def _numbered_events(spark, sf_dir, key):
    ev = table(spark, sf_dir, "events").withColumnRenamed("user_id", key)
    return ordered_index(ev, [key], F.date_trunc("day", "ts"), ["ts", "event_id"], "seq")


def scan_attempt(spark, sf_dir):
    return _numbered_events(spark, sf_dir, "batch_id").selectExpr(
        "batch_id", "seq", "ts", "event_type <> 'error' AS ok", "value > 200 AS cancel"
    )


def profile_change(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS owner", "event_type AS key", "value", "ts", "event_id AS seq"
    )


def stroke_point(spark, sf_dir):
    return _numbered_events(spark, sf_dir, "stroke_id").selectExpr(
        "stroke_id", "CAST(seq AS INT) AS seq", "value AS x", "CAST(event_id % 100 AS DOUBLE) AS y"
    )
