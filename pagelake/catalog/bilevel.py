"""Black-and-white pipeline over whole document texts (and embeddings) as rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .. import inputs as i
from ..arrows import bound_batches, flat, list_sizes, within
from ..operators import bilevel, binarize, raster
from .views import sql

B = i.TEXT_BLOCK


def _bits(spark, d):
    """Text rasters with every dark character as ink."""
    return i.text_lines(spark, d).selectExpr("doc_id", "page_no", "y", "transform(px, g -> CASE WHEN g < 105 THEN 1 ELSE 0 END) AS bit")


# Not a type in words: Spark reads those in a session only, and the queries are listed before there is one.
@F.arrow_udf(StructType().add("checksum", LongType()).add("total", LongType()))
def _sums(px: pa.Array) -> pa.Array:
    """Sum of the values, each times its place from 1 on, and sum of the values of each line."""
    sizes, v = list_sizes(px), flat(px).astype(np.int64)
    ends = np.cumsum(sizes)
    upto = [np.concatenate([[0], np.cumsum(x)]) for x in (v * (within(sizes) + 1), v)]
    return pa.StructArray.from_arrays([pa.array(u[ends] - u[ends - sizes]) for u in upto], names=["checksum", "total"])


def _checksum(df, col, name="checksum"):
    bound_batches(df.sparkSession)
    return df.withColumn("_s", _sums(col)).selectExpr("doc_id", "page_no", "y", f"_s.checksum AS {name}", "_s.total AS total")


def q_luminance(spark, d):
    return _checksum(raster.luminance(i.as_rgb(i.text_lines(spark, d))), "px")


def q_block_stats(spark, d):
    return binarize.block_stats(i.text_lines(spark, d), B).selectExpr(
        "doc_id", "page_no", "by", "bx", "n", "round(mean, 6) AS mean", "round(dev, 6) AS dev")


def q_block_stats_embed(spark, d):
    return binarize.block_stats(i.embed_lines(spark, d), i.EMBED_BLOCK).selectExpr(
        "doc_id", "page_no", "by", "bx", "n", "round(mean, 6) AS mean", "round(dev, 6) AS dev")


def q_block_smooth(spark, d):
    return binarize.block_smooth(binarize.block_stats(i.text_lines(spark, d), B)).selectExpr(
        "doc_id", "page_no", "by", "bx", "round(blurred, 6) AS blurred", "round(blur_dev, 6) AS blur_dev")


def q_dark(spark, d):
    return binarize.dark_page_policy(binarize.block_smooth(binarize.block_stats(i.text_lines(spark, d), B))).selectExpr(
        "doc_id", "page_no", "round(dim_share, 6) AS dim_share", "invert_dark")


def q_background(spark, d):
    lines = i.text_lines(spark, d)
    return binarize.background_at(lines, binarize.block_stats(lines, B), B).selectExpr(
        "doc_id", "page_no", "y", "CAST(floor(array_min(paper) * 1000000 + 0.25D) AS BIGINT) AS m_min",
        "CAST(floor(array_max(paper) * 1000000 + 0.25D) AS BIGINT) AS m_max",
        "aggregate(paper, 0L, (a, m) -> a + CAST(floor(m * 16 + 0.25D) AS BIGINT)) AS m_sum",
        "round(array_max(structure), 6) AS d_max")


def _binarized(spark, d, **kw):
    return binarize.binarize(i.text_lines(spark, d), block=B, **kw)


def q_binarize(spark, d):
    return _checksum(_binarized(spark, d), "bit")


def q_binarize_invert(spark, d):
    return _checksum(_binarized(spark, d, bias=-6, contrast=20, dark_areas="invert"), "bit")


def q_page_qa(spark, d):
    return raster.page_qa(i.as_rgb(i.text_lines(spark, d))).selectExpr(
        "doc_id", "page_no", *[f"round({c}, 6) AS {c}" for c in ("black60", "black128", "white230", "nonwhite245", "coloured")],
        "n_colours")


def q_page_qa_approx(spark, d):
    """Exact shares beside sketched colours; with at most 256 colours a page the sketch still counts."""
    return raster.page_qa_approx(i.as_rgb(i.text_lines(spark, d))).selectExpr(
        "doc_id", "page_no", *[f"round({c}, 6) AS {c}" for c in ("black60", "black128", "white230", "nonwhite245", "coloured")], "n_colours")


def q_document_colours(spark, d):
    """Colours of ten texts together, from the sketches of their pages."""
    qa = raster.page_qa_approx(i.as_rgb(i.text_lines(spark, d)).withColumn("doc_id", F.expr("doc_id div 10")).withColumn("page_no", F.expr("y % 7")))
    return raster.colours_of(qa, "doc_id")


def q_region_qa(spark, d):
    regions = i.table(spark, d, "documents").selectExpr(
        "doc_id", "1 AS page_no",
        "explode(array(named_struct('region', 'left', 'rx0', 0, 'ry0', 0, 'rx1', 20, 'ry1', 1000000), "
        "named_struct('region', 'box', 'rx0', 10, 'ry0', 0, 'rx1', 50, 'ry1', 3))) AS q").selectExpr("doc_id", "page_no", "q.*")
    return raster.page_qa(i.as_rgb(i.text_lines(spark, d)), regions).selectExpr(
        "doc_id", "page_no", "region", *[f"round({c}, 6) AS {c}" for c in ("black60", "black128", "white230", "nonwhite245", "coloured")],
        "n_colours")


def q_changes(spark, d):
    return bilevel.changing_elements(_bits(spark, d)).selectExpr(
        "doc_id", "page_no", "y", "size(changes) AS n_changes", "aggregate(changes, 0L, (a, v) -> a + v) AS pos_sum")


def q_runs(spark, d):
    return bilevel.pixel_runs(_bits(spark, d)).selectExpr("doc_id", "page_no", "y", "k", "colour", "start", "length")


def q_run_bits(spark, d):
    """Runs over the joined text of a document: every length class of the code table occurs."""
    runs = bilevel.pixel_runs(_bits(spark, d)).selectExpr("doc_id", "page_no", "y", "k", "colour", "CAST(length * (1 + y % 90) AS INT) AS length")
    return bilevel.run_code_bits(runs).selectExpr("doc_id", "page_no", "y", "k", "colour", "length", "bits")


def q_pack_bits(spark, d):
    return bilevel.pack_bits(_bits(spark, d)).selectExpr("doc_id", "page_no", "y", "lower(hex(packed)) AS packed")


def q_g4(spark, d):
    return bilevel.g4_line_bits(_bits(spark, d))


def q_deflate(spark, d):
    return bilevel.deflate_size(_bits(spark, d))


def q_page_codec(spark, d):
    from ..operators.estimate import codec_choice

    return codec_choice(bilevel.page_codec_sizes(_bits(spark, d)))


def q_raster_diff(spark, d):
    a = i.text_lines(spark, d)
    b = a.selectExpr("doc_id", "page_no", "y",
                     "transform(CASE WHEN doc_id % 11 = 0 THEN slice(px, 1, 60) ELSE px END, g -> CASE WHEN g = 101 THEN 111 ELSE g END) AS px")
    return raster.raster_diff(a, b)


QUERIES = {
    "luminance": q_luminance, "block_stats": q_block_stats, "block_stats_embed": q_block_stats_embed,
    "block_smooth": q_block_smooth, "dark_page_policy": q_dark, "background_at": q_background, "binarize": q_binarize,
    "binarize_invert": q_binarize_invert, "page_qa": q_page_qa, "page_qa_approx": q_page_qa_approx, "document_colours": q_document_colours, "page_qa_regions": q_region_qa,
    "changing_elements": q_changes, "pixel_runs": q_runs, "run_code_bits": q_run_bits, "pack_bits": q_pack_bits,
    "g4_line_bits": q_g4, "deflate_size": q_deflate, "page_codec_choice": q_page_codec, "raster_diff": q_raster_diff,
}

_BLOCKS = """
SELECT doc_id, page_no, y // {b} AS "by", x // {b} AS bx, count(*) AS n, sum(g) / count(*)::DOUBLE AS mean,
  sqrt(greatest(0, sum(g * g) / count(*)::DOUBLE - (sum(g) / count(*)::DOUBLE) * (sum(g) / count(*)::DOUBLE))) AS dev
FROM {src} GROUP BY ALL"""
_TB = _BLOCKS.format(b=8, src="t_gray")
_SMOOTH = """
SELECT a.doc_id, a.page_no, a."by", a.bx,
  list_reduce(list(b.mean ORDER BY b."by", b.bx), lambda p, q: p + q) / count(*) AS blurred, max(b.dev) AS blur_dev
FROM blocks a JOIN (SELECT bl.*, "by" + oy AS jy, bx + ox AS jx FROM blocks bl,
    (VALUES (-1), (0), (1)) s(oy), (VALUES (-1), (0), (1)) u(ox)) b
  ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a."by" = b.jy AND a.bx = b.jx
GROUP BY a.doc_id, a.page_no, a."by", a.bx"""
_POL = """
SELECT doc_id, page_no, count(*) FILTER (blurred < 110) / count(*)::DOUBLE AS dim_share,
  count(*) FILTER (blurred < 110) / count(*)::DOUBLE <= 0.22 AS invert_dark, max("by") AS my, max(bx) AS mx
FROM smooth GROUP BY doc_id, page_no"""
_BG = """
SELECT p.doc_id, p.page_no, p.y, p.x, p.g, p.invert_dark,
  s00.blurred * (1 - wx) * (1 - wy) + s01.blurred * wx * (1 - wy) + s10.blurred * (1 - wx) * wy + s11.blurred * wx * wy AS m,
  greatest(s00.blur_dev, s01.blur_dev, s10.blur_dev, s11.blur_dev) AS sd
FROM (SELECT *, fy - y0 AS wy, fx - x0 AS wx, least(y0 + 1, my) AS y1, least(x0 + 1, mx) AS x1
      FROM (SELECT *, floor(fy)::BIGINT AS y0, floor(fx)::BIGINT AS x0
        FROM (SELECT t.*, k.my, k.mx, k.invert_dark, least(greatest((y - 4) / 8::DOUBLE, 0), my) AS fy, least(greatest((x - 4) / 8::DOUBLE, 0), mx) AS fx
              FROM t_gray t JOIN pol k ON k.doc_id = t.doc_id))) p
JOIN smooth s00 ON s00.doc_id = p.doc_id AND s00."by" = y0 AND s00.bx = x0
JOIN smooth s01 ON s01.doc_id = p.doc_id AND s01."by" = y0 AND s01.bx = x1
JOIN smooth s10 ON s10.doc_id = p.doc_id AND s10."by" = y1 AND s10.bx = x0
JOIN smooth s11 ON s11.doc_id = p.doc_id AND s11."by" = y1 AND s11.bx = x1"""
_BITS = "SELECT doc_id, page_no, y, x, CASE WHEN g < 105 THEN 1 ELSE 0 END AS bit FROM t_gray"
_EDGE = """
SELECT doc_id, page_no, y, x, bit FROM (SELECT *, lag(bit, 1, 0) OVER (PARTITION BY doc_id, y ORDER BY x) AS p FROM bits) WHERE bit <> p"""
_RUNS = """
SELECT doc_id, page_no, y, CAST(k AS INT) AS k, CAST(k % 2 AS INT) AS colour, s AS start,
  lead(s, 1, 64) OVER (PARTITION BY doc_id, y ORDER BY k) - s AS length
FROM (SELECT doc_id, page_no, y, row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS k, x AS s FROM edge
      UNION ALL SELECT DISTINCT doc_id, page_no, y, 0, 0 FROM bits)"""
_RGB = "SELECT doc_id, page_no, y, x, g AS r, (g * 7) % 256 AS g, (g * 13) % 256 AS b FROM t_gray"
_LUM = "SELECT *, (77 * r + 151 * g + 28 * b) >> 8 AS l, greatest(r, g, b) - least(r, g, b) AS s FROM rgb"
_QA = """round(avg((l < 60)::INT), 6) AS black60, round(avg((l < 128)::INT), 6) AS black128, round(avg((l > 230)::INT), 6) AS white230,
  round(avg((l < 245)::INT), 6) AS nonwhite245, round(avg((s > 40)::INT), 6) AS coloured, count(DISTINCT r * 65536 + g * 256 + b) AS n_colours"""


def _code_lengths():
    """Published code words as rows: colour, kind (t/m), run, bits."""
    from .. import fixed as f

    rows = []
    for c, (t, m) in enumerate(((f.T4_WHITE_TERMINATING, f.T4_WHITE_MAKEUP), (f.T4_BLACK_TERMINATING, f.T4_BLACK_MAKEUP))):
        rows += [f"({c}, {r}, {len(w)})" for r, w in enumerate(t)]
        rows += [f"({c}, {64 * (r + 1)}, {len(w)})" for r, w in enumerate(m + f.T4_SHARED_MAKEUP)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(colour, run, bits)"


_CHAIN = dict(blocks=_TB, smooth=_SMOOTH, pol=_POL, bg=_BG)


def _bw(rule: str) -> str:
    return f"""SELECT doc_id, page_no, y, CAST(sum(CASE WHEN {rule} THEN x + 1 ELSE 0 END) AS BIGINT) AS checksum,
  count(*) FILTER ({rule}) AS total FROM bg GROUP BY ALL"""


SQL = {
    "luminance": sql("""SELECT doc_id, page_no, y, CAST(sum(l * (x + 1)) AS BIGINT) AS checksum, CAST(sum(l) AS BIGINT) AS total
FROM lum GROUP BY ALL""", "t_gray", rgb=_RGB, lum=_LUM),
    "block_stats": sql('SELECT doc_id, page_no, "by", bx, n, round(mean, 6) AS mean, round(dev, 6) AS dev FROM blocks', "t_gray", blocks=_TB),
    "block_stats_embed": sql('SELECT doc_id, page_no, "by", bx, n, round(mean, 6) AS mean, round(dev, 6) AS dev FROM blocks', "e_gray",
                             blocks=_BLOCKS.format(b=2, src="e_gray")),
    "block_smooth": sql('SELECT doc_id, page_no, "by", bx, round(blurred, 6) AS blurred, round(blur_dev, 6) AS blur_dev FROM smooth', "t_gray",
                        blocks=_TB, smooth=_SMOOTH),
    "dark_page_policy": sql("SELECT doc_id, page_no, round(dim_share, 6) AS dim_share, invert_dark FROM pol", "t_gray",
                            blocks=_TB, smooth=_SMOOTH, pol=_POL),
    "background_at": sql("""SELECT doc_id, page_no, y, CAST(floor(min(m) * 1000000 + 0.25) AS BIGINT) AS m_min, CAST(floor(max(m) * 1000000 + 0.25) AS BIGINT) AS m_max,
  CAST(sum(floor(m * 16 + 0.25)) AS BIGINT) AS m_sum, round(max(sd), 6) AS d_max FROM bg GROUP BY ALL""", "t_gray", **_CHAIN),
    "binarize": sql(_bw("""CASE WHEN m >= 110 OR NOT invert_dark THEN g < least(m - 28, 210) WHEN sd < 11 THEN false
  ELSE g < least(greatest(m + 60, m + 20), 165) END"""), "t_gray", **_CHAIN),
    "binarize_invert": sql(_bw("""CASE WHEN m >= 110 THEN g < least(m - 15, 210) WHEN sd < 8.6 THEN false
  ELSE g < least(greatest(m + 66, m + 20), 165) END"""), "t_gray", **_CHAIN),
    "page_qa": sql(f"SELECT doc_id, page_no, {_QA} FROM lum GROUP BY ALL", "t_gray", rgb=_RGB, lum=_LUM),
    "page_qa_approx": sql(f"SELECT doc_id, page_no, {_QA} FROM lum GROUP BY ALL", "t_gray", rgb=_RGB, lum=_LUM),
    "document_colours": sql("SELECT doc_id // 10 AS doc_id, count(DISTINCT r * 65536 + g * 256 + b) AS n_colours FROM rgb GROUP BY ALL", "t_gray", rgb=_RGB),
    "page_qa_regions": sql(f"""SELECT doc_id, page_no, region, {_QA} FROM lum,
  (VALUES ('left', 0, 0, 20, 1000000), ('box', 10, 0, 50, 3)) q(region, rx0, ry0, rx1, ry1)
WHERE x >= rx0 AND x < rx1 AND y >= ry0 AND y < ry1 GROUP BY doc_id, page_no, region""", "t_gray", rgb=_RGB, lum=_LUM),
    "changing_elements": sql("""SELECT b.doc_id, b.page_no, b.y, CAST(count(e.x) AS INT) AS n_changes, CAST(coalesce(sum(e.x), 0) AS BIGINT) AS pos_sum
FROM (SELECT DISTINCT doc_id, page_no, y FROM bits) b LEFT JOIN edge e ON e.doc_id = b.doc_id AND e.y = b.y GROUP BY ALL""",
                             "t_gray", bits=_BITS, edge=_EDGE),
    "pixel_runs": sql("SELECT * FROM runs", "t_gray", bits=_BITS, edge=_EDGE, runs=_RUNS),
    "run_code_bits": sql("""
SELECT r.doc_id, r.page_no, r.y, r.k, r.colour, r.len AS length,
  CAST(12 * n + t.bits + CASE WHEN rest >= 64 THEN m.bits ELSE 0 END AS INT) AS bits
FROM (SELECT *, len - 2560 * n AS rest FROM (SELECT *, CAST(greatest(0, ceil((len - 2623) / 2560)) AS INT) AS n
      FROM (SELECT *, CAST(length * (1 + y % 90) AS INT) AS len FROM runs))) r
JOIN codes t ON t.colour = r.colour AND t.run = rest % 64
LEFT JOIN codes m ON m.colour = r.colour AND rest >= 64 AND m.run = rest - rest % 64""",
                         "t_gray", bits=_BITS, edge=_EDGE, runs=_RUNS, codes=_code_lengths()),
    "pack_bits": sql("""SELECT doc_id, page_no, y, string_agg(printf('%02x', v), '' ORDER BY k) AS packed
FROM (SELECT doc_id, page_no, y, x // 8 AS k, CAST(sum((1 - bit) * (128 >> (x % 8))) AS INT) AS v FROM bits GROUP BY ALL) GROUP BY ALL""",
                     "t_gray", bits=_BITS),
    "raster_diff": sql("""SELECT doc_id, page_no, CASE WHEN any_value(doc_id) % 11 = 0 THEN -1 ELSE count(*) FILTER (g = 101) END AS n_diff
FROM t_gray GROUP BY doc_id, page_no""", "t_gray"),
}
