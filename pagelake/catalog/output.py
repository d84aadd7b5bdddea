"""Page rasters at their target size, the hidden word layer and documents that carry it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import inputs as i
from ..functions.text import STANDARD_EXTRA
from ..operators import assemble, layout, resample, textlayer
from ..operators.raster import PAGE
from .views import sql

# A text page counts as scanned at 300 dpi and is brought to one of five resolutions, one of them higher.
_DPI = "CASE doc_id % 5 WHEN 0 THEN 150 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 300 ELSE 450 END"


def q_resample(spark, d):
    lines = i.sized_text_lines(spark, d).selectExpr("*", "64 * 0.24D AS w_pt", "h * 0.24D AS h_pt", f"{_DPI} AS dpi", "'gray' AS color_mode")
    return resample.resample(layout.target_size(lines).select(*PAGE, "h", "y", "px", "w_px", "h_px"))


def _pages(spark, d):
    return i.table(spark, d, "conversations").selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) + 1 AS page_no", "CAST(100 + (conv_id + turn) % 3 * 50 AS DOUBLE) AS dpi", "841.89D AS h_pt").distinct()


def _layer(spark, d):
    return textlayer.place_words(i.word(spark, d), _pages(spark, d))


def q_word_operators(spark, d):
    return textlayer.word_operators(_layer(spark, d))


def q_searchable_documents(spark, d):
    """Where every page, tree node and index entry of the conversations' documents goes, and the text of pages and tree."""
    encoded = _pages(spark, d).selectExpr(
        *PAGE, "595.5D AS w_pt", "h_pt", "8 AS w_px", "8 AS h_px", "'g4' AS codec", "unhex('0011223344556677') AS stream",
        "CAST(NULL AS STRING) AS palette").where("(doc_id + page_no) % 7 <> 0")
    parts = assemble.assemble_documents(encoded, _layer(spark, d), chunk=2)
    return parts.select("doc_id", "part", "offset", F.length("content").cast("long").alias("bytes"), F.crc32("content").alias("crc")).where("part <> 'header'")


QUERIES = {"resample": q_resample, "word_operators": q_word_operators, "searchable_documents": q_searchable_documents}

_RESAMPLE = f"""
WITH t AS (
  SELECT doc_id, l, len(l) AS h, greatest(1, CAST(floor(64 * 0.24::DOUBLE * (({_DPI}) / 72::DOUBLE) + 0.5) AS BIGINT)) AS tw,
         greatest(1, CAST(floor(len(l) * 0.24::DOUBLE * (({_DPI}) / 72::DOUBLE) + 0.5) AS BIGINT)) AS th
  FROM (SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '(?s).{{1,64}}') END AS l FROM documents)),
 s AS (SELECT doc_id, h, tw, th, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS y FROM t),
 p AS (SELECT doc_id, h, tw, th, y, x, CASE WHEN x < length(line) THEN unicode(substring(line, CAST(x AS INT) + 1, 1)) % 256 ELSE 255 END AS g FROM s, range(0, 64) r(x)),
 a AS (SELECT *, unnest(range(x * tw // 64, ((x + 1) * tw - 1) // 64 + 1)) AS tx FROM p),
 m AS (SELECT doc_id, h, th, y, tx, sum(g * (least((x + 1) * tw, (tx + 1) * 64) - greatest(x * tw, tx * 64))) AS v FROM a GROUP BY ALL),
 b AS (SELECT *, unnest(range(y * th // h, ((y + 1) * th - 1) // h + 1)) AS ty FROM m),
 o AS (SELECT doc_id, ty, tx, h, sum(v * (least((y + 1) * th, (ty + 1) * h) - greatest(y * th, ty * h))) AS v FROM b GROUP BY ALL)
SELECT doc_id, 1 AS page_no, CAST(ty AS INT) AS y, list(CAST((2 * v + 64 * h) // (128 * h) AS INT) ORDER BY tx) AS px FROM o GROUP BY doc_id, ty
"""

_NUMBER = "regexp_replace(CAST(floor(({}) * 100 + 0.5) / 100 AS VARCHAR), '\\.0$', '')"
_PLACED = r"""
SELECT w.doc_id, w.page_no, idx, t, x0 * s AS x, h_pt - y1 * s AS y, greatest(2, least(72, (y1 - y0) * s)) AS size
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM word) w
JOIN (SELECT DISTINCT conv_id AS doc_id, CAST(turn AS INT) + 1 AS page_no, 72 / CAST(100 + (conv_id + turn) % 3 * 50 AS DOUBLE) AS s, 841.89::DOUBLE AS h_pt
      FROM conversations) p ON p.doc_id = w.doc_id AND p.page_no = w.page_no
WHERE t <> '' AND (y1 - y0) * s > 0.1 AND NOT regexp_matches(t, '[^\n\r\t\f\x0B\x20-\x7E\xA0-\xFF""" + STANDARD_EXTRA + """]')"""
_CODES = "[" + ", ".join(str(b) for b in STANDARD_EXTRA.encode("cp1252")) + "]"
_OPERATORS = f"""
SELECT doc_id, page_no, 'BT 3 Tr' || chr(10) || string_agg('/F0 ' || {_NUMBER.format('size')} || ' Tf 1 0 0 1 ' || {_NUMBER.format('x')} || ' ' || {_NUMBER.format('y')}
    || ' Tm <' || array_to_string(list_transform(string_split(t, ''), lambda c: format('{{:02X}}',
         CASE WHEN strpos('{STANDARD_EXTRA}', c) > 0 THEN ({_CODES})[strpos('{STANDARD_EXTRA}', c)] ELSE unicode(c) END)), '') || '> Tj', chr(10) ORDER BY idx)
    || chr(10) || 'ET' AS operators
FROM placed GROUP BY doc_id, page_no"""

SQL = {
    "resample": _RESAMPLE,
    "word_operators": sql("SELECT * FROM operators", "word", placed=_PLACED, operators=_OPERATORS),
}
