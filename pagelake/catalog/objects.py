"""Page objects, ink, forms, page edits and the word layer."""

from __future__ import annotations

from .. import inputs as i
from ..operators import objects, textlayer
from .views import sql


def q_extent(spark, d):
    t = i.table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", "8 + turn % 9 AS size")
    return objects.text_extent(t).selectExpr("conv_id", "turn", "round(text_w, 6) AS text_w", "round(text_h, 6) AS text_h")


def q_clean(spark, d):
    t = i.table(spark, d, "documents").selectExpr("doc_id", "text")
    return objects.winansi_clean(t, "text").selectExpr("doc_id", "drawable", "drawn_text")


def q_signature(spark, d):
    p = i.page(spark, d).selectExpr(
        "doc_id", "page_no", "CASE orig_bytes % 3 WHEN 0 THEN 'signature' WHEN 1 THEN 'image_stamp' ELSE 'stamp' END AS kind",
        "CASE WHEN orig_bytes % 4 = 0 THEN NULL ELSE (orig_bytes % 4 - 1) * 1.5D END AS aspect", "w_pt AS page_w",
        "w_pt / 2 AS tap_x", "h_pt / 3 AS tap_y")
    return objects.place_signature(p).selectExpr("doc_id", "page_no", *[f"round({c}, 6) AS {c}" for c in "xywh"])


def q_normalize(spark, d):
    p = i.stroke_point(spark, d).withColumnRenamed("stroke_id", "sig_id")
    return objects.normalize_strokes(p).selectExpr(
        "sig_id", "seq", "round(x, 6) AS x", "round(y, 6) AS y", "round(aspect, 6) AS aspect")


def q_simplify(spark, d):
    return objects.simplify_stroke(i.stroke_point(spark, d), 40)


def q_smooth(spark, d):
    return objects.smooth_stroke(i.stroke_point(spark, d), 40)


def q_merge_ink(spark, d):
    s = i.table(spark, d, "events").selectExpr(
        "user_id AS doc_id", "1 AS page_no", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'whiteout' ELSE 'draw' END AS tool",
        "CASE WHEN value > 20 THEN '#000000' ELSE '#1a4fd6' END AS color", "CASE WHEN value > 120 THEN 3D ELSE 2D END AS width",
        "event_type = 'click' AS marker")
    return objects.merge_ink(s)


def _objects(spark, d):
    return i.page(spark, d).selectExpr(
        "doc_id", "1 AS page_no", "page_no AS z",
        "CASE orig_bytes % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'ink' WHEN 3 THEN 'rect' ELSE 'stamp' END AS type",
        "CAST(orig_bytes % 500 AS DOUBLE) AS x", "CAST(orig_bytes % 700 AS DOUBLE) AS y", "20 + w_pt / 10 AS w", "10 + h_pt / 10 AS h",
        "concat('Zeile ', orig_bytes, '\\nzweite Zeile') AS text", "CAST(10 + orig_bytes % 8 AS DOUBLE) AS size")


def q_hit(spark, d):
    pts = i.table(spark, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "1 AS page_no", "o_orderkey AS point_id", "CAST(floor(o_totalprice) % 600 AS DOUBLE) AS px",
        "CAST(floor(o_totalprice / 7) % 800 AS DOUBLE) AS py")
    return objects.objects_at_points(pts, _objects(spark, d), 7.5).select("doc_id", "page_no", "point_id", "px", "py", "hit_z")


def q_erase_ink(spark, d):
    ev = i.table(spark, d, "events")
    pts = i.stroke_point(spark, d).selectExpr(
        "stroke_id % 20 AS doc_id", "1 AS page_no", "stroke_id", "2 + stroke_id % 4 AS width", "seq", "x", "y")
    er = ev.where("value > 250").selectExpr("event_id % 20 AS doc_id", "1 AS page_no", "value - 100 AS x", "CAST(event_id * 7 % 100 AS DOUBLE) AS y")
    return objects.erase_ink(pts, er).select("doc_id", "page_no", "stroke_id", "seq", "x", "y")


def q_redact(spark, d):
    return objects.redact_words(i.word(spark, d), i.redaction(spark, d)).select("doc_id", "page_no", "idx", "text")


def _fields(spark, d):
    return i.table(spark, d, "part").selectExpr(
        "p_partkey AS doc_id", "p_name AS name", "CASE p_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' ELSE 'choice' END AS type", "p_type AS value")


def _values(spark, d):
    return i.table(spark, d, "part").where("p_partkey % 3 <> 0").selectExpr(
        "p_partkey AS doc_id", "CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, '?') ELSE p_name END AS name",
        "CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' ELSE p_brand END AS value")


def q_form_fill(spark, d):
    return objects.form_fill(_fields(spark, d), _values(spark, d))


def q_form_warnings(spark, d):
    return objects.form_warnings(_fields(spark, d), _values(spark, d))


def q_labels(spark, d):
    plan = i.page(spark, d).selectExpr("doc_id", "page_no * 10 AS pos", "w_pt AS view_w")
    return objects.page_number_labels(plan).selectExpr("doc_id", "pos", "label", "round(x, 6) AS x", "y", "size")


def q_edit(spark, d):
    ops = i.table(spark, d, "events").selectExpr(
        "user_id AS doc_id", "event_id AS seq",
        """element_at(array('insert_blank', 'insert_image', 'move_left', 'move_right', 'duplicate', 'rotate', 'delete', 'to_a4',
             'undo', 'redo', 'delete', 'undo'), CAST(event_id % 12 + 1 AS INT)) AS op""",
        "CAST(floor(value) % 6 AS INT) AS at", "CAST(user_id % 5 + 1 AS INT) AS n_pages")
    return objects.edit_replay(ops)


def q_ocr(spark, d):
    word = """named_struct('text', ws[i], 'confidence', CASE WHEN i % 17 <> 0 THEN (i * 13 + length(ws[i]) * 7) % 100 END,
        'bbox', CASE WHEN i % 19 <> 0 THEN named_struct('x0', i % 10 * 50, 'y0', i div 10 * 14, 'x1', i % 10 * 50 + length(ws[i]) * 6, 'y1', i div 10 * 14 + 12) END)"""
    nest = f"""transform(sequence(0, (size(ws) - 1) div 60), b -> named_struct('paragraphs',
        transform(sequence(b * 2, least(b * 2 + 1, (size(ws) - 1) div 30)), p -> named_struct('lines',
        transform(sequence(p * 3, least(p * 3 + 2, (size(ws) - 1) div 10)), l -> named_struct('words',
        transform(sequence(CAST(l * 10 AS INT), CAST(least(l * 10 + 9, size(ws) - 1) AS INT)), i -> {word})))))))"""
    ocr = i.table(spark, d, "conversations").selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) + 1 AS page_no",
        rf"transform(array(split(text, '[ \\n\\t]+')), ws -> {nest})[0] AS blocks")
    return textlayer.ocr_words(ocr)


def q_place_words(spark, d):
    pages = i.table(spark, d, "conversations").selectExpr(
        "conv_id AS doc_id", "CAST(turn AS INT) + 1 AS page_no", "150 + conv_id % 3 * 75 AS dpi", "841.89D AS h_pt")
    return textlayer.place_words(i.word(spark, d), pages).selectExpr(
        "doc_id", "page_no", "idx", "text", *[f"round({c}, 6) AS {c}" for c in ("x", "y", "size")])


def q_searchable(spark, d):
    return textlayer.searchable_text(i.word(spark, d))


QUERIES = {
    "text_extent": q_extent, "winansi_clean": q_clean, "place_signature": q_signature, "normalize_strokes": q_normalize,
    "simplify_stroke": q_simplify, "smooth_stroke": q_smooth, "merge_ink": q_merge_ink, "objects_at_points": q_hit,
    "erase_ink": q_erase_ink, "redact_words": q_redact, "form_fill": q_form_fill, "form_warnings": q_form_warnings,
    "page_number_labels": q_labels, "edit_replay": q_edit, "ocr_words": q_ocr, "place_words": q_place_words,
    "searchable_text": q_searchable,
}

_BAD = r"[^\n\r\t\f\x0B\x20-\x7E\x{A0}-\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_KEPT = """
SELECT stroke_id, seq, x, y FROM fold WHERE keep OR seq = n"""
_FOLD = """
SELECT p.stroke_id, p.seq, p.x, p.y, p.x AS kx, p.y AS ky, true AS keep, n FROM pts p WHERE seq = 1
UNION ALL
SELECT p.stroke_id, p.seq, p.x, p.y, CASE WHEN sqrt((p.x - kx) * (p.x - kx) + (p.y - ky) * (p.y - ky)) >= 40 THEN p.x ELSE kx END,
  CASE WHEN sqrt((p.x - kx) * (p.x - kx) + (p.y - ky) * (p.y - ky)) >= 40 THEN p.y ELSE ky END,
  sqrt((p.x - kx) * (p.x - kx) + (p.y - ky) * (p.y - ky)) >= 40, p.n
FROM fold f JOIN pts p ON p.stroke_id = f.stroke_id AND p.seq = f.seq + 1"""
_PTS = "SELECT *, count(*) OVER (PARTITION BY stroke_id) AS n FROM stroke_point"


def _folded(body: str, **extra: str) -> str:
    return sql(body, "stroke_point", pts=_PTS, fold=_FOLD, kept=_KEPT, **extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _num(e: str) -> str:
    return rf"regexp_replace(CAST(floor(({e}) * 100 + 0.5) / 100 AS VARCHAR), '\.0$', '')"


_FIELDS = """SELECT p_partkey AS doc_id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' ELSE 'choice' END AS type, p_type AS value FROM part"""
_VALUES = """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN p_name || '?' ELSE p_name END AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' ELSE p_brand END AS value FROM part WHERE p_partkey % 3 <> 0"""

SQL = {
    "text_extent": r"""
SELECT conv_id, turn, round(list_max([length(l) for l in string_split(text, chr(10))]) * (8 + turn % 9) * 0.55::DOUBLE, 6) AS text_w,
  round(len(string_split(text, chr(10))) * (8 + turn % 9) * 1.25::DOUBLE, 6) AS text_h FROM conversations""",
    "winansi_clean": rf"""
SELECT doc_id, NOT regexp_matches(text, '{_BAD}') AS drawable, CASE WHEN regexp_matches(text, '{_BAD}')
  THEN regexp_replace(regexp_replace(text, '[\x{{10000}}-\x{{10FFFF}}]', '??', 'g'), '[^\x20-\x{{FF}}€„“”‚‘’–—]', '?', 'g') ELSE text END AS drawn_text
FROM documents""",
    "place_signature": sql("""
SELECT doc_id, page_no, round(w_pt / 2 - w / 2, 6) AS x, round(h_pt / 3 - h / 2, 6) AS y, round(w, 6) AS w, round(h, 6) AS h
FROM (SELECT *, CASE k WHEN 2 THEN 56 WHEN 1 THEN 160 / CASE WHEN a IS NULL OR a = 0 THEN 2.5 ELSE a END ELSE w / CASE WHEN a IS NULL OR a = 0 THEN 3 ELSE a END END AS h
  FROM (SELECT doc_id, page_no, w_pt, h_pt, orig_bytes % 3 AS k, CASE WHEN orig_bytes % 4 <> 0 THEN (orig_bytes % 4 - 1) * 1.5::DOUBLE END AS a,
    CASE orig_bytes % 3 WHEN 2 THEN 170 WHEN 1 THEN 160 ELSE least(180, w_pt * 0.4::DOUBLE) END AS w FROM page))""", "page"),
    "normalize_strokes": sql("""
SELECT stroke_id AS sig_id, seq, round((x - x0) / greatest(1e-6, x1 - x0), 6) AS x, round((y - y0) / greatest(1e-6, y1 - y0), 6) AS y,
  round(greatest(1e-6, x1 - x0) / greatest(1e-6, y1 - y0), 6) AS aspect
FROM (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM stroke_point WINDOW w AS (PARTITION BY stroke_id))""",
                             "stroke_point"),
    "simplify_stroke": _folded("SELECT * FROM kept"),
    "smooth_stroke": _folded(f"""
SELECT stroke_id, i, CASE WHEN i = 1 THEN 'M ' || {_num('x')} || ' ' || {_num('y')} ELSE '' END ||
  CASE WHEN x2 IS NULL THEN CASE WHEN i = 1 THEN ' L ' || {_num('x + 0.1')} || ' ' || {_num('y')} ELSE '' END
  ELSE ' C ' || {_num('x + (x2 - coalesce(x0, x)) / 6')} || ' ' || {_num('y + (y2 - coalesce(y0, y)) / 6')} || ' ' ||
    {_num('x2 - (coalesce(x3, x2) - x) / 6')} || ' ' || {_num('y2 - (coalesce(y3, y2) - y) / 6')} || ' ' || {_num('x2')} || ' ' || {_num('y2')} END AS path
FROM near WHERE x2 IS NOT NULL OR i = 1""",
        near="""SELECT *, row_number() OVER w AS i, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2,
  lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3 FROM kept WINDOW w AS (PARTITION BY stroke_id ORDER BY seq)"""),
    "merge_ink": """
SELECT doc_id, page_no, seq, color, width, opacity, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS object_no
FROM (SELECT *, coalesce(lag(color) OVER w = color AND lag(width) OVER w = width AND lag(opacity) OVER w = opacity, false) AS same
  FROM (SELECT user_id AS doc_id, 1 AS page_no, event_id AS seq, CASE WHEN event_type = 'error' THEN '#ffffff' WHEN value > 20 THEN '#000000' ELSE '#1a4fd6' END AS color,
      CASE WHEN value > 120 THEN 3::DOUBLE ELSE 2::DOUBLE END AS width, CASE WHEN event_type = 'click' THEN 0.45::DOUBLE ELSE 1 END AS opacity FROM events)
  WINDOW w AS (PARTITION BY doc_id ORDER BY seq))""",
    "objects_at_points": sql("""
SELECT p.doc_id, 1 AS page_no, p.doc_id AS point_id, px, py, max(z) AS hit_z
FROM (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) % 600 AS DOUBLE) AS px, CAST(floor(o_totalprice / 7) % 800 AS DOUBLE) AS py FROM orders) p
LEFT JOIN (SELECT doc_id, page_no AS z, CASE WHEN o % 5 = 0 THEN x - 2 ELSE x END AS x, CASE WHEN o % 5 = 0 THEN y - 2 ELSE y END AS y,
    CASE WHEN o % 5 = 0 THEN greatest(6 + length(CAST(o AS VARCHAR)), 12) * (10 + o % 8) * 0.55::DOUBLE + 6 ELSE 20 + w_pt / 10 END AS w,
    CASE WHEN o % 5 = 0 THEN 2 * (10 + o % 8) * 1.25::DOUBLE + 4 ELSE 10 + h_pt / 10 END AS h
  FROM (SELECT *, orig_bytes AS o, CAST(orig_bytes % 500 AS DOUBLE) AS x, CAST(orig_bytes % 700 AS DOUBLE) AS y FROM page) WHERE o % 5 <> 2) b
  ON b.doc_id = p.doc_id AND px >= x - 7.5 AND px <= x + w + 7.5 AND py >= y - 7.5 AND py <= y + h + 7.5
GROUP BY p.doc_id, px, py""", "page"),
    "erase_ink": sql("""
SELECT stroke_id % 20 AS doc_id, 1 AS page_no, stroke_id, seq, x, y FROM stroke_point WHERE stroke_id NOT IN (
  SELECT p.stroke_id FROM stroke_point p JOIN (SELECT event_id % 20 AS doc_id, value - 100 AS x, event_id * 7 % 100 AS y FROM events WHERE value > 250) e
    ON e.doc_id = p.stroke_id % 20 AND (p.x - e.x) ** 2 + (p.y - e.y) ** 2 < (10 + p.stroke_id % 4) ** 2)""", "stroke_point"),
    "redact_words": sql("""
SELECT doc_id, page_no, idx, text FROM word w WHERE NOT EXISTS (SELECT 1 FROM redaction r WHERE r.doc_id = w.doc_id AND r.page_no = w.page_no
  AND w.x0 < rx + rw AND w.x1 > rx AND w.y0 < ry + rh AND w.y1 > ry)""", "word", "redaction"),
    "form_fill": sql("""
SELECT f.doc_id, f.name, f.type, CASE WHEN v.name IS NULL THEN f.value
  WHEN f.type = 'checkbox' THEN CASE WHEN v.value IN ('false', '') THEN 'false' ELSE 'true' END ELSE v.value END AS value, false AS editable
FROM fields f LEFT JOIN vals v ON v.doc_id = f.doc_id AND v.name = f.name""", fields=_FIELDS, vals=_VALUES),
    "form_warnings": sql("SELECT * FROM vals WHERE doc_id % 4 = 0", vals=_VALUES),
    "page_number_labels": sql("""
SELECT doc_id, page_no * 10 AS pos, page_no || ' / ' || n AS label, round(w_pt / 2 - length(page_no || ' / ' || n) * 2.6::DOUBLE, 6) AS x, 18::DOUBLE AS y, 10 AS size
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM page)""", "page"),
    "ocr_words": sql("""
SELECT doc_id, page_no, CAST(idx // 60 AS INT) AS b, CAST(idx % 60 // 30 AS INT) AS p, CAST(idx % 30 // 10 AS INT) AS l, CAST(idx % 10 AS INT) AS w, text, confidence,
  idx % 10 * 50 AS x0, idx // 10 * 14 AS y0, idx % 10 * 50 + length(text) * 6 AS x1, idx // 10 * 14 + 12 AS y1
FROM word WHERE idx % 17 <> 0 AND idx % 19 <> 0 AND confidence >= 25""", "word"),
    "place_words": sql(rf"""
SELECT doc_id, page_no, idx, text, round(x0 * s, 6) AS x, round(841.89::DOUBLE - y1 * s, 6) AS y, round(greatest(2, least(72, (y1 - y0) * s)), 6) AS size
FROM (SELECT *, 72 / (150 + doc_id % 3 * 75)::DOUBLE AS s FROM word) WHERE text <> '' AND (y1 - y0) * s > 0.1 AND NOT regexp_matches(text, '{_BAD}')""", "word"),
    "searchable_text": sql("SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY idx) AS page_text FROM word GROUP BY ALL", "word"),
}
