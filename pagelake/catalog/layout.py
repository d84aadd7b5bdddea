"""Page boxes, formats, rotation and corner arithmetic."""

from __future__ import annotations

from .. import inputs as i
from ..operators import layout, options
from .views import sql


def _flat(df, q="quad"):
    return df.selectExpr("doc_id", *[f"round({q}[{k}].{a}, 6) AS {a}{k}" for k in range(4) for a in "xy"],
                         *[c for c in ("format",) if c in df.columns])


def _quads(spark, d):
    pts = ", ".join(
        f"named_struct('x', greatest(0D, least(1D, CAST(embedding[{2 * k}] AS DOUBLE) * 1.5D + 0.5D)),"
        f" 'y', greatest(0D, least(1D, CAST(embedding[{2 * k + 1}] AS DOUBLE) * 1.5D + 0.5D)))" for k in range(4))
    return i.table(spark, d, "embeddings").selectExpr(
        "vec_id AS doc_id", "CAST(600 + vec_id % 1000 AS INT) AS src_w", "CAST(800 + vec_id * 7 % 900 AS INT) AS src_h",
        "CASE vec_id % 3 WHEN 0 THEN 'a4p' WHEN 1 THEN 'a4l' ELSE 'auto' END AS format", f"array({pts}) AS quad", "embedding")


def q_order(spark, d):
    return _flat(layout.order_corners(_quads(spark, d)).drop("format"))


def q_rotate_quad(spark, d):
    return _flat(layout.rotate_quad(_quads(spark, d)))


def q_out_size(spark, d):
    return layout.quad_output_size(layout.order_corners(_quads(spark, d))).select("doc_id", "out_w", "out_h")


def q_area(spark, d):
    return layout.polygon_area(_quads(spark, d)).selectExpr("doc_id", "round(area, 6) AS area")


def q_sheet_format(spark, d):
    return layout.sheet_format(layout.order_corners(_quads(spark, d))).select("doc_id", "format")


def _scans(spark, d):
    return i.page(spark, d).selectExpr(
        "doc_id", "page_no", "CAST(orig_bytes % 4000 + 1200 AS INT) AS px_w", "CAST(orig_bytes % 5003 + 2000 AS INT) AS px_h",
        "CASE orig_bytes % 4 WHEN 0 THEN 300 WHEN 1 THEN 200 WHEN 2 THEN 150 END AS scan_dpi",
        "CASE WHEN orig_bytes % 3 = 0 THEN 'right' ELSE 'left' END AS origin_x",
        "CASE WHEN orig_bytes % 5 = 0 THEN 'bottom' ELSE 'top' END AS origin_y",
        *[f"CASE WHEN orig_bytes % 7 <> 0 THEN {e} END AS found_{n}" for n, e in (
            ("x0", "(orig_bytes % 11) / 1000D"), ("y0", "(orig_bytes % 13 div 6) / 100D"),
            ("x1", "1 - (orig_bytes % 17 div 8) / 50D"), ("y1", "1 - (orig_bytes % 19) / 1000D"))])


def q_bed(spark, d):
    return layout.bed_a4(_scans(spark, d)).selectExpr(
        "doc_id", "page_no", *[f"round(calc_{c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1")])


def q_pick(spark, d):
    return layout.pick_sheet(layout.bed_a4(_scans(spark, d))).selectExpr(
        "doc_id", "page_no", "round(sheet[0].x, 6) AS x0", "round(sheet[0].y, 6) AS y0", "round(sheet[2].x, 6) AS x1", "round(sheet[2].y, 6) AS y1")


def q_default(spark, d):
    q = _quads(spark, d).selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN quad END AS sheet", "CASE WHEN doc_id % 2 = 0 THEN quad END AS doc_quad")
    return _flat(layout.corner_fallback(q))


def _images(spark, d):
    return i.page(spark, d).selectExpr(
        "doc_id", "page_no", "CAST(orig_bytes % 3000 + 1 AS INT) AS w", "CAST(orig_bytes * 7 % 4000 + 1 AS INT) AS h",
        "CASE orig_bytes % 3 WHEN 0 THEN 'a4p' WHEN 1 THEN 'a4l' ELSE 'auto' END AS format", "orig_bytes % 2 = 0 AS stretch")


_BOX = ["doc_id", "page_no", *[f"round({c}, 6) AS {c}" for c in ("page_w", "page_h", "x", "y", "draw_w", "draw_h")]]


def q_fit(spark, d):
    return layout.fit_page(_images(spark, d)).selectExpr(*_BOX)


def q_format(spark, d):
    return layout.page_format(_images(spark, d)).selectExpr(*_BOX)


def _plan(spark, d):
    return i.page(spark, d).selectExpr(
        "doc_id", "page_no", "w_pt", "h_pt", "CASE WHEN orig_bytes % 4 = 0 THEN NULL ELSE page_no - 1 END AS src",
        "orig_bytes % 4 = 0 AS blank", "CAST((orig_bytes % 7 - 3) * 90 AS INT) AS rotation", "CAST(orig_bytes % 3 * 90 AS INT) AS rotate",
        "w_pt * 0.1D AS crop_x", "h_pt * 0.2D AS crop_y", "300D AS crop_w", "400D AS crop_h")


def q_resize(spark, d):
    return layout.resize_to(_plan(spark, d)).selectExpr(
        "doc_id", "page_no", *[f"round({c}, 6) AS {c}" for c in ("scale", "dx", "dy", "new_w", "new_h")])


def q_crop(spark, d):
    return layout.crop_box(_plan(spark, d)).selectExpr(
        "doc_id", "page_no", *[f"round({c}, 6) AS {c}" for c in ("box_x", "box_y", "box_w", "box_h")])


def q_rotate(spark, d):
    return layout.rotate_view(_plan(spark, d)).selectExpr(
        "doc_id", "page_no", "CAST(view_rotation AS INT) AS view_rotation", "view_w", "view_h",
        *[f"matrix[{k}] AS m{k}" for k in range(6)])


def _renders(spark, d):
    sized = layout.target_size(options.resolve_page_options(
        i.page(spark, d), i.page_override(spark, d), options.preset_table(spark),
        {"mode": "raster", "color_mode": "bw", "dpi": 600}))
    return sized.selectExpr("doc_id", "page_no", "w_px", "CASE WHEN orig_bytes % 23 = 0 THEN 0 ELSE 255 END AS alpha_first",
                            "CASE WHEN orig_bytes % 46 = 0 THEN 0 ELSE 255 END AS alpha_last")


def q_blank_ok(spark, d):
    return layout.blank_render_check(_renders(spark, d))[0].select("doc_id", "page_no")


def q_blank_bad(spark, d):
    return layout.blank_render_check(_renders(spark, d))[1].select("doc_id", "page_no", "reason")


QUERIES = {
    "order_corners": q_order, "rotate_quad": q_rotate_quad, "quad_output_size": q_out_size, "polygon_area": q_area,
    "sheet_format": q_sheet_format, "bed_a4": q_bed, "pick_sheet": q_pick, "default_corners": q_default, "fit_page": q_fit,
    "page_format": q_format, "resize_to": q_resize, "crop_box": q_crop, "rotate_view": q_rotate,
    "blank_render_check": q_blank_ok, "blank_render_rejects": q_blank_bad,
}

_PT = """
SELECT vec_id AS doc_id, k, CAST(600 + vec_id % 1000 AS INT) AS src_w, CAST(800 + vec_id * 7 % 900 AS INT) AS src_h,
  greatest(0, least(1, CAST(embedding[2 * k + 1] AS DOUBLE) * 1.5::DOUBLE + 0.5::DOUBLE)) AS x,
  greatest(0, least(1, CAST(embedding[2 * k + 2] AS DOUBLE) * 1.5::DOUBLE + 0.5::DOUBLE)) AS y FROM embeddings, range(0, 4) t(k)"""


def _ord(src: str) -> str:
    return f"""
SELECT doc_id, any_value(src_w) AS src_w, any_value(src_h) AS src_h,
  max(x) FILTER (su = 1) AS x0, max(y) FILTER (su = 1) AS y0, max(x) FILTER (df = 4) AS x1, max(y) FILTER (df = 4) AS y1,
  max(x) FILTER (su = 4) AS x2, max(y) FILTER (su = 4) AS y2, max(x) FILTER (df = 1) AS x3, max(y) FILTER (df = 1) AS y3
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x + y, k) AS su, row_number() OVER (PARTITION BY doc_id ORDER BY x - y, k) AS df
      FROM {src}) GROUP BY doc_id"""


_R8 = ", ".join(f"round({a}{k}, 6) AS {a}{k}" for k in range(4) for a in "xy")
_SC = """
SELECT doc_id, page_no, orig_bytes AS o, orig_bytes % 4000 + 1200 AS px_w, orig_bytes % 5003 + 2000 AS px_h,
  CASE orig_bytes % 4 WHEN 0 THEN 300 WHEN 1 THEN 200 WHEN 2 THEN 150 END AS dpi FROM page"""
_BED = """
SELECT *, CASE WHEN o % 3 = 0 THEN 1 - fw ELSE CASE WHEN fw IS NOT NULL THEN 0::DOUBLE END END AS x0, CASE WHEN o % 5 = 0 THEN 1 - fh ELSE CASE WHEN fh IS NOT NULL THEN 0::DOUBLE END END AS y0
FROM (SELECT *, CASE WHEN dpi IS NOT NULL THEN least(1, 210 / (px_w / dpi * 25.4::DOUBLE)) END AS fw,
  CASE WHEN dpi IS NOT NULL THEN least(1, 297 / (px_h / dpi * 25.4::DOUBLE)) END AS fh FROM sc)"""
_PICK = """
SELECT doc_id, page_no, dpi,
  CASE WHEN f0 > 0.002 THEN f0 ELSE coalesce(x0, f0) END AS x0, CASE WHEN g0 > 0.002 THEN g0 ELSE coalesce(y0, g0) END AS y0,
  CASE WHEN f1 < 1 - 0.002::DOUBLE THEN f1 ELSE coalesce(x0 + fw, f1) END AS x1, CASE WHEN g1 < 1 - 0.002::DOUBLE THEN g1 ELSE coalesce(y0 + fh, g1) END AS y1
FROM (SELECT *, CASE WHEN o % 7 <> 0 THEN (o % 11) / 1000::DOUBLE END AS f0, CASE WHEN o % 7 <> 0 THEN (o % 13 // 6) / 100::DOUBLE END AS g0,
  CASE WHEN o % 7 <> 0 THEN 1 - (o % 17 // 8) / 50::DOUBLE END AS f1, CASE WHEN o % 7 <> 0 THEN 1 - (o % 19) / 1000::DOUBLE END AS g1 FROM bed)"""
_IMG = """
SELECT doc_id, page_no, orig_bytes % 3000 + 1 AS w, orig_bytes * 7 % 4000 + 1 AS h, orig_bytes % 3 AS f, orig_bytes % 2 = 0 AS stretch FROM page"""
_PLAN = """
SELECT doc_id, page_no, w_pt, h_pt, orig_bytes % 4 = 0 AS blank, CAST((orig_bytes % 7 - 3) * 90 AS INT) AS rotation, CAST(orig_bytes % 3 * 90 AS INT) AS rotate,
  w_pt * 0.1::DOUBLE AS cx, h_pt * 0.2::DOUBLE AS cy, 300::DOUBLE AS cw, 400::DOUBLE AS ch FROM page"""

SQL = {
    "order_corners": sql(f"SELECT doc_id, {_R8} FROM o", pt=_PT, o=_ord("pt")),
    "rotate_quad": sql(f"SELECT doc_id, {_R8}, CASE doc_id % 3 WHEN 0 THEN 'a4l' WHEN 1 THEN 'a4p' ELSE 'auto' END AS format FROM o",
                       pt=_PT, tu="SELECT doc_id, k, src_w, src_h, 1 - y AS x, x AS y FROM pt", o=_ord("tu")),
    "quad_output_size": sql("""
SELECT doc_id, CAST(greatest(8, floor(qw * s + 0.5)) AS INT) AS out_w, CAST(greatest(8, floor(qh * s + 0.5)) AS INT) AS out_h
FROM (SELECT *, least(1.2::DOUBLE, 2800 / greatest(qw, qh)) AS s FROM (
  SELECT doc_id, greatest(sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2), sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)) AS qw,
    greatest(sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2), sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) AS qh
  FROM (SELECT doc_id, x0 * src_w AS x0, x1 * src_w AS x1, x2 * src_w AS x2, x3 * src_w AS x3,
          y0 * src_h AS y0, y1 * src_h AS y1, y2 * src_h AS y2, y3 * src_h AS y3 FROM o)))""", pt=_PT, o=_ord("pt")),
    "polygon_area": sql("""SELECT doc_id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area
FROM (SELECT a.doc_id, a.x, a.y, b.x AS nx, b.y AS ny FROM pt a JOIN pt b ON b.doc_id = a.doc_id AND b.k = (a.k + 1) % 4) GROUP BY doc_id""", pt=_PT),
    "sheet_format": sql("""SELECT doc_id, CASE WHEN abs(y3 - y0) * src_h >= abs(x1 - x0) * src_w THEN 'a4p' ELSE 'a4l' END AS format FROM o""",
                        pt=_PT, o=_ord("pt")),
    "bed_a4": sql("""SELECT doc_id, page_no, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x0 + fw, 6) AS x1, round(y0 + fh, 6) AS y1 FROM bed""",
                  "page", sc=_SC, bed=_BED),
    "pick_sheet": sql("""SELECT doc_id, page_no, CASE WHEN ok THEN round(x0, 6) END AS x0, CASE WHEN ok THEN round(y0, 6) END AS y0,
  CASE WHEN ok THEN round(x1, 6) END AS x1, CASE WHEN ok THEN round(y1, 6) END AS y1
FROM (SELECT *, dpi IS NOT NULL AND (x0 > 0.002 OR y0 > 0.002 OR x1 < 1 - 0.002::DOUBLE OR y1 < 1 - 0.002::DOUBLE) AS ok FROM pick)""",
                      "page", sc=_SC, bed=_BED, pick=_PICK),
    "default_corners": sql("SELECT doc_id, " + ", ".join(
        f"round(CASE WHEN doc_id % 6 IN (0, 2, 3, 4) THEN max({a}) FILTER (k = {k}) ELSE {v} END, 6) AS {a}{k}"
        for k, (vx, vy) in enumerate(((0.04, 0.04), (0.96, 0.04), (0.96, 0.96), (0.04, 0.96))) for a, v in (("x", vx), ("y", vy)))
        + " FROM pt GROUP BY doc_id", pt=_PT),
    "fit_page": sql("""SELECT doc_id, page_no, page_w, page_h, round((page_w - w * s) / 2, 6) AS x, round((page_h - h * s) / 2, 6) AS y,
  round(w * s, 6) AS draw_w, round(h * s, 6) AS draw_h
FROM (SELECT *, least(page_w / w, page_h / h) AS s FROM (SELECT *, CASE WHEN w > h THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS page_w,
  CASE WHEN w > h THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS page_h FROM img))""", "page", img=_IMG),
    "page_format": sql("""SELECT doc_id, page_no, round(page_w, 6) AS page_w, round(page_h, 6) AS page_h, round((page_w - dw) / 2, 6) AS x,
  round((page_h - dh) / 2, 6) AS y, round(dw, 6) AS draw_w, round(dh, 6) AS draw_h
FROM (SELECT *, CASE WHEN f = 2 OR stretch THEN page_w ELSE w * least(page_w / w, page_h / h) END AS dw,
  CASE WHEN f = 2 OR stretch THEN page_h ELSE h * least(page_w / w, page_h / h) END AS dh
  FROM (SELECT *, CASE f WHEN 0 THEN 595.28::DOUBLE WHEN 1 THEN 841.89::DOUBLE ELSE CASE WHEN w <= h THEN 841.89::DOUBLE * (w / h) ELSE 841.89::DOUBLE END END AS page_w,
    CASE f WHEN 0 THEN 841.89::DOUBLE WHEN 1 THEN 595.28::DOUBLE ELSE CASE WHEN w <= h THEN 841.89::DOUBLE ELSE 841.89::DOUBLE * (h / w) END END AS page_h FROM img))""",
                       "page", img=_IMG),
    "resize_to": sql("""SELECT doc_id, page_no, CASE WHEN blank THEN 1 ELSE round(s, 6) END AS scale,
  CASE WHEN blank THEN 0 ELSE round((595.28::DOUBLE - w_pt * s) / 2, 6) END AS dx, CASE WHEN blank THEN 0 ELSE round((841.89::DOUBLE - h_pt * s) / 2, 6) END AS dy,
  595.28::DOUBLE AS new_w, 841.89::DOUBLE AS new_h
FROM (SELECT *, least(595.28::DOUBLE / w_pt, 841.89::DOUBLE / h_pt) AS s FROM plan)""", "page", plan=_PLAN),
    "crop_box": sql("""SELECT doc_id, page_no,
  round(CASE r WHEN 90 THEN w_pt - (y0 + ch) WHEN 180 THEN w_pt - (cx + cw) WHEN 270 THEN y0 ELSE cx END, 6) AS box_x,
  round(CASE r WHEN 90 THEN cx WHEN 180 THEN h_pt - (y0 + ch) WHEN 270 THEN h_pt - (cx + cw) ELSE y0 END, 6) AS box_y,
  CASE WHEN r IN (90, 270) THEN ch ELSE cw END AS box_w, CASE WHEN r IN (90, 270) THEN cw ELSE ch END AS box_h
FROM (SELECT *, CASE WHEN r IN (90, 270) THEN w_pt ELSE h_pt END - cy - ch AS y0
      FROM (SELECT *, CASE WHEN blank THEN 0 ELSE (rotation + 360) % 360 END AS r FROM plan))""", "page", plan=_PLAN),
    "rotate_view": sql("""SELECT doc_id, page_no, CAST(r AS INT) AS view_rotation, CASE WHEN turn THEN h_pt ELSE w_pt END AS view_w, CASE WHEN turn THEN w_pt ELSE h_pt END AS view_h,
  CASE r WHEN 90 THEN 0::DOUBLE WHEN 180 THEN -1 WHEN 270 THEN 0 END AS m0, CASE r WHEN 90 THEN 1::DOUBLE WHEN 180 THEN 0 WHEN 270 THEN -1 END AS m1,
  CASE r WHEN 90 THEN -1::DOUBLE WHEN 180 THEN 0 WHEN 270 THEN 1 END AS m2, CASE r WHEN 90 THEN 0::DOUBLE WHEN 180 THEN -1 WHEN 270 THEN 0 END AS m3,
  CASE r WHEN 90 THEN w_pt WHEN 180 THEN w_pt WHEN 270 THEN 0 END AS m4, CASE r WHEN 90 THEN 0 WHEN 180 THEN h_pt WHEN 270 THEN h_pt END AS m5
FROM (SELECT *, r IN (90, 270) OR (blank AND rotate IN (90, 270)) AS turn
      FROM (SELECT *, CASE WHEN blank THEN 0 ELSE (rotation + rotate + 720) % 360 END AS r FROM plan))""", "page", plan=_PLAN),
    "blank_render_check": sql("SELECT doc_id, page_no FROM page WHERE NOT (orig_bytes % 46 = 0)", "page"),
    "blank_render_rejects": sql("SELECT doc_id, page_no, 'page could not be rendered' AS reason FROM page WHERE orig_bytes % 46 = 0", "page"),
}
