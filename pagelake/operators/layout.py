"""Page sizes, boxes, rotation and sheet corners: column arithmetic without shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed import (
    A4_LONG_PT, A4_SHORT_PT, MAX_PIXELS_BW, MAX_PIXELS_OTHER, OUTPUT_MAX_EDGE, OVERSIZE_AREA_PT2,
)
from ..functions import geometry as g
from ..functions.numeric import nearest

_LONG, _SHORT = f"{A4_LONG_PT}D", f"{A4_SHORT_PT}D"
_EPS = "0.002D"


def target_size(pages: DataFrame) -> DataFrame:
    """Pixel and point size of each rendered page from w_pt, h_pt, dpi, color_mode.

    Poster-sized pages count as A4; the pixel cap of the colour mode limits the
    scale, so a page raster is bounded before any pixel exists.
    """
    step1 = pages.selectExpr(
        "*",
        f"""CASE WHEN w_pt * h_pt > {OVERSIZE_AREA_PT2}D
              THEN least({_LONG} / greatest(w_pt, h_pt), {_SHORT} / least(w_pt, h_pt)) ELSE 1D END AS _norm""",
        f"CASE WHEN color_mode = 'bw' THEN {MAX_PIXELS_BW}D ELSE {MAX_PIXELS_OTHER}D END AS _cap",
    )
    step2 = step1.selectExpr("*", "dpi / 72D * _norm AS _s").selectExpr(
        "*", "w_pt * h_pt * _s * _s AS _area"
    ).selectExpr("*", "CASE WHEN _area > _cap THEN _s * sqrt(_cap / _area) ELSE _s END AS _scale")
    return step2.withColumns(
        {
            "out_w_pt": F.expr("w_pt * _norm"),
            "out_h_pt": F.expr("h_pt * _norm"),
            "w_px": F.expr(f"CAST(greatest(1, {nearest('w_pt * _scale')}) AS INT)"),
            "h_px": F.expr(f"CAST(greatest(1, {nearest('h_pt * _scale')}) AS INT)"),
        }
    ).withColumn("eff_dpi", F.expr("w_px / out_w_pt * 72")).drop("_norm", "_cap", "_s", "_area", "_scale")


def ocr_render_dpi(sized: DataFrame) -> DataFrame:
    """Text recognition reuses the page raster unless it is coarser than 200 dpi."""
    return sized.withColumns(
        {
            "ocr_dpi": F.expr("CASE WHEN eff_dpi < 200 THEN 240D ELSE eff_dpi END"),
            "rerender": F.expr("eff_dpi < 200"),
        }
    )


def fit_page(images: DataFrame) -> DataFrame:
    """Undistorted, centred placement of a w x h image on an A4 sheet."""
    sheet = images.selectExpr(
        "*",
        f"CASE WHEN w > h THEN {_LONG} ELSE {_SHORT} END AS page_w",
        f"CASE WHEN w > h THEN {_SHORT} ELSE {_LONG} END AS page_h",
    ).selectExpr("*", "least(page_w / w, page_h / h) AS _s")
    return sheet.selectExpr(
        "*", "(page_w - w * _s) / 2 AS x", "(page_h - h * _s) / 2 AS y", "w * _s AS draw_w", "h * _s AS draw_h"
    ).drop("_s")


def page_format(scans: DataFrame) -> DataFrame:
    """Sheet and image rectangle for a scan of w x h pixels in format a4p / a4l / auto."""
    sheet = scans.selectExpr(
        "*",
        f"""CASE format WHEN 'a4p' THEN {_SHORT} WHEN 'a4l' THEN {_LONG}
              ELSE CASE WHEN w <= h THEN {_LONG} * (w / h) ELSE {_LONG} END END AS page_w""",
        f"""CASE format WHEN 'a4p' THEN {_LONG} WHEN 'a4l' THEN {_SHORT}
              ELSE CASE WHEN w <= h THEN {_LONG} ELSE {_LONG} * (h / w) END END AS page_h""",
        "format IN ('a4p', 'a4l') AND NOT stretch AS _fitted",
    ).selectExpr("*", "least(page_w / w, page_h / h) AS _s")
    return sheet.selectExpr(
        "*",
        "CASE WHEN _fitted THEN w * _s ELSE page_w END AS draw_w",
        "CASE WHEN _fitted THEN h * _s ELSE page_h END AS draw_h",
    ).selectExpr("*", "(page_w - draw_w) / 2 AS x", "(page_h - draw_h) / 2 AS y").drop("_s", "_fitted")


def resize_to(pages: DataFrame, width: float = A4_SHORT_PT, height: float = A4_LONG_PT) -> DataFrame:
    """Scale and centre content on a new page size; sizes within half a point stay."""
    w, h = f"{width}D", f"{height}D"
    return pages.selectExpr(
        "*",
        f"""w_pt > 0 AND h_pt > 0 AND NOT coalesce(blank, false)
              AND (abs(w_pt - {w}) > 0.5 OR abs(h_pt - {h}) > 0.5) AS _move""",
        f"least({w} / w_pt, {h} / h_pt) AS _s",
    ).selectExpr(
        "*",
        "CASE WHEN _move THEN _s ELSE 1D END AS scale",
        f"CASE WHEN _move THEN ({w} - w_pt * _s) / 2 ELSE 0D END AS dx",
        f"CASE WHEN _move THEN ({h} - h_pt * _s) / 2 ELSE 0D END AS dy",
        f"CASE WHEN _move OR coalesce(blank, false) THEN {w} ELSE w_pt END AS new_w",
        f"CASE WHEN _move OR coalesce(blank, false) THEN {h} ELSE h_pt END AS new_h",
    ).drop("_move", "_s")


def crop_box(pages: DataFrame) -> DataFrame:
    """View-space crop (y down) to a media box (y up) under the page rotation."""
    p = pages.selectExpr(
        "*", "CASE WHEN src IS NULL THEN 0 ELSE pmod(rotation, 360) END AS _r",
    ).selectExpr("*", "CASE WHEN _r IN (90, 270) THEN w_pt ELSE h_pt END AS _view_h")
    p = p.selectExpr("*", "_view_h - crop_y - crop_h AS _y0")
    return p.selectExpr(
        "*",
        """CASE _r WHEN 90 THEN w_pt - (_y0 + crop_h) WHEN 180 THEN w_pt - (crop_x + crop_w)
             WHEN 270 THEN _y0 ELSE crop_x END AS box_x""",
        """CASE _r WHEN 90 THEN crop_x WHEN 180 THEN h_pt - (_y0 + crop_h)
             WHEN 270 THEN h_pt - (crop_x + crop_w) ELSE _y0 END AS box_y""",
        "CASE WHEN _r IN (90, 270) THEN crop_h ELSE crop_w END AS box_w",
        "CASE WHEN _r IN (90, 270) THEN crop_w ELSE crop_h END AS box_h",
    ).drop("_r", "_view_h", "_y0")


def rotate_view(pages: DataFrame) -> DataFrame:
    """Normalised rotation, visible size and the view-to-media matrix.

    Blank pages have no rotation of their own: a quarter turn swaps their size.
    """
    p = pages.selectExpr(
        "*",
        "CASE WHEN src IS NULL THEN 0 ELSE pmod(coalesce(rotation, 0) + coalesce(rotate, 0), 360) END AS view_rotation",
        "pmod(coalesce(rotate, 0), 180) <> 0 AS _quarter",
    )
    return p.selectExpr(
        "*",
        "CASE WHEN view_rotation IN (90, 270) OR (src IS NULL AND _quarter) THEN h_pt ELSE w_pt END AS view_w",
        "CASE WHEN view_rotation IN (90, 270) OR (src IS NULL AND _quarter) THEN w_pt ELSE h_pt END AS view_h",
        """CASE view_rotation WHEN 90 THEN array(0D, 1D, -1D, 0D, w_pt, 0D)
             WHEN 180 THEN array(-1D, 0D, 0D, -1D, w_pt, h_pt)
             WHEN 270 THEN array(0D, -1D, 1D, 0D, 0D, h_pt) END AS matrix""",
    ).drop("_quarter")


def order_corners(quads: DataFrame) -> DataFrame:
    return quads.withColumn("quad", F.expr(g.ordered("quad")))


def quad_output_size(quads: DataFrame) -> DataFrame:
    """Pixel size of the straightened scan: longest opposite edges, capped."""
    px = quads.withColumn("_q", F.expr("transform(quad, p -> named_struct('x', p.x * src_w, 'y', p.y * src_h))"))
    px = px.selectExpr(
        "*",
        f"greatest({g.distance('_q[0]', '_q[1]')}, {g.distance('_q[3]', '_q[2]')}) AS _w",
        f"greatest({g.distance('_q[0]', '_q[3]')}, {g.distance('_q[1]', '_q[2]')}) AS _h",
    ).selectExpr("*", f"least(1.2D, {OUTPUT_MAX_EDGE} / nullif(greatest(_w, _h), 0)) AS _s")
    return px.selectExpr(
        "*",
        f"CAST(greatest(8, {nearest('_w * _s')}) AS INT) AS out_w",
        f"CAST(greatest(8, {nearest('_h * _s')}) AS INT) AS out_h",
    ).drop("_q", "_w", "_h", "_s")


def bed_a4(scans: DataFrame) -> DataFrame:
    """Share of the scanned bed an A4 sheet covers, from pixels and scan dpi."""
    f = scans.selectExpr(
        "*",
        "CASE WHEN scan_dpi > 0 AND px_w > 0 THEN least(1D, 210 / (px_w / scan_dpi * 25.4D)) END AS _fw",
        "CASE WHEN scan_dpi > 0 AND px_h > 0 THEN least(1D, 297 / (px_h / scan_dpi * 25.4D)) END AS _fh",
    ).selectExpr(
        "*",
        "CASE WHEN _fw IS NULL OR _fh IS NULL THEN NULL WHEN origin_x = 'left' THEN 0D ELSE 1 - _fw END AS calc_x0",
        "CASE WHEN _fw IS NULL OR _fh IS NULL THEN NULL WHEN origin_y = 'top' THEN 0D ELSE 1 - _fh END AS calc_y0",
    )
    return f.selectExpr("*", "calc_x0 + _fw AS calc_x1", "calc_y0 + _fh AS calc_y1").drop("_fw", "_fh")


def pick_sheet(scans: DataFrame) -> DataFrame:
    """Measured edge where one was found, else computed; null when nothing is cut off.

    Expects found_* (null = no sheet found) and calc_* edges of the scan.
    """

    def edge(name: str, start: bool) -> str:
        hit = f"found_{name} > {_EPS}" if start else f"found_{name} < 1 - {_EPS}"
        return f"CASE WHEN {hit} THEN found_{name} ELSE coalesce(calc_{name}, found_{name}) END AS _{name}"

    p = scans.selectExpr("*", edge("x0", True), edge("y0", True), edge("x1", False), edge("y1", False))
    nothing = f"_x0 <= {_EPS} AND _y0 <= {_EPS} AND _x1 >= 1 - {_EPS} AND _y1 >= 1 - {_EPS}"
    corners = g.rectangle("_x0", "_y0", "_x1", "_y1")
    return p.withColumn(
        "sheet", F.expr(f"CASE WHEN scan_dpi > 0 AND _x0 IS NOT NULL AND NOT ({nothing}) THEN {corners} END")
    ).drop("_x0", "_y0", "_x1", "_y1")


def sheet_format(quads: DataFrame) -> DataFrame:
    return quads.withColumn(
        "format",
        F.expr("""CASE WHEN abs(quad[3].y - quad[0].y) * coalesce(nullif(src_h, 0), 1)
                    >= abs(quad[1].x - quad[0].x) * coalesce(nullif(src_w, 0), 1) THEN 'a4p' ELSE 'a4l' END"""),
    )


def default_corners(df: DataFrame, margin: float = 0.04) -> DataFrame:
    """Inset rectangle; a margin of 0 selects the whole image."""
    m = f"{margin}D"
    return df.withColumn("inset", F.expr(g.rectangle(m, m, f"1 - {m}", f"1 - {m}")))


def corner_fallback(df: DataFrame, margin: float = 0.04) -> DataFrame:
    """Sheet detection, then document detection, then the inset rectangle."""
    return default_corners(df, margin).withColumn("quad", F.expr("coalesce(sheet, doc_quad, inset)")).drop("inset")


def rotate_quad(quads: DataFrame) -> DataFrame:
    """Quarter turn clockwise of corners and sheet format."""
    turned = quads.withColumn("quad", F.expr("transform(quad, p -> named_struct('x', 1 - p.y, 'y', p.x))"))
    return order_corners(turned).withColumn(
        "format", F.expr("CASE format WHEN 'a4p' THEN 'a4l' WHEN 'a4l' THEN 'a4p' ELSE format END")
    )


def polygon_area(quads: DataFrame) -> DataFrame:
    return quads.withColumn("area", F.expr(g.shoelace("quad")))


def blank_render_check(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split renders into (usable, rejected): alpha 0 at both opposite corners is a broken raster."""
    broken = (F.col("alpha_first") == 0) & (F.col("alpha_last") == 0)
    return pages.where(~broken), pages.where(broken).withColumn("reason", F.lit("page could not be rendered"))
