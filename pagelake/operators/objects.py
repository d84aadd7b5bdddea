"""Page objects: text boxes, signatures, ink, redactions, forms and page edits."""

from __future__ import annotations

import copy
import math

from pyspark.sql import DataFrame, functions as F

from ..fixed import A4_LONG_PT, A4_SHORT_PT
from ..folds import ordered_fold
from ..functions import text as t
from ..functions.cells import box_cells, fine_cells, point_cells
from ..keys import ordered_index, running_total, with_neighbour
from .raster import PAGE
from .strokes import simplify_stroke


def text_extent(objects: DataFrame) -> DataFrame:
    return objects.withColumns({"text_w": F.expr(t.extent_w("text", "size")), "text_h": F.expr(t.extent_h("text", "size"))})


def winansi_clean(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"drawable": F.expr(t.drawable(column)), "drawn_text": F.expr(t.drawn(column))})


def place_signature(placements: DataFrame) -> DataFrame:
    """Size and position of a signature, image stamp or drawn stamp centred on a tap."""
    sized = placements.selectExpr(
        "*", "CASE kind WHEN 'stamp' THEN 170D WHEN 'image_stamp' THEN 160D ELSE least(180D, page_w * 0.4D) END AS w",
    ).selectExpr(
        "*",
        """CASE kind WHEN 'stamp' THEN 56D WHEN 'image_stamp' THEN 160D / coalesce(nullif(aspect, 0), 2.5D)
             ELSE w / coalesce(nullif(aspect, 0), 3D) END AS h""",
    )
    return sized.selectExpr("*", "tap_x - w / 2 AS x", "tap_y - h / 2 AS y")


def normalize_strokes(points: DataFrame, key: str = "sig_id") -> DataFrame:
    """Points of each signature scaled to its bounding box, with its aspect."""
    box = points.groupBy(key).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    ).selectExpr(key, "_x0", "_y0", "greatest(1e-6D, _x1 - _x0) AS _w", "greatest(1e-6D, _y1 - _y0) AS _h")
    return points.join(box, key).selectExpr(
        *[c for c in points.columns if c not in ("x", "y")], "(x - _x0) / _w AS x", "(y - _y0) / _h AS y", "_w / _h AS aspect"
    )


def smooth_stroke(points: DataFrame, least: float = 1.2, chunk: int = 65536) -> DataFrame:
    """Curve segments of each stroke as path text, one row a segment.

    Neighbouring points meet through their position in the stroke (one grouped
    pass on (stroke, position)), so a long stroke spreads over tasks.
    """
    kept = ordered_index(simplify_stroke(points, least), ["stroke_id"], F.floor(F.col("seq") / chunk), ["seq"], "i")
    spread = kept.select(
        "stroke_id", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1, 2)])).alias("d"), F.struct("x", "y").alias("p"), "i"
    ).withColumn("i", F.col("i") - F.col("d"))
    near = spread.groupBy("stroke_id", "i").agg(
        *[F.max(F.when(F.col("d") == k, F.col("p"))).alias(n) for k, n in ((-1, "p0"), (0, "p1"), (1, "p2"), (2, "p3"))]
    ).where("p1 IS NOT NULL")
    num = t.number
    curve = "concat(' C ', {0}, ' ', {1}, ' ', {2}, ' ', {3}, ' ', {4}, ' ', {5})".format(
        num("p1.x + (p2.x - coalesce(p0.x, p1.x)) / 6"), num("p1.y + (p2.y - coalesce(p0.y, p1.y)) / 6"),
        num("p2.x - (coalesce(p3.x, p2.x) - p1.x) / 6"), num("p2.y - (coalesce(p3.y, p2.y) - p1.y) / 6"),
        num("p2.x"), num("p2.y"),
    )
    start = f"CASE WHEN i = 1 THEN concat('M ', {num('p1.x')}, ' ', {num('p1.y')}) ELSE '' END"
    stub = f"CASE WHEN i = 1 AND p2 IS NULL THEN concat(' L ', {num('p1.x + 0.1D')}, ' ', {num('p1.y')}) ELSE '' END"
    return near.selectExpr(
        "stroke_id", "i", f"concat({start}, CASE WHEN p2 IS NOT NULL THEN {curve} ELSE '' END, {stub}) AS path"
    ).where("path <> ''")


def merge_ink(strokes: DataFrame, chunk: int = 4096) -> DataFrame:
    """Number the ink objects: consecutive strokes with equal pen share one.

    ``strokes``: doc_id, page_no, seq, tool, color, width, marker. White-out is
    an opaque white stroke, the marker is translucent.
    """
    pen = strokes.withColumns(
        {
            "color": F.expr("CASE WHEN tool = 'whiteout' THEN '#ffffff' ELSE color END"),
            "opacity": F.expr("CASE WHEN tool <> 'whiteout' AND marker THEN 0.45D ELSE 1D END"),
        }
    )
    by = F.floor(F.col("seq") / chunk)
    placed = ordered_index(pen, PAGE, by, ["seq"], "i")
    before = with_neighbour(placed, PAGE, "i", -1, ["color", "width", "opacity"], "_before")
    fresh = before.withColumn(
        "_new",
        F.expr("CASE WHEN color <=> color_before AND width <=> width_before AND opacity <=> opacity_before THEN 0 ELSE 1 END"),
    )
    total = running_total(fresh, PAGE, by, ["seq"], "_new", "_earlier")
    return total.selectExpr(
        *PAGE, "seq", "color", "width", "opacity", "CAST(_earlier + _new AS BIGINT) AS object_no"
    )


def objects_at_points(points: DataFrame, objects: DataFrame, pad: float) -> DataFrame:
    """Topmost object under each point; ink is never hit.

    Objects lie in four cells at most of a grid that fits their size, and a point looks into its cell of each
    grid, so that what it is compared with does not grow with the page. The best hit is a combined aggregate.
    Both sides grow with the table and are larger than the planner's estimate, which does not count cells: no side is broadcast.
    """
    boxes = text_extent(objects.where("type <> 'ink'")).selectExpr(
        *PAGE, "z",
        f"CASE WHEN type = 'text' THEN x - 2 ELSE x END - {pad} AS bx0", f"CASE WHEN type = 'text' THEN y - 2 ELSE y END - {pad} AS by0",
        f"CASE WHEN type = 'text' THEN x - 2 + text_w + 6 ELSE x + w END + {pad} AS bx1",
        f"CASE WHEN type = 'text' THEN y - 2 + text_h + 4 ELSE y + h END + {pad} AS by1",
    ).withColumn("_cell", F.explode(F.expr(box_cells("bx0", "by0", "bx1", "by1"))))
    probes = points.withColumn("_cell", F.explode(F.expr(point_cells("px", "py"))))
    hits = probes.join(boxes.hint("merge"), [*PAGE, "_cell"]).where(
        "px >= bx0 AND px <= bx1 AND py >= by0 AND py <= by1"
    ).groupBy(*PAGE, "point_id").agg(F.max("z").alias("hit_z"))
    return points.join(hits.hint("merge"), [*PAGE, "point_id"], "left")


def erase_ink(points: DataFrame, erasers: DataFrame, radius: float = 8) -> DataFrame:
    """Stroke points that remain: a stroke touched by an eraser goes as a whole.

    A stroke is walked point by point: each stands in the cells that its reach touches, and a semi
    join on cells stops at the first touch; nothing is paired up.
    """
    reach = points.withColumn("_r", F.expr(f"{radius} + width")).withColumn("_cell", F.explode(F.expr(box_cells("x - _r", "y - _r", "x + _r", "y + _r"))))
    probes = erasers.selectExpr("doc_id AS _d", "page_no AS _p", "x AS ex", "y AS ey", f"explode({point_cells('x', 'y')}) AS _at")
    cond = F.expr("doc_id = _d AND page_no = _p AND _cell = _at AND (x - ex) * (x - ex) + (y - ey) * (y - ey) < _r * _r")
    gone = reach.join(probes.hint("merge"), cond, "left_semi").select(*PAGE, "stroke_id").distinct()
    return points.join(gone.hint("merge"), [*PAGE, "stroke_id"], "left_anti")


def redact_words(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words no redaction box overlaps (rects: rx, ry, rw, rh).

    Words and boxes meet in the cells of one grid that both cover: a word is compared with the boxes around it.
    """
    w = words.withColumn("_cell", F.explode(F.expr(fine_cells("x0", "y0", "x1", "y1"))))
    r = rects.withColumn("_at", F.explode(F.expr(fine_cells("rx", "ry", "rx + rw", "ry + rh")))).withColumnsRenamed({"doc_id": "_d", "page_no": "_p"})
    cond = F.expr("doc_id = _d AND page_no = _p AND _cell = _at AND x0 < rx + rw AND x1 > rx AND y0 < ry + rh AND y1 > ry")
    hit = w.join(r.hint("merge"), cond, "left_semi").select(*PAGE, "idx").distinct()
    return words.join(hit.hint("merge"), [*PAGE, "idx"], "left_anti")


def form_fill(fields: DataFrame, values: DataFrame, flatten: bool = True) -> DataFrame:
    """Values entered by field name; fields without one keep theirs. Of several values for a field the last counts."""
    order = "order_no" if "order_no" in values.columns else "value"
    v = values.groupBy("doc_id", "name").agg(F.max(F.struct(F.col(order).alias("_at"), F.col("value").alias("_v"))).alias("_last")).selectExpr(
        "doc_id", "name", "_last._v AS _new", "true AS _hit")
    return fields.join(v, ["doc_id", "name"], "left").selectExpr(
        "doc_id", "name", "type",
        """CASE WHEN _hit IS NULL THEN value
             WHEN type = 'checkbox' THEN CAST(coalesce(try_cast(_new AS BOOLEAN), coalesce(_new, '') <> '') AS STRING)
             ELSE _new END AS value""",
        f"NOT {str(flatten).lower()} AS editable",
    )


def form_warnings(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Entered values no field takes."""
    return values.join(fields.select("doc_id", "name"), ["doc_id", "name"], "left_anti")


def page_number_labels(plan: DataFrame, chunk: int = 4096) -> DataFrame:
    """Label ``i / n`` and its place for every page of a plan (doc_id, pos, view_w)."""
    n = plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_index(plan, ["doc_id"], F.floor(F.col("pos") / chunk), ["pos"], "i")
    return placed.join(n, "doc_id").withColumn("label", F.expr("concat(i, ' / ', n)")).withColumns(
        {"x": F.expr("view_w / 2 - length(label) * 2.6D"), "y": F.lit(18.0), "size": F.lit(10)}
    ).drop("i", "n")


class _Plan:
    """Page list of one document under an operation log with undo and redo."""

    HISTORY = 60

    def __init__(self):
        self.pages, self.past, self.future, self.started = [], [], [], False

    @staticmethod
    def _to_a4(page):
        key = "size" if page["src"] is None else "resize"
        page[key] = (A4_SHORT_PT, A4_LONG_PT)

    def step(self, row):
        if not self.started:
            self.started = True
            self.pages = [{"src": k, "rotate": 0, "size": None, "resize": None} for k in range(int(row.n_pages))]
        op, at, n = row.op, int(row.at), len(self.pages)
        if op == "undo" or op == "redo":
            source, target = (self.past, self.future) if op == "undo" else (self.future, self.past)
            if source:
                target.append(self.pages)
                self.pages = source.pop()
            return []
        allowed = {
            "insert_blank": True, "insert_image": True, "all_a4": True, "move_left": 0 < at < n, "move_right": 0 <= at < n - 1,
            "duplicate": 0 <= at < n, "rotate": 0 <= at < n, "to_a4": 0 <= at < n, "delete": n > 1 and 0 <= at < n,
        }
        if not allowed.get(op, False):
            return []
        self.past = (self.past + [copy.deepcopy(self.pages)])[-self.HISTORY:]
        self.future = []
        p = self.pages
        if op in ("insert_blank", "insert_image"):
            p.append({"src": None, "rotate": 0, "size": (A4_SHORT_PT, A4_LONG_PT), "resize": None})
        elif op == "move_left":
            p[at - 1:at + 1] = p[at], p[at - 1]
        elif op == "move_right":
            p[at:at + 2] = p[at + 1], p[at]
        elif op == "duplicate":
            p.insert(at + 1, copy.deepcopy(p[at]))
        elif op == "rotate":
            p[at]["rotate"] = (p[at]["rotate"] + 90) % 360
        elif op == "delete":
            del p[at]
        elif op == "to_a4":
            self._to_a4(p[at])
        else:
            for page in p:
                self._to_a4(page)
        return []

    def finish(self):
        return [
            (k + 1, p["src"], p["rotate"], *(p["size"] or (None, None)), p["resize"] is not None)
            for k, p in enumerate(self.pages)
        ]


def edit_replay(ops: DataFrame) -> DataFrame:
    """Final page plan of each document from its operation log (doc_id, seq, op, at, n_pages)."""
    return ordered_fold(
        ops.select("doc_id", "seq", "op", "at", "n_pages"), ["doc_id"], ["seq"], _Plan,
        "pos int, src int, rotate int, blank_w double, blank_h double, resized boolean",
    )
