"""Thresholds, profiles, document and sheet detection, warping and burn-in."""

from __future__ import annotations

from .. import inputs as i
from ..operators import detect, raster
from .bilevel import _checksum
from .views import sql


def q_otsu(spark, d):
    return raster.otsu(i.text_lines(spark, d))


def q_blur(spark, d):
    return _checksum(raster.box_blur(i.text_lines(spark, d)), "px")


def q_profiles(spark, d):
    return raster.median_profiles(i.text_lines(spark, d))


def q_edge(spark, d):
    return detect.sheet_edge(detect.side_profiles(i.text_lines(spark, d))).select("doc_id", "page_no", "side", "edge")


def q_sheet(spark, d):
    return detect.detect_sheet(i.text_lines(spark, d)).selectExpr(
        "doc_id", "page_no", *[f"round(found_{c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1")])


def _mask(spark, d):
    return i.text_lines(spark, d).selectExpr("doc_id", "page_no", "y", "transform(px, g -> CASE WHEN g < 105 THEN 1 ELSE 0 END) AS mask")


def q_component(spark, d):
    return detect.largest_component(_mask(spark, d)).selectExpr(
        "doc_id", "page_no", "y", "area", "aggregate(comp, 0L, (a, v) -> a + v) AS n")


def q_boundary(spark, d):
    whole = _mask(spark, d).withColumnRenamed("mask", "comp")
    return detect.boundary_points(whole).select("doc_id", "page_no", "x", "y")


def q_hull(spark, d):
    return detect.convex_hull(detect.boundary_points(_mask(spark, d).withColumnRenamed("mask", "comp")))


def _vec_points(spark, d):
    """32 whole-pixel points per vector, in vector order."""
    return i.table(spark, d, "embeddings").selectExpr(
        "vec_id AS doc_id", "1 AS page_no",
        """transform(sequence(0, 31), k -> named_struct('x', CAST(floor(CAST(embedding[2 * k] AS DOUBLE) * 1000) AS INT),
             'y', CAST(floor(CAST(embedding[2 * k + 1] AS DOUBLE) * 1000) AS INT))) AS pts""")


def q_subsample(spark, d):
    return detect.hull_subsample(_vec_points(spark, d)).selectExpr("doc_id", "page_no", "posexplode(pts) AS (pos, p)").selectExpr(
        "doc_id", "page_no", "pos", "p.x AS x", "p.y AS y")


def q_quad(spark, d):
    return detect.max_area_quad(i.spread(_vec_points(spark, d), "doc_id")).selectExpr(
        "doc_id", "page_no", "area", *[f"corners[{k}].{a} AS {a}{k}" for k in range(4) for a in "xy"])


def q_largest(spark, d):
    lines = i.text_lines(spark, d).selectExpr("doc_id", "page_no", "y", "aggregate(px, 0L, (a, v) -> a + v) AS score")
    return detect.largest_per_page(lines, "score", "y")


def q_document(spark, d):
    return detect.detect_document(i.text_lines(spark, d)).selectExpr(
        "doc_id", "page_no", *[f"round(doc_quad[{k}].{a}, 6) AS {a}{k}" for k in range(4) for a in "xy"])


def q_warp(spark, d):
    quads = i.table(spark, d, "embeddings").selectExpr(
        "vec_id AS doc_id", "1 AS page_no", "8 AS src_w", "8 AS src_h", "12 AS out_w", "10 AS out_h",
        """array(named_struct('x', 0.1D + abs(CAST(embedding[0] AS DOUBLE)), 'y', 0.1D), named_struct('x', 0.9D, 'y', abs(CAST(embedding[1] AS DOUBLE))),
             named_struct('x', 1D - abs(CAST(embedding[2] AS DOUBLE)), 'y', 0.95D), named_struct('x', 0.05D, 'y', 1D - abs(CAST(embedding[3] AS DOUBLE)))) AS quad""")
    return _checksum(detect.warp_perspective(i.embed_lines(spark, d), quads), "px")


def q_burn_rects(spark, d):
    rects = i.table(spark, d, "documents").selectExpr(
        "doc_id", "1 AS page_no",
        """explode(array(named_struct('z', 0, 'x', CAST(doc_id % 30 AS INT), 'y', CAST(doc_id % 5 AS INT), 'w', 20, 'h', 6, 'color', 0),
             named_struct('z', 1, 'x', CAST(doc_id % 25 + 10 AS INT), 'y', CAST(doc_id % 3 + 2 AS INT), 'w', 12, 'h', 40, 'color', 200))) AS o""",
    ).selectExpr("doc_id", "page_no", "o.*")
    return _checksum(raster.burn_rects(i.text_lines(spark, d), rects), "px")


def q_burn_erase(spark, d):
    docs = i.table(spark, d, "documents").selectExpr("doc_id", "1 AS page_no", "CAST(greatest(1, ceil(length(text) / 64D)) AS INT) AS h")
    strokes = docs.selectExpr(
        "doc_id", "page_no",
        """explode(array(
             named_struct('size', 0.0625D, 'points', array(named_struct('x', 0.125D, 'y', 0.25D), named_struct('x', 0.5D, 'y', 0.5D), named_struct('x', 0.875D, 'y', 0.25D))),
             named_struct('size', 0.125D, 'points', array(named_struct('x', 0.25D, 'y', 0.75D))))) AS s""").selectExpr("doc_id", "page_no", "s.*")
    return _checksum(raster.burn_erase(i.text_lines(spark, d), strokes, docs.selectExpr("doc_id", "page_no", "64 AS w", "h")), "px")


QUERIES = {
    "otsu": q_otsu, "box_blur": q_blur, "median_profiles": q_profiles, "sheet_edge": q_edge, "detect_sheet": q_sheet,
    "largest_component": q_component, "boundary_points": q_boundary, "convex_hull": q_hull, "hull_subsample": q_subsample,
    "max_area_quad": q_quad, "largest_per_page": q_largest, "detect_document": q_document, "warp_perspective": q_warp,
    "burn_rects": q_burn_rects, "burn_erase": q_burn_erase,
}

_LINE = """SELECT doc_id, page_no, y, CAST(sum(v * (x + 1)) AS BIGINT) AS checksum, CAST(sum(v) AS BIGINT) AS total FROM {0} GROUP BY ALL"""


def _profiles(src: str) -> str:
    """Upper medians of both axes of a pixel relation with page sizes w, h."""
    part = """
SELECT doc_id, page_no, '{axis}' AS axis, {i} AS i, any_value(list_sort(l)[len(l) // 2 + 1]) AS lum FROM (
  SELECT doc_id, page_no, {i}, list(g) AS l FROM {src} WHERE {o} >= floor({n} * 0.2 + 0.5) AND {o} < floor({n} * 0.8 + 0.5)
  GROUP BY doc_id, page_no, {i}) GROUP BY ALL"""
    return part.format(axis="col", i="x", o="y", n="h", src=src) + " UNION ALL " + part.format(axis="row", i="y", o="x", n="w", src=src)


_SIZED = "SELECT *, 64 AS w, max(y) OVER (PARTITION BY doc_id) + 1 AS h FROM t_gray"
_SIDES = """
SELECT doc_id, page_no, CASE axis WHEN 'col' THEN 'left' ELSE 'top' END AS side, list(lum ORDER BY i) AS p FROM prof GROUP BY ALL
UNION ALL SELECT doc_id, page_no, CASE axis WHEN 'col' THEN 'right' ELSE 'bottom' END AS side, list(lum ORDER BY i DESC) AS p FROM prof GROUP BY ALL"""
_FACTS = """
SELECT doc_id, page_no, side, p, n, search, near, wide, list_sort(p[search + 1:])[(n - search) // 2 + 1] AS paper
FROM (SELECT *, len(p) AS n, greatest(3, CAST(floor(len(p) * 0.14 + 0.5) AS INT)) AS search,
  greatest(2, CAST(floor(len(p) * 0.045 + 0.5) AS INT)) AS near, greatest(3, CAST(floor(len(p) * 0.02 + 0.5) AS INT)) AS wide FROM sides)"""
_POINTS = """
SELECT f.doc_id, f.page_no, f.side, q.j, p[q.j + 1] AS v, p[q.j] AS before, p[q.j + 2] AS after, n, search, near, wide, paper
FROM facts f, range(0, 3000) q(j) WHERE q.j < n"""
_EDGES = """
SELECT f.doc_id, f.page_no, f.side, f.n,
  CASE WHEN f.paper IS NULL OR f.paper <= 0 THEN 0 WHEN a.lead > 0 THEN b.dark ELSE coalesce(c.edge, 0) END AS edge
FROM facts f
JOIN (SELECT f.doc_id, f.side, coalesce(min(j) FILTER (NOT v < p.paper - 6), f.search) AS lead FROM facts f
      LEFT JOIN points p ON p.doc_id = f.doc_id AND p.side = f.side AND p.j < f.search GROUP BY f.doc_id, f.side, f.search) a
  ON a.doc_id = f.doc_id AND a.side = f.side
LEFT JOIN (SELECT x.doc_id, x.side, coalesce(min(j) FILTER (NOT v < p.paper - 2), x.search) AS dark
      FROM (SELECT f.doc_id, f.side, f.search, coalesce(min(j) FILTER (NOT v < p.paper - 6), f.search) AS lead FROM facts f
            LEFT JOIN points p ON p.doc_id = f.doc_id AND p.side = f.side AND p.j < f.search GROUP BY f.doc_id, f.side, f.search) x
      LEFT JOIN points p ON p.doc_id = x.doc_id AND p.side = x.side AND p.j < x.search AND p.j >= x.lead GROUP BY x.doc_id, x.side, x.search) b
  ON b.doc_id = f.doc_id AND b.side = f.side
LEFT JOIN (SELECT doc_id, side, arg_min(hi + 1, j) AS edge
      FROM (SELECT d.doc_id, d.side, d.j, any_value(d.wide) AS wide,
              coalesce(max(p.j) FILTER (p.j < d.j) + 1, 0) AS lo, coalesce(min(p.j) FILTER (p.j > d.j) - 1, any_value(d.n) - 1) AS hi
            FROM (SELECT * FROM points WHERE j >= 1 AND j < near AND paper - v >= 2.5 AND paper - v <= 40 AND v <= before AND v <= after) d
            LEFT JOIN points p ON p.doc_id = d.doc_id AND p.side = d.side AND p.paper - p.v < 2 GROUP BY d.doc_id, d.side, d.j)
      WHERE hi - lo + 1 <= wide GROUP BY doc_id, side) c
  ON c.doc_id = f.doc_id AND c.side = f.side"""
_EDGE_CHAIN = dict(prof=None, sides=_SIDES, facts=_FACTS, points=_POINTS, edges=_EDGES)
_SMALL = """
SELECT d.doc_id, 1 AS page_no, d.tw AS w, d.th AS h, rx.x, ry.y, t.g
FROM (SELECT *, CAST(greatest(40, floor(w * least(1, 700::DOUBLE / greatest(w, h)) + 0.5)) AS BIGINT) AS tw,
        CAST(greatest(40, floor(h * least(1, 700::DOUBLE / greatest(w, h)) + 0.5)) AS BIGINT) AS th
      FROM (SELECT doc_id, max(x) + 1 AS w, max(y) + 1 AS h FROM t_gray GROUP BY doc_id)) d, range(0, 700) ry(y), range(0, 700) rx(x)
JOIN t_gray t ON t.doc_id = d.doc_id AND t.y = ((2 * ry.y + 1) * d.h) // (2 * d.th) AND t.x = ((2 * rx.x + 1) * d.w) // (2 * d.tw)
WHERE ry.y < d.th AND rx.x < d.tw"""
_VEC = """
SELECT vec_id AS doc_id, k, CAST(floor(CAST(embedding[2 * k + 1] AS DOUBLE) * 1000) AS INT) AS x,
  CAST(floor(CAST(embedding[2 * k + 2] AS DOUBLE) * 1000) AS INT) AS y FROM embeddings, range(0, 32) t(k)"""
_SUB = "SELECT v.doc_id, pos, x, y FROM vec v JOIN range(0, 28) s(pos) ON v.k = (pos * 32) // 28"

def _area(i, j, k):
    return f"((x{j} - x{i}) * (y{k} - y{i}) - (x{k} - x{i}) * (y{j} - y{i}))"


# Every target pixel of 12 x 10 through the map of the quad, bilinear between four source pixels.
_WARP = f"""
SELECT doc_id, 1 AS page_no, CAST(j AS INT) AS y, CAST(sum(p * (i + 1)) AS BIGINT) AS checksum, CAST(sum(p) AS BIGINT) AS total
FROM (SELECT doc_id, i, j, CAST(round_even((s[b * 8 + a + 1] * (1 - fx) + s[b * 8 + least(a + 1, 7) + 1] * fx) * (1 - fy)
        + (s[least(b + 1, 7) * 8 + a + 1] * (1 - fx) + s[least(b + 1, 7) * 8 + least(a + 1, 7) + 1] * fx) * fy, 0) AS BIGINT) AS p
  FROM (SELECT *, CAST(floor(x) AS BIGINT) AS a, CAST(floor(y) AS BIGINT) AS b, x - floor(x) AS fx, y - floor(y) AS fy
    FROM (SELECT doc_id, s, i, j, greatest(0, least(7, (ca * u + cb * v + x0) / (cg * u + ch * v + 1))) AS x, greatest(0, least(7, (cd * u + ce * v + y0) / (cg * u + ch * v + 1))) AS y
      FROM (SELECT *, w1 * x1 - x0 AS ca, w3 * x3 - x0 AS cb, w1 * y1 - y0 AS cd, w3 * y3 - y0 AS ce, w1 - 1 AS cg, w3 - 1 AS ch
        FROM (SELECT *, {_area(0, 3, 2)} / nullif({_area(1, 3, 2)}, 0) AS w1, {_area(1, 0, 2)} / nullif({_area(1, 3, 2)}, 0) AS w3
          FROM (SELECT vec_id AS doc_id, (0.1::DOUBLE + abs(embedding[1]::DOUBLE)) * 7 AS x0, 0.1::DOUBLE * 7 AS y0, 0.9::DOUBLE * 7 AS x1, abs(embedding[2]::DOUBLE) * 7 AS y1,
              (1::DOUBLE - abs(embedding[3]::DOUBLE)) * 7 AS x2, 0.95::DOUBLE * 7 AS y2, 0.05::DOUBLE * 7 AS x3, (1::DOUBLE - abs(embedding[4]::DOUBLE)) * 7 AS y3
            FROM embeddings)) q) m JOIN page USING (doc_id),
        (SELECT i, i / 11::DOUBLE AS u FROM range(12) r(i)), (SELECT j, j / 9::DOUBLE AS v FROM range(10) r(j)))))
GROUP BY doc_id, j"""

SQL = {
    "otsu": sql("""
SELECT doc_id, page_no, CAST(coalesce(arg_min(v, v) FILTER (score = best AND best > 0), 127) AS INT) AS threshold
FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM (
  SELECT doc_id, page_no, v, CASE WHEN total > wb THEN (wb * (total - wb))::DOUBLE * (sb / wb - (mass - sb) / (total - wb)) * (sb / wb - (mass - sb) / (total - wb)) ELSE 0 END AS score
  FROM (SELECT doc_id, page_no, v, CAST(sum(n) OVER w AS BIGINT) AS wb, CAST(sum(n * v) OVER w AS BIGINT) AS sb,
          CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total, CAST(sum(n * v) OVER (PARTITION BY doc_id) AS BIGINT) AS mass
        FROM (SELECT doc_id, page_no, g AS v, count(*) AS n FROM t_gray GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY v))))
GROUP BY doc_id, page_no""", "t_gray"),
    "box_blur": sql(_LINE.format("b2"), "t_gray",
        b1="""SELECT doc_id, page_no, y, x, round((lag(g, 1, g) OVER w + g + lead(g, 1, g) OVER w) / 3) AS v FROM t_gray WINDOW w AS (PARTITION BY doc_id, y ORDER BY x)""",
        b2="""SELECT doc_id, page_no, y, x, round((lag(v, 1, v) OVER w + v + lead(v, 1, v) OVER w) / 3) AS v FROM b1 WINDOW w AS (PARTITION BY doc_id, x ORDER BY y)"""),
    "median_profiles": sql("SELECT * FROM prof", "t_gray", sized=_SIZED, prof=_profiles("sized")),
    "sheet_edge": sql("SELECT doc_id, page_no, side, CAST(edge AS INT) AS edge FROM edges", "t_gray", sized=_SIZED,
                      **{**_EDGE_CHAIN, "prof": _profiles("sized")}),
    "detect_sheet": sql("""
SELECT doc_id, page_no, CASE WHEN ok THEN round(x0, 6) END AS x0, CASE WHEN ok THEN round(y0, 6) END AS y0,
  CASE WHEN ok THEN round(x1, 6) END AS x1, CASE WHEN ok THEN round(y1, 6) END AS y1
FROM (SELECT *, x1 - x0 >= 0.55 AND y1 - y0 >= 0.55 AS ok FROM (
  SELECT doc_id, page_no, max(edge / n) FILTER (side = 'left') AS x0, max(edge / n) FILTER (side = 'top') AS y0,
    max((n - edge) / n) FILTER (side = 'right') AS x1, max((n - edge) / n) FILTER (side = 'bottom') AS y1 FROM edges GROUP BY ALL))""",
        "t_gray", sized=_SMALL, **{**_EDGE_CHAIN, "prof": _profiles("sized")}),
    # Runs take the least label of the runs they touch until none changes.
    "largest_component": """
WITH RECURSIVE t AS (
  SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '(?s).{1,64}') END AS l FROM documents),
 line AS (SELECT doc_id, y, list_transform(range(64), lambda x: CASE WHEN x < length(line) AND unicode(substring(line, CAST(x AS INT) + 1, 1)) % 256 < 105 THEN 1 ELSE 0 END) AS m
          FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS y FROM t)),
 starts AS (SELECT doc_id, y, unnest(list_filter(range(64), lambda i: m[i + 1] = 1 AND (i = 0 OR m[i] = 0))) AS x0, m FROM line),
 runs AS MATERIALIZED (SELECT doc_id, y, x0, x0 + coalesce(nullif(list_position(m[x0 + 1:], 0), 0), 65 - x0) - 1 AS x1, y * 100 + x0 AS id FROM starts),
 links AS MATERIALIZED (
  SELECT a.doc_id, a.id AS a, b.id AS b FROM runs a JOIN runs b ON b.doc_id = a.doc_id AND b.y = a.y + 1 AND b.x0 < a.x1 AND a.x0 < b.x1
  UNION ALL SELECT a.doc_id, b.id, a.id FROM runs a JOIN runs b ON b.doc_id = a.doc_id AND b.y = a.y + 1 AND b.x0 < a.x1 AND a.x0 < b.x1),
 -- first inside strips of 32 lines, then between the strips' labels: far fewer rounds than lines
 inside(doc_id, id, l) USING KEY (doc_id, id) AS (
  SELECT doc_id, id, id FROM runs
  UNION
  SELECT n.doc_id, n.b, min(w.l) FROM inside w JOIN links n ON n.doc_id = w.doc_id AND n.a = w.id AND n.a // 3200 = n.b // 3200
  JOIN recurring.inside r ON r.doc_id = n.doc_id AND r.id = n.b WHERE w.l < r.l GROUP BY n.doc_id, n.b),
 part AS MATERIALIZED (SELECT * FROM inside),
 meet AS MATERIALIZED (SELECT DISTINCT n.doc_id, p.l AS a, q.l AS b FROM links n JOIN part p ON p.doc_id = n.doc_id AND p.id = n.a JOIN part q ON q.doc_id = n.doc_id AND q.id = n.b
  WHERE n.a // 3200 <> n.b // 3200),
 across(doc_id, id, l) USING KEY (doc_id, id) AS (
  SELECT DISTINCT doc_id, l, l FROM part
  UNION
  SELECT n.doc_id, n.b, min(w.l) FROM across w JOIN meet n ON n.doc_id = w.doc_id AND n.a = w.id
  JOIN recurring.across r ON r.doc_id = n.doc_id AND r.id = n.b WHERE w.l < r.l GROUP BY n.doc_id, n.b),
 label AS MATERIALIZED (SELECT p.doc_id, p.id, w.l FROM part p JOIN across w ON w.doc_id = p.doc_id AND w.id = p.l),
 area AS (SELECT doc_id, l, sum(x1 - x0) AS area FROM label JOIN runs USING (doc_id, id) GROUP BY ALL),
 best AS (SELECT doc_id, arg_max(l, area * 10000000 - l) AS l, max(area) AS area FROM area GROUP BY doc_id),
 n AS (SELECT r.doc_id, r.y, sum(x1 - x0) AS n FROM label k JOIN best USING (doc_id, l) JOIN runs r ON r.doc_id = k.doc_id AND r.id = k.id GROUP BY ALL)
SELECT line.doc_id, 1 AS page_no, CAST(line.y AS INT) AS y, CAST(coalesce(best.area, 0) AS BIGINT) AS area, CAST(coalesce(n.n, 0) AS BIGINT) AS n
FROM line LEFT JOIN best USING (doc_id) LEFT JOIN n ON n.doc_id = line.doc_id AND n.y = line.y
""",
    "warp_perspective": sql(_WARP, "e_gray", page="SELECT doc_id, list(g ORDER BY y, x) AS s FROM e_gray GROUP BY doc_id"),
    # A corner is a column's least or greatest line that no chord between those of other columns covers.
    "convex_hull": sql("""
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY half, CASE WHEN half = 0 THEN x ELSE -x END) - 1 AS INT) AS pos, x, y
FROM corner""", "t_gray", ink="""
SELECT doc_id, page_no, x, min(y) AS lo, max(y) AS hi FROM t_gray WHERE g < 105 GROUP BY doc_id, page_no, x""",
        span="SELECT doc_id, min(x) AS x0, max(x) AS x1 FROM ink GROUP BY doc_id",
        side="""
SELECT doc_id, page_no, x, lo AS y, 0 AS half FROM ink UNION ALL
SELECT i.doc_id, page_no, x, hi, 1 FROM ink i JOIN span s ON s.doc_id = i.doc_id WHERE NOT (lo = hi AND x IN (x0, x1))""",
        corner="""
SELECT p.* FROM side p WHERE NOT EXISTS (
  SELECT 1 FROM ink a JOIN ink b ON b.doc_id = a.doc_id AND b.x > a.x
  WHERE a.doc_id = p.doc_id AND a.x < p.x AND b.x > p.x AND CASE WHEN p.half = 0
    THEN (b.x - a.x) * (p.y - a.lo) - (b.lo - a.lo) * (p.x - a.x) >= 0 ELSE (b.x - a.x) * (p.y - a.hi) - (b.hi - a.hi) * (p.x - a.x) <= 0 END)"""),
    "boundary_points": sql("""
SELECT a.doc_id, a.page_no, a.x, a.y FROM ink a WHERE (SELECT count(*) FROM ink b WHERE b.doc_id = a.doc_id
  AND ((b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1))) < 4""", "t_gray",
        ink="SELECT doc_id, page_no, y, x FROM t_gray WHERE g < 105"),
    "hull_subsample": sql("SELECT doc_id, 1 AS page_no, CAST(pos AS INT) AS pos, x, y FROM sub", vec=_VEC, sub=_SUB),
    "max_area_quad": sql("""
SELECT doc_id, 1 AS page_no, b.area AS area, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, b.x3 AS x3, b.y3 AS y3
FROM (SELECT doc_id, arg_max({'area': area, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'x3': x3, 'y3': y3},
          area * 2 * 1000000 - (((i * 28 + j) * 28 + k) * 28 + l)) AS b
  FROM (SELECT p.doc_id, p.pos AS i, q.pos AS j, r.pos AS k, s.pos AS l, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, r.x AS x2, r.y AS y2, s.x AS x3, s.y AS y3,
      abs(p.x * q.y - q.x * p.y + q.x * r.y - r.x * q.y + r.x * s.y - s.x * r.y + s.x * p.y - p.x * s.y) / 2 AS area
    FROM sub p JOIN sub q ON q.doc_id = p.doc_id AND q.pos > p.pos JOIN sub r ON r.doc_id = p.doc_id AND r.pos > q.pos
    JOIN sub s ON s.doc_id = p.doc_id AND s.pos > r.pos) WHERE area > 0 GROUP BY doc_id)""", vec=_VEC, sub=_SUB),
    "largest_per_page": sql("""SELECT doc_id, page_no, arg_max(y, s * 100000 - y) AS y, CAST(max(s) AS BIGINT) AS score
FROM (SELECT doc_id, page_no, y, sum(g) AS s FROM t_gray GROUP BY ALL) GROUP BY ALL""", "t_gray"),
    "burn_rects": sql(_LINE.format("painted"), "t_gray", painted="""
SELECT doc_id, page_no, y, x, CASE
  WHEN x >= doc_id % 25 + 10 AND x < doc_id % 25 + 22 AND y >= doc_id % 3 + 2 AND y < doc_id % 3 + 42 THEN 200
  WHEN x >= doc_id % 30 AND x < doc_id % 30 + 20 AND y >= doc_id % 5 AND y < doc_id % 5 + 6 THEN 0 ELSE g END AS v FROM t_gray"""),
    "burn_erase": sql(_LINE.format("painted"), "t_gray",
        sized="SELECT *, max(y) OVER (PARTITION BY doc_id) + 1 AS h FROM t_gray",
        seg="""SELECT * FROM (VALUES (0.125::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 2::DOUBLE), (0.5, 0.5, 0.875, 0.25, 2), (0.25, 0.75, 0.25, 0.75, 4)) t(ax, ay, bx, by_, rad)""",
        near="""SELECT doc_id, page_no, y, x, g, rad, x + 0.5::DOUBLE - ax * 64 AS px, y + 0.5::DOUBLE - ay * h AS py, (bx - ax) * 64 AS dx, by_ * h - ay * h AS dy FROM sized, seg""",
        proj="SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM near",
        painted="SELECT doc_id, page_no, y, x, CASE WHEN bool_or(power(px - t * dx, 2) + power(py - t * dy, 2) <= rad * rad) THEN 255 ELSE any_value(g) END AS v FROM proj GROUP BY doc_id, page_no, y, x"),
}
