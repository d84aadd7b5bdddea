"""Scanline operators. One row is one image line; a page raster is bounded by
the pixel cap of ``target_size`` (16 million pixels), so what is grouped or
ordered by (doc_id, page_no) is bounded by the page, never by the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..arrows import as_lists, bound_batches, flat, key_numbers, list_sizes, map_arrow, within

PAGE = ["doc_id", "page_no"]


def luminance(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RGB scanlines to grey scanlines; ``keep`` names further columns to carry along."""
    return lines.selectExpr(
        *PAGE, *keep, "y",
        "transform(arrays_zip(r, g, b), c -> shiftright(77 * c.r + 151 * c.g + 28 * c.b, 8)) AS px",
    )


@F.arrow_udf(ArrayType(IntegerType()))
def _blurred(up: pa.Array, px: pa.Array, down: pa.Array) -> pa.Array:
    sizes = list_sizes(px)
    at, last = within(sizes), np.repeat(sizes - 1, sizes)
    here = np.arange(len(at))
    left, right = here - (at > 0), here + (at < last)
    across = [np.rint((v[left] + v + v[right]) / 3.0) for v in map(flat, (up, px, down))]
    return as_lists(np.rint((across[0] + across[1] + across[2]) / 3.0).astype(np.int32), sizes, pa.int32())


def box_blur(lines: DataFrame) -> DataFrame:
    """3x3 mean in two rounded passes, edge pixels repeated; lines of a page are as wide as each other."""
    bound_batches(lines.sparkSession)
    by_line = W.partitionBy(*PAGE).orderBy("y")
    near = lines.withColumns({"_up": F.coalesce(F.lag("px").over(by_line), F.col("px")), "_dn": F.coalesce(F.lead("px").over(by_line), F.col("px"))})
    return near.withColumn("px", _blurred("_up", "px", "_dn")).drop("_up", "_dn")


def histogram(lines: DataFrame) -> DataFrame:
    """Pixel counts per page and grey value; at most 256 rows a page leave a task."""
    return lines.select(*PAGE, F.explode("px").alias("v")).groupBy(*PAGE, "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(lines: DataFrame) -> DataFrame:
    """Threshold with the greatest between-class variance; first maximum, 127 if none."""
    upto = W.partitionBy(*PAGE).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*PAGE)
    h = histogram(lines).withColumns(
        {
            "wb": F.sum("n").over(upto),
            "sb": F.sum(F.col("n") * F.col("v")).over(upto),
            "total": F.sum("n").over(whole),
            "mass": F.sum(F.col("n") * F.col("v")).over(whole),
        }
    ).selectExpr("*", "total - wb AS wf")
    scored = h.selectExpr(
        *PAGE, "v",
        """CASE WHEN wf > 0 THEN CAST(wb * wf AS DOUBLE) * (sb / wb - (mass - sb) / wf) * (sb / wb - (mass - sb) / wf)
             ELSE 0D END AS score""",
    )
    return scored.groupBy(*PAGE).agg(
        F.max(F.struct("score", (-F.col("v")).alias("neg"))).alias("best")
    ).selectExpr(*PAGE, "CASE WHEN best.score > 0 THEN -best.neg ELSE 127 END AS threshold")


@F.arrow_udf(ArrayType(IntegerType()))
def _column_medians(pages: pa.Array) -> pa.Array:
    """Upper median of each column of each page's lines; a column counts the lines that reach it."""
    out = []
    for k in range(len(pages)):
        rows = pages[k].values
        sizes = list_sizes(rows)
        px = np.full((len(sizes), sizes.max(initial=0)), np.iinfo(np.int32).max, np.int32)
        px[np.repeat(np.arange(len(sizes)), sizes), within(sizes)] = flat(rows)
        there = (sizes[:, None] > np.arange(px.shape[1])).sum(axis=0)
        out.append(np.sort(px, axis=0)[there // 2, np.arange(px.shape[1])])
    return as_lists(np.concatenate([*out, np.zeros(0, np.int32)]), np.array([len(o) for o in out], np.int64), pa.int32())


def median_profiles(lines: DataFrame) -> DataFrame:
    """Upper median brightness per row and column over the middle 60 % of the other axis.

    Row medians need no shuffle; a page's middle lines are gathered for its columns, which the pixel cap bounds.
    """
    bound_batches(lines.sparkSession)
    lo, hi = "CAST(floor({n} * 0.2D + 0.5) AS INT)", "CAST(floor({n} * 0.8D + 0.5) AS INT)"
    mid = f"slice(px, {lo.format(n='size(px)')} + 1, {hi.format(n='size(px)')} - {lo.format(n='size(px)')})"
    rows = lines.selectExpr(*PAGE, "'row' AS axis", "y AS i", f"sort_array({mid}) AS s").selectExpr(
        *PAGE, "axis", "i", "s[CAST(size(s) div 2 AS INT)] AS lum"
    )
    heights = lines.groupBy(*PAGE).agg((F.max("y") + 1).alias("h"))
    inner = lines.join(heights, PAGE).where(f"y >= {lo.format(n='h')} AND y < {hi.format(n='h')}")
    cols = inner.groupBy(*PAGE).agg(F.collect_list("px").alias("_px")).select(
        *PAGE, F.lit("col").alias("axis"), F.posexplode(_column_medians("_px")).alias("i", "lum"))
    return rows.unionByName(cols)


def white_rule(bias: int | str, of: str = "") -> str:
    """SQL condition on r, g and b ``of`` a row: paper white; ``bias`` may name a column."""
    r, g, b = (of + c for c in "rgb")
    limit = f"greatest(160, least(250, 225 - {bias if isinstance(bias, str) else int(bias)}))"
    return f"shiftright(77 * {r} + 151 * {g} + 28 * {b}, 8) >= {limit} AND greatest({r}, {g}, {b}) - least({r}, {g}, {b}) < 40"


def white_mask(lines: DataFrame, bias: int | str = 0) -> DataFrame:
    """Per pixel 1 where the RGB value counts as paper white; ``bias`` may name a column."""
    return lines.selectExpr(
        *PAGE, "y", "r", "g", "b",
        f"transform(arrays_zip(r, g, b), c -> CASE WHEN {white_rule(bias, 'c.')} THEN 1 ELSE 0 END) AS white",
    )


def colour_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, g, b and n of every colour in an Arrow batch of lines.

    A key comes once for each batch that has lines of it: pixels are counted before Spark sees them as rows.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, key = key_numbers([batch.column(c) for c in keys])
        r, g, b = (flat(batch.column(c)).astype(np.int64) for c in "rgb")
        kinds, n = np.unique(np.repeat(key, list_sizes(batch.column("r"))) << 24 | r << 16 | g << 8 | b, return_counts=True)
        took = pa.array(first[kinds >> 24])
        colours = [pa.array((kinds >> at & 255).astype(np.int32)) for at in (16, 8, 0)]
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(took) for c in keys], *colours, pa.array(n.astype(np.int64))], names=[*keys, *"rgb", "n"])

    kinds = dict(lines.dtypes)
    return map_arrow(lines.select(*keys, *"rgb"), run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", r int, g int, b int, n long")


_SHARES = {"black60": "l < 60", "black128": "l < 128", "white230": "l > 230", "nonwhite245": "l < 245", "coloured": "s > 40"}


def _in_regions(lines: DataFrame, regions: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """Lines, cut to each region's columns where there are regions, and their key columns."""
    if regions is None:
        return lines, [*PAGE]
    keys = [*PAGE, "region"]
    return lines.join(regions, PAGE).where("y >= ry0 AND y < ry1").selectExpr(
        *keys, "y", *[f"slice({c}, rx0 + 1, greatest(least(rx1, size({c})) - rx0, 0)) AS {c}" for c in "rgb"]), keys


def page_qa(lines: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Quality shares per page, or per region (half-open pixel boxes).

    One explode and two aggregates, all code-generated.
    """
    lines, keys = _in_regions(lines, regions)
    # The colour decides every share, so pixels are first counted per colour
    # (combined map-side); that also gives the exact number of colours.
    px = lines.selectExpr(*keys, "inline(arrays_zip(r, g, b))")
    kinds = px.groupBy(*keys, F.expr("r * 65536 + g * 256 + b").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rgb = kinds.selectExpr(*keys, "n", "shiftright(k, 16) AS r", "shiftright(k, 8) & 255 AS g", "k & 255 AS b").selectExpr(
        *keys, "n", "shiftright(77 * r + 151 * g + 28 * b, 8) AS l", "greatest(r, g, b) - least(r, g, b) AS s"
    )
    shares = [(F.sum(F.expr(f"CASE WHEN {cond} THEN n ELSE 0 END")) / F.sum("n")).alias(name) for name, cond in _SHARES.items()]
    return rgb.groupBy(*keys).agg(*shares, F.count(F.lit(1)).alias("n_colours"))


#: Standard error of the number of colours is 1.04 / sqrt(2^SKETCH_BITS), 1.6 %; few colours are counted exactly.
SKETCH_BITS = 12


def page_qa_approx(lines: DataFrame, regions: DataFrame | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """Exact shares as ``page_qa``, the number of colours from a mergeable sketch.

    A photograph has nearly as many colours as pixels; here a task passes on one row a page, of
    sums and a sketch of at most 2^bits bytes. ``colours`` is the sketch, for ``colours_of``.
    """
    lines, keys = _in_regions(lines, regions)
    # A sketch sorts its input once there are many pages: what it gets is a batch's colours, not pixels.
    px = colour_counts(lines, keys).selectExpr(
        *keys, "n", "r * 65536 + g * 256 + b AS k", "shiftright(77 * r + 151 * g + 28 * b, 8) AS l", "greatest(r, g, b) - least(r, g, b) AS s")
    shares = [(F.sum(F.expr(f"CASE WHEN {cond} THEN n ELSE 0 END")) / F.sum("n")).alias(name) for name, cond in _SHARES.items()]
    return px.groupBy(*keys).agg(*shares, F.hll_sketch_agg("k", bits).alias("colours")).withColumn("n_colours", F.hll_sketch_estimate("colours"))


def colours_of(qa: DataFrame, *keys: str) -> DataFrame:
    """Number of colours over all pages (or regions) of a key, such as a document, by merging their sketches."""
    return qa.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("colours")).alias("n_colours"))


def planes(lines: DataFrame) -> list[str]:
    """The pixel columns that scanlines have: px, or r, g and b."""
    return [c for c in ("px", "r", "g", "b") if c in lines.columns]


@F.arrow_udf(ArrayType(IntegerType()))
def _painted(px: pa.Array, x0: pa.Array, x1: pa.Array, v: pa.Array) -> pa.Array:
    """Lines with their spans painted over them, in the order of each line's lists; nulls stay what they are."""
    sizes, spans = list_sizes(px), list_sizes(x0)
    ends, line = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), spans)
    low, high = (np.clip(pc.fill_null(c.flatten(), 0).to_numpy(zero_copy_only=False), 0, sizes[line]) + (ends - sizes)[line] for c in (x0, x1))
    top = np.full(sizes.sum(), -1)
    for s, (start, end) in enumerate(zip(low.tolist(), high.tolist())):
        top[start:end] = s
    bare = top < 0
    out = pc.if_else(pa.array(bare), px.flatten(), v.flatten().take(pa.array(top, mask=bare))).cast(pa.int32())
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, out, mask=px.is_null())


def burn_rects(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """Opaque boxes (x, y, w, h, z; whole pixels) painted in z order, on grey or RGB scanlines.

    A box has ``color``, the same in every plane, or r, g and b of its own.
    A box is spread over the lines it covers, so line and box meet on an exact
    (page, line) key instead of a range comparison inside a page. Whole lines are
    painted in Arrow batches: nested lambdas do not pass below a Python function that reads the result.
    """
    values = ", ".join(f"'v_{c}', CAST({c if c in rects.columns else 'color'} AS INT)" for c in planes(lines))
    spans = rects.where("h > 0 AND w > 0").selectExpr(
        *PAGE, "explode(sequence(CAST(y AS INT), CAST(y + h - 1 AS INT))) AS y",
        f"named_struct('z', z, 'x0', CAST(x AS INT), 'x1', CAST(x + w AS INT), {values}) AS s",
    ).groupBy(*PAGE, "y").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    bound_batches(lines.sparkSession)
    painted = {c: _painted(c, "spans.x0", "spans.x1", f"spans.v_{c}") for c in planes(lines)}
    return lines.join(spans, [*PAGE, "y"], "left").withColumns(painted).drop("spans")


#: Pixels whose distances are worked out at a time.
_NEAR_PIXELS = 1 << 20


def _erased(columns: list[str]):
    """Lines whose pixels are white where their centre is near one of the line's segments."""
    @F.arrow_udf(StructType([StructField(c, ArrayType(IntegerType())) for c in columns]))
    def run(y: pa.Array, segs: pa.Array, *px: pa.Array) -> pa.Array:
        sizes = list_sizes(px[0])
        line = np.repeat(np.arange(len(sizes)), list_sizes(segs))
        rad, ax, ay, dx, dy = (c.to_numpy(zero_copy_only=False) for c in segs.flatten().flatten())
        row = y.to_numpy(zero_copy_only=False)[line] + 0.5 - ay
        base, n = np.cumsum(sizes) - sizes, sizes[line]
        white, reached = np.zeros(sizes.sum(), bool), np.cumsum(n)
        start = 0
        while start < len(line):
            end = max(start + 1, int(np.searchsorted(reached, (reached[start - 1] if start else 0) + _NEAR_PIXELS, side="right")))
            s = np.repeat(np.arange(start, end), n[start:end])
            i = within(n[start:end])
            across, long = i + 0.5 - ax[s], dx[s] * dx[s] + dy[s] * dy[s]
            still = (dx[s] == 0) & (dy[s] == 0)
            t = np.clip((across * dx[s] + row[s] * dy[s]) / np.where(still, 1.0, long), 0.0, 1.0)
            t[still] = 0.0
            near = (across - t * dx[s]) ** 2 + (row[s] - t * dy[s]) ** 2 <= rad[s] * rad[s]
            white[(base[line[s]] + i)[near]] = True
            start = end
        out = [as_lists(np.where(white, 255, flat(c)).astype(np.int32), sizes, pa.int32()) for c in px]
        return pa.StructArray.from_arrays(out, names=columns)

    return run


def burn_erase(lines: DataFrame, strokes: DataFrame, sizes: DataFrame) -> DataFrame:
    """White strokes with round ends painted over the page, on grey or RGB scanlines.

    ``strokes``: size and points normalised to the page; ``sizes``: w, h in
    pixels. A pixel is painted when its centre lies within half the stroke
    width of a segment; soft edges are not reproduced.
    """
    seg = strokes.join(sizes, PAGE).selectExpr(
        *PAGE, "greatest(1D, size * w) / 2 AS rad",
        "transform(points, p -> named_struct('x', p.x * w, 'y', p.y * h)) AS p",
    ).selectExpr(
        *PAGE, "rad",
        "explode(transform(sequence(0, greatest(size(p) - 2, 0)), i -> named_struct('a', p[i], 'b', coalesce(get(p, i + 1), p[i])))) AS s",
    ).selectExpr(*PAGE, "rad", "s.a.x AS ax", "s.a.y AS ay", "s.b.x - s.a.x AS dx", "s.b.y - s.a.y AS dy")
    # Per covered line one interval-free test remains: distance of each centre, of whole lines in Arrow batches.
    hit = seg.selectExpr(
        *PAGE, "named_struct('rad', rad, 'ax', ax, 'ay', ay, 'dx', dx, 'dy', dy) AS s",
        """explode(sequence(greatest(0, CAST(floor(least(ay, ay + dy) - rad - 1) AS INT)),
             greatest(0, CAST(ceil(greatest(ay, ay + dy) + rad) AS INT)))) AS y""",
    ).groupBy(*PAGE, "y").agg(F.collect_list("s").alias("segs"))
    bound_batches(lines.sparkSession)
    own = planes(lines)
    joined = lines.join(hit, [*PAGE, "y"], "left").withColumn("_white", _erased(own)("y", "segs", *own))
    return joined.withColumns({c: F.col(f"_white.{c}") for c in own}).drop("segs", "_white")


def raster_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels that differ between two rasters of a page; -1 when the sizes differ."""
    j = a.select(*PAGE, "y", F.col("px").alias("pa")).join(
        b.select(*PAGE, "y", F.col("px").alias("pb")), [*PAGE, "y"], "full_outer"
    )
    per_line = j.selectExpr(
        *PAGE, "pa IS NULL OR pb IS NULL OR size(pa) <> size(pb) AS odd",
        "size(filter(zip_with(coalesce(pa, array()), coalesce(pb, array()), (p, q) -> p <=> q), e -> NOT e)) AS n",
    )
    return per_line.groupBy(*PAGE).agg(F.expr("CASE WHEN bool_or(odd) THEN -1L ELSE sum(n) END").alias("n_diff"))


def signature_alpha(
    lines: DataFrame, brightness: int = 0, contrast: int = 0, threshold: int = 50, recolour: tuple | None = None
) -> DataFrame:
    """Paper to transparency: alpha per pixel, optionally with one ink colour."""
    c = contrast / 100
    gain = (1 + c) / (1 - min(0.99, c))
    limit = 40 + threshold / 100 * 180
    shade = f"greatest(0D, least(255D, {gain!r}D * (shiftright(77 * p.r + 151 * p.g + 28 * p.b, 8) - 128) + 128 + {brightness * 1.27!r}D))"
    out = lines.selectExpr(
        *PAGE, "y", "r", "g", "b",
        f"transform(arrays_zip(r, g, b), p -> greatest(0D, least(1D, ({limit!r}D - {shade}) / 26 + 0.5))) AS alpha",
    ).withColumn("a", F.expr("transform(alpha, v -> CAST(floor(v * 255 + 0.5) AS INT))"))
    if recolour:
        for name, v in zip("rgb", recolour):
            out = out.withColumn(name, F.expr(f"transform({name}, q -> {int(v)})"))
    return out


def ink_bbox(alpha: DataFrame, pad: int = 8) -> DataFrame:
    """Padded bounding box of visible ink per page; the whole page when there is none."""
    seen = alpha.selectExpr(
        *PAGE, "y", "size(alpha) AS w", "filter(sequence(0, size(alpha) - 1), i -> alpha[i] > 0.02) AS xs"
    ).groupBy(*PAGE).agg(
        F.max("w").alias("w"), (F.max("y") + 1).alias("h"),
        F.min(F.expr("array_min(xs)")).alias("x0"), F.max(F.expr("array_max(xs)")).alias("x1"),
        F.min(F.expr("CASE WHEN size(xs) > 0 THEN y END")).alias("y0"),
        F.max(F.expr("CASE WHEN size(xs) > 0 THEN y END")).alias("y1"),
    )
    return seen.selectExpr(
        *PAGE,
        f"CASE WHEN x1 IS NULL THEN 0 ELSE greatest(0, x0 - {pad}) END AS x",
        f"CASE WHEN x1 IS NULL THEN 0 ELSE greatest(0, y0 - {pad}) END AS y",
        f"CASE WHEN x1 IS NULL THEN w ELSE least(w, x1 + {pad} + 1) - greatest(0, x0 - {pad}) END AS cw",
        f"CASE WHEN x1 IS NULL THEN h ELSE least(h, y1 + {pad} + 1) - greatest(0, y0 - {pad}) END AS ch",
    )
