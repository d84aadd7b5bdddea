"""Adaptive black-and-white conversion on a block grid.

Pixels are exploded and summed in the same code-generated stage (map-side
combine), so about one row per block and task is shuffled for statistics.
Each scanline then meets its block row once, on (page, block row).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..arrows import as_lists, bound_batches, flat, list_sizes, within
from ..fixed import BLOCK
from .raster import PAGE

DIM = 110


def block_stats(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Count, mean and population deviation of every block cell."""
    px = lines.select(*PAGE, F.expr(f"CAST(y div {block} AS INT)").alias("by"), F.posexplode("px").alias("x", "v"))
    return px.groupBy(*PAGE, "by", F.expr(f"CAST(x div {block} AS INT)").alias("bx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.expr("CAST(v AS BIGINT) * v")).alias("q")
    ).selectExpr(
        *PAGE, "by", "bx", "n", "s / n AS mean", "sqrt(greatest(0D, q / n - (s / n) * (s / n))) AS dev"
    )


def _block_rows(blocks: DataFrame) -> DataFrame:
    """One row per block row; cells in bx order (a page is at most a few hundred cells wide)."""
    return blocks.groupBy(*PAGE, "by").agg(
        F.sort_array(F.collect_list(F.struct("bx", "mean", "dev"))).alias("cells")
    )


def _smooth_rows(blocks: DataFrame) -> DataFrame:
    around = W.partitionBy(*PAGE).orderBy("by")
    near = _block_rows(blocks).withColumns(
        {"_up": F.lag("cells").over(around), "_dn": F.lead("cells").over(around)}
    )
    hood = """flatten(transform(filter(array(_up, cells, _dn), r -> r IS NOT NULL),
                r -> slice(r, greatest(c.bx, 1), least(c.bx + 1, size(r) - 1) - greatest(c.bx - 1, 0) + 1)))"""
    return near.selectExpr(
        *PAGE, "by",
        f"transform(cells, c -> named_struct('bx', c.bx, 'h', {hood})) AS hoods",
    ).selectExpr(
        *PAGE, "by",
        """transform(hoods, c -> named_struct('bx', c.bx, 'blurred', aggregate(c.h, 0D, (s, e) -> s + e.mean) / size(c.h),
             'blur_dev', array_max(transform(c.h, e -> e.dev)))) AS cells""",
    )


def block_smooth(blocks: DataFrame) -> DataFrame:
    """3x3 neighbourhood: mean of the means, maximum of the deviations; cells off the page do not count."""
    return _smooth_rows(blocks).selectExpr(*PAGE, "by", "explode(cells) AS c").selectExpr(
        *PAGE, "by", "c.bx AS bx", "c.blurred AS blurred", "c.blur_dev AS blur_dev"
    )


def dark_page_policy(smoothed: DataFrame, mode: str = "auto") -> DataFrame:
    """Whether dark areas of a page are inverted, from the share of dim blocks."""
    share = smoothed.groupBy(*PAGE).agg(
        (F.count_if(F.col("blurred") < DIM) / F.count(F.lit(1))).alias("dim_share")
    )
    if mode == "invert":
        rule = F.lit(True)
    elif mode == "ignore":
        rule = F.lit(False)
    else:
        rule = F.col("dim_share") <= 0.22
    return share.withColumn("invert_dark", rule)


def _grid_rows(smooth_rows: DataFrame, mode: str) -> DataFrame:
    """Block rows with the row below and the page's inversion decision."""
    page = W.partitionBy(*PAGE)
    out = smooth_rows.withColumn("_next", F.lead("cells").over(page.orderBy("by")))
    if mode == "invert":
        return out.withColumn("invert_dark", F.lit(True))
    if mode == "ignore":
        return out.withColumn("invert_dark", F.lit(False))
    return out.withColumns(
        {
            "_dim": F.sum(F.expr(f"size(filter(cells, c -> c.blurred < {DIM}))")).over(page),
            "_all": F.sum(F.size("cells")).over(page),
        }
    ).withColumn("invert_dark", F.col("_dim") / F.col("_all") <= 0.22).drop("_dim", "_all")


def _local_field(sizes, top, top_dev, low, low_dev, wy, block):
    """Paper brightness (bilinear) and strongest deviation under each pixel of lines laid end to end."""
    cells = list_sizes(top)
    first, last = (np.repeat(v, sizes) for v in (np.cumsum(cells) - cells, cells - 1))
    f = np.minimum(last, np.maximum(0.0, (within(sizes) - block / 2) / block))
    x0 = f.astype(np.int64)
    wx, x1 = f - x0, first + np.minimum(x0 + 1, last)
    x0, wy = first + x0, np.repeat(wy.to_numpy(zero_copy_only=False), sizes)
    t, u, v, w = (flat(c) for c in (top, low, top_dev, low_dev))
    m = t[x0] * (1 - wx) * (1 - wy) + t[x1] * wx * (1 - wy) + u[x0] * (1 - wx) * wy + u[x1] * wx * wy
    return m, np.maximum(np.maximum(v[x0], v[x1]), np.maximum(w[x0], w[x1]))


def _on_grid(lines: DataFrame, blocks: DataFrame, block: int, mode: str) -> DataFrame:
    """Scanlines joined once with their block row and the one below it."""
    by = f"CAST(floor(greatest((y - {block / 2}D) / {block}D, 0D)) AS INT)"
    j = lines.withColumn("by", F.expr(by)).join(_grid_rows(_smooth_rows(blocks), mode), [*PAGE, "by"])
    low = "coalesce(_next, cells)"
    return j.selectExpr(
        *lines.columns, "invert_dark",
        "transform(cells, c -> c.blurred) AS _top", "transform(cells, c -> c.blur_dev) AS _top_dev",
        f"transform({low}, c -> c.blurred) AS _low", f"transform({low}, c -> c.blur_dev) AS _low_dev",
        f"CASE WHEN _next IS NULL THEN 0D ELSE greatest((y - {block / 2}D) / {block}D, 0D) - by END AS _wy",
    )


_GRID = ["_top", "_top_dev", "_low", "_low_dev", "_wy"]


def background_at(lines: DataFrame, blocks: DataFrame, block: int = BLOCK, mode: str = "auto") -> DataFrame:
    """Local paper brightness and structure under every pixel (arrays paper, structure)."""

    bound_batches(lines.sparkSession)

    @F.arrow_udf("paper array<double>, structure array<double>")
    def field(px: pa.Array, a: pa.Array, ad: pa.Array, b: pa.Array, bd: pa.Array, wy: pa.Array) -> pa.Array:
        sizes = list_sizes(px)
        both = [as_lists(v, sizes, pa.float64()) for v in _local_field(sizes, a, ad, b, bd, wy, block)]
        return pa.StructArray.from_arrays(both, names=["paper", "structure"])

    grid = _on_grid(lines, blocks, block, mode)
    return grid.withColumn("_f", field("px", *_GRID)).select(
        *lines.columns, "invert_dark", "_f.paper", "_f.structure"
    )


def binarize(
    lines: DataFrame, bias: int | str = 0, contrast: int = 0, dark_areas: str = "auto", block: int = BLOCK
) -> DataFrame:
    """Black-and-white scanlines (1 = black); ``bias`` may name a column, for pages with their own.

    Statistics, smoothing and the page decision are Catalyst plans; the last
    step per pixel is array arithmetic on whole lines in Arrow batches.
    """
    k = max(-50, min(50, int(contrast)))
    flat_dev = max(3.0, 11 - k * 0.12)

    bound_batches(lines.sparkSession)

    @F.arrow_udf("array<int>")
    def ink(px: pa.Array, own: pa.Array, inv: pa.Array, a: pa.Array, ad: pa.Array, c: pa.Array, cd: pa.Array, wy: pa.Array) -> pa.Array:
        sizes = list_sizes(px)
        m, dev = _local_field(sizes, a, ad, c, cd, wy, block)
        b, invert = (np.repeat(v.to_numpy(zero_copy_only=False), sizes) for v in (own, inv))
        gap = np.minimum(80.0, np.maximum(5.0, 28 + b - k * 0.35))
        paper = np.minimum(m - gap, 210)
        bar = np.where(dev < flat_dev, -1.0, np.minimum(np.maximum(m + 60 - b, m + 20), 165))
        paper = np.where(invert.astype(bool) & (m < DIM), bar, paper)
        return as_lists((flat(px) < paper).astype(np.int32), sizes, pa.int32())

    grid = _on_grid(lines, block_stats(lines, block), block, dark_areas)
    own = F.col(bias) if isinstance(bias, str) else F.lit(int(bias))
    return grid.select(*PAGE, "y", ink("px", own, "invert_dark", *_GRID).alias("bit"))
