"""Page rasters brought to their target size by area averages.

A target pixel is the mean of the source pixels it covers, each weighted with the
part of it that is covered; where the target is larger, a source pixel covers several. All weights
are whole numbers: on an axis of n source and t target pixels, source i spans [i*t, (i+1)*t) and
target k spans [k*n, (k+1)*n).

A line is averaged along itself with prefix sums, in its own task; then it adds to the
target lines it touches: at most two where lines are not multiplied. What a task has
of a target line is added up before the exchange, so that the narrowed lines are what is
shuffled, by page and target line: a page is never gathered and no task gets more than its share of lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..arrows import as_lists, flat, list_sizes, map_arrow, sum_lists, summed_by_key
from .raster import PAGE


def along(px: np.ndarray, target: int) -> np.ndarray:
    """Weighted sums of every line (row) over each target pixel; their weights add up to the line's width."""
    n, width = px.shape
    before = np.zeros((n, width + 1), np.int64)
    np.cumsum(px, axis=1, out=before[:, 1:])
    pixel, part = np.divmod(np.arange(target + 1) * width, target)
    cut = before[:, pixel] * target
    cut[:, part > 0] += px[:, pixel[part > 0]] * part[part > 0]
    return np.diff(cut, axis=1)


def touched(y: np.ndarray, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, target line, weight) for every target line that a source line touches."""
    first, last = y * target // h, ((y + 1) * target - 1) // h
    line = np.repeat(np.arange(len(y)), last - first + 1)
    at = first[line] + np.arange(len(line)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
    weight = np.minimum((y[line] + 1) * target[line], (at + 1) * h[line]) - np.maximum(y[line] * target[line], at * h[line])
    return line, at, weight


def _spread(columns: tuple[str, ...], keep: tuple[str, ...]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        y, h, w_px, h_px = (batch.column(c).to_numpy().astype(np.int64) for c in ("y", "h", "w_px", "h_px"))
        width = list_sizes(batch.column(columns[0]))
        narrowed = {c: [None] * batch.num_rows for c in columns}
        for w, t in set(zip(width.tolist(), w_px.tolist())):  # pages of one size are averaged together
            rows = np.flatnonzero((width == w) & (w_px == t))
            for c in columns:
                px = flat(batch.column(c).take(pa.array(rows))).astype(np.int64).reshape(len(rows), w)
                for row, sums in zip(rows, along(px, t)):
                    narrowed[c][row] = sums
        line, at, weight = touched(y, h, h_px)
        order = np.lexsort([at, np.arange(batch.num_rows)[line]]) if len(line) else line
        line, at, weight = line[order], at[order], weight[order]
        took = pa.array(line)
        out = {c: batch.column(c).take(took) for c in [*PAGE, *keep]}
        out |= {"y": pa.array(at.astype(np.int32)), "_w": pa.array(width[line].astype(np.int64)), "_cover": pa.array(weight)}
        for c in columns:
            parts = [narrowed[c][i] * k for i, k in zip(line, weight)]
            out[c] = as_lists(np.concatenate(parts) if parts else np.zeros(0, np.int64), w_px[line], pa.int64())
        rows = pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        return sum_lists(rows, [*PAGE, "y"], [*keep, "_w"], ["_cover"], columns)  # neighbours that touch the same target line

    return run


def _means(columns: tuple[str, ...], keep: tuple[str, ...]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight = batch.column("_w").to_numpy() * batch.column("_cover").to_numpy()
        out = [batch.column(c) for c in [*PAGE, *keep, "y"]]
        for c in columns:
            sizes = list_sizes(batch.column(c))
            own = np.repeat(weight, sizes)
            out.append(as_lists((2 * flat(batch.column(c)) + own) // (2 * own), sizes, pa.int32()))
        return pa.RecordBatch.from_arrays(out, names=[*PAGE, *keep, "y", *columns])

    return run


def resample(lines: DataFrame, columns: tuple[str, ...] = ("px",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Scanlines of w_px x h_px pixels: PAGE, ``keep``, y and ``columns``, values rounded half up.

    ``lines`` carry h, the page's number of source lines, and w_px and h_px next to their pixels
    (``sized_lines`` adds them where they don't). Lines without pixels, and pages without a target
    size, give nothing. Where source lines are missing, a target line is the mean of those that are there.
    ``keep`` columns must be the same all over a page.
    """
    kinds = dict(lines.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in [*PAGE, *keep])
    sound = lines.where((F.size(columns[0]) > 0) & (F.col("w_px") > 0) & (F.col("h_px") > 0) & (F.col("y") < F.col("h")))
    narrow = map_arrow(
        sound.select(*dict.fromkeys([*PAGE, *keep, "y", "h", "w_px", "h_px", *columns])), _spread(columns, keep),
        f"{head}, y int, _w bigint, _cover bigint, " + ", ".join(f"{c} array<bigint>" for c in columns))
    return summed_by_key(narrow, [*PAGE, "y"], [*keep, "_w"], ["_cover"], columns, _means(columns, keep),
                         f"{head}, y int, " + ", ".join(f"{c} array<int>" for c in columns))


def sized_lines(lines: DataFrame, sized: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines with h, w_px, h_px and ``keep`` of their page.

    The number of lines is counted without their pixels, and the sizes, one row a page, are what is
    joined; pages without a size are left out.
    """
    tall = lines.groupBy(*PAGE).agg((F.max("y") + 1).cast("int").alias("h"))
    return lines.join(sized.select(*PAGE, "w_px", "h_px", *keep).join(tall, PAGE), PAGE)
