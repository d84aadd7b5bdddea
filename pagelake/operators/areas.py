"""Connected areas and convex hulls of pages of any height.

A page is cut into strips of lines. In a strip, runs of set pixels are linked to the runs
they touch in the next line and contracted to their least label. Areas of neighbouring strips meet
only in the runs of the two lines at their border, so what is contracted between strips is the labels of these runs,
in a few rounds of joins; then every strip marks its part of the largest area. No task holds more than a strip.
A label is the place of an area's first run, so that the least one is the first in reading order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..arrows import as_lists, bound_batches, flat, list_sizes
from ..session import cut_lineage

#: Lines of a strip, and of a part of a hull's points.
STRIP, CHUNK = 1024, 4096
#: Pixels whose runs are worked out at a time.
PART = 1 << 18
_LINE = 1 << 24  # more pixels than a line has


def touching(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in lines that follow each other and share a column; runs in reading order."""
    span = width + 2
    lo = np.searchsorted(rows * span + ends, (rows + 1) * span + starts, side="right")
    hi = np.searchsorted(rows * span + starts, (rows + 1) * span + ends, side="left")
    n = np.maximum(hi - lo, 0)
    upper = np.repeat(np.arange(len(rows)), n)
    return upper, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def line_runs(px: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first pixel and pixel after the last of every run, of lines laid end to end."""
    on, ends = px == 1, np.cumsum(sizes)
    before, after = np.append(False, on[:-1])[: len(on)], np.append(on[1:], False)[: len(on)]
    before[(ends - sizes)[sizes > 0]] = False
    after[ends[sizes > 0] - 1] = False
    first = np.flatnonzero(on & ~before)
    line = np.repeat(np.arange(len(sizes)), sizes)[first]
    return line, first - (ends - sizes)[line], np.flatnonzero(on & ~after) + 1 - (ends - sizes)[line]


def joined(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For each run the least run of its area (pixels above or beside each other touch); rows of a page follow each other, others don't."""
    label = np.arange(len(rows))
    upper, lower = touching(rows, starts, ends, width)
    while len(upper):
        a, b = label[upper], label[lower]
        apart = a != b
        upper, lower, a, b = upper[apart], lower[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(far := label[label], label):
            label = far
    return label


class Pages:
    """Many pages (or strips) of an Arrow batch, each a list of lines (y, pixels) in order of y; their runs and areas after ``of_pixels``."""

    def __init__(self, pages: pa.ListArray):
        self.n = list_sizes(pages)
        y, lines = pages.flatten().flatten()
        self.y, self.sizes = y.to_numpy(zero_copy_only=False).astype(np.int64), list_sizes(lines)
        self.page = np.repeat(np.arange(len(self.n)), self.n)
        self.px = flat(lines)

    def of_pixels(self, px: np.ndarray) -> Pages:
        """The same, with the runs and areas of the pixels that are 1."""
        self.rows, self.starts, self.ends = line_runs(px, self.sizes)
        self.own = self.page[self.rows]
        self.label = joined(self.rows + self.own, self.starts, self.ends, int(self.sizes.max(initial=0)))
        self.area = np.bincount(self.label, weights=self.ends - self.starts, minlength=len(self.rows)).astype(np.int64)
        return self

    def places(self) -> np.ndarray:
        return self.y[self.rows] * _LINE + self.starts

    def largest(self, among: np.ndarray) -> np.ndarray:
        """The largest of the areas ``among`` of each page that has any, the first in reading order on ties."""
        order = among[np.lexsort([among, -self.area[among], self.own[among]])]
        return order[np.unique(self.own[order], return_index=True)[1]]

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each page: whether a run is part of its largest area, and the area's size."""
        top = self.largest(np.flatnonzero(self.area))
        chosen, size = np.zeros(len(self.rows), bool), np.zeros(len(self.n), np.int64)
        chosen[top], size[self.own[top]] = True, self.area[top]
        return chosen[self.label], size

    def painted(self, chosen: np.ndarray) -> pa.ListArray:
        """Lines (y, comp) of each page with the chosen runs set."""
        base, step = np.cumsum(self.sizes) - self.sizes, np.zeros(self.sizes.sum() + 1, np.int32)
        np.add.at(step, (base[self.rows] + self.starts)[chosen], 1)
        np.add.at(step, (base[self.rows] + self.ends)[chosen], -1)
        lines = as_lists(np.cumsum(step, dtype=np.int32)[:-1], self.sizes, pa.int32())
        return self.lists(pa.StructArray.from_arrays([pa.array(self.y.astype(np.int32)), lines], names=["y", "comp"]), self.n)

    @staticmethod
    def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def in_parts(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The columns, the first of which has pages, cut into parts of about PART pixels: arrays of a whole batch were measured to be slow."""
    upto = np.append(0, np.cumsum(list_sizes(columns[0].flatten().field(1))))[np.append(0, np.cumsum(list_sizes(columns[0])))]
    start, n = 0, len(columns[0])
    while start < n:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + PART, side="right")) - 1)
        yield tuple(c.slice(start, end - start) for c in columns)
        start = end


def by_parts(step: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    @wraps(step)
    def run(*columns: pa.Array) -> pa.Array:
        done = [step(*part) for part in in_parts(*columns)]
        return pa.concat_arrays(done) if done else step(*columns)

    return run


def areas_of(pages: pa.ListArray) -> Pages:
    p = Pages(pages)
    return p.of_pixels(p.px)


def _struct(**kinds) -> StructType:
    return StructType([StructField(c, k) for c, k in kinds.items()])


_LINES = ArrayType(_struct(y=IntegerType(), comp=ArrayType(IntegerType())))


@F.arrow_udf(_struct(area=LongType(), lines=_LINES))
@by_parts
def _page_largest(pages: pa.Array) -> pa.Array:
    p = areas_of(pages)
    chosen, size = p.best()
    return pa.StructArray.from_arrays([pa.array(size), p.painted(chosen)], names=["area", "lines"])


def _whole(masks: DataFrame, *keys: str) -> DataFrame:
    """One row for each key with its lines (y, mask) in order; a mask's pixels take a byte each on their way."""
    lines = F.struct(F.col("y").cast("int").alias("y"), F.col("mask").cast("array<tinyint>").alias("mask"))
    return masks.select(*keys, lines.alias("_line")).groupBy(*keys).agg(F.sort_array(F.collect_list("_line")).alias("_lines"))


def ends_of_largest(p: Pages) -> tuple[np.ndarray, pa.ListArray]:
    """Area of each page's largest connected area and the outermost pixels of its lines."""
    own, size = p.best()
    at, first = np.unique(p.rows[own], return_index=True)
    last = np.append(first[1:], own.sum())[: len(at)] - 1
    columns = [pa.array(c.astype(np.int32)) for c in (p.y[at], p.starts[own][first], p.ends[own][last] - 1)]
    counts = np.bincount(p.page[at], minlength=len(p.n))
    return size, p.lists(pa.StructArray.from_arrays(columns, names=["y", "x0", "x1"]), counts)


@F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in "xy"])))
def hull_of_ends(pages: pa.Array) -> pa.Array:
    """Hull points in order, of each page's line ends."""
    y, x0, x1 = (c.to_numpy(zero_copy_only=False) for c in pages.flatten().flatten())
    points = np.stack([np.concatenate([x0, x1]), np.concatenate([y, y])], axis=1)
    ends, n = np.cumsum(list_sizes(pages)), len(y)
    hulls = [_chain(points[np.r_[a:b, n + a : n + b]].tolist()) for a, b in zip(np.append(0, ends), ends)]
    xy = np.concatenate([*[h.reshape(-1, 2) for h in hulls], np.zeros((0, 2))]).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hulls)]).astype(np.int32)), points)


@F.arrow_udf(ArrayType(_struct(side=IntegerType(), label=LongType(), area=LongType(), x0=IntegerType(), x1=IntegerType())))
@by_parts
def _strip_areas(strips: pa.Array) -> pa.Array:
    """Areas of each strip (side 0) and the runs of its first (1) and last (2) line, with their area's label.

    Of the areas that touch neither line, which no other strip adds to, only the largest is given.
    """
    p = areas_of(strips)
    ends = np.cumsum(p.n)
    top, bottom = (np.flatnonzero(p.rows == line[p.own]) for line in (ends - p.n, ends - 1))
    edge = np.unique(p.label[np.concatenate([top, bottom])])
    own = np.concatenate([edge, p.largest(np.setdiff1d(np.flatnonzero(p.area), edge, assume_unique=True))])
    at, side = np.concatenate([own, top, bottom]), np.repeat([0, 1, 2], [len(own), len(top), len(bottom)])
    order = np.argsort(p.own[at], kind="stable")
    at, side = at[order], side[order]
    rows = pa.StructArray.from_arrays(
        [pa.array(side.astype(np.int32)), pa.array(p.places()[p.label[at]]), pa.array(p.area[p.label[at]]),
         pa.array(p.starts[at].astype(np.int32)), pa.array(p.ends[at].astype(np.int32))], names=["side", "label", "area", "x0", "x1"])
    return p.lists(rows, np.bincount(p.own[at], minlength=len(p.n)))


@F.arrow_udf(_LINES)
@by_parts
def _marked(strips: pa.Array, labels: pa.Array) -> pa.Array:
    """Lines of each strip with the areas of the given labels."""
    p = areas_of(strips)
    wanted, place = np.repeat(np.arange(len(p.n)), list_sizes(labels)), p.places()
    kinds, code = np.unique(np.concatenate([place, flat(labels)]), return_inverse=True)
    code += np.concatenate([p.own, wanted]) * len(kinds)
    return p.painted(np.isin(code[: len(place)], code[len(place):])[p.label])


@F.arrow_udf(ArrayType(_struct(a=LongType(), b=LongType())))
def _border_links(borders: pa.Array) -> pa.Array:
    """Labels that touch at each border, of runs (below, x0, x1, label) of the line above it and the one below it."""
    n = list_sizes(borders)
    below, x0, x1, label = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in borders.flatten().flatten())
    line = 3 * np.repeat(np.arange(len(n)), n) + below
    upper, lower = touching(line, x0, x1, int(x1.max(initial=0)))
    pairs = pa.StructArray.from_arrays([pa.array(label[upper]), pa.array(label[lower])], names=["a", "b"])
    return Pages.lists(pairs, np.bincount(line[upper] // 3, minlength=len(n)))


def contracted(links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, label and root, the least label that links (a, b) lead to, for every label of a link."""
    both = cut_lineage(links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "border")
    now = both.select(*keys, F.col("a").alias("label"), F.col("a").alias("root")).distinct()
    while True:
        near = both.join(now.withColumnRenamed("label", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("root").alias("_near"))
        low = now.join(near, [*keys, "label"]).select(*keys, "label", "root", F.least("root", "_near").alias("_low"))
        onward = low.select(*keys, F.col("label").alias("_low"), F.col("_low").alias("_far"))
        new = cut_lineage(low.join(onward, [*keys, "_low"], "left").select(*keys, "label", F.col("root").alias("was"), F.coalesce("_far", "_low").alias("root")), "roots")
        now = new.drop("was")
        if new.where("was <> root").isEmpty():
            return now


def largest_component(masks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no"), strip: int | None = STRIP) -> DataFrame:
    """Lines of the largest connected area: comp (0/1 per pixel) and its area; the first in reading order on ties.

    All lines of a page are as wide as each other. ``strip`` None: pages are known to be small and stay whole.
    Pages and strips pass in Arrow batches, many at a time.
    """
    bound_batches(masks.sparkSession)
    out = [F.col("_line.y"), F.col("_line.comp"), F.col("area")]
    if strip is None or masks.where(F.col("y") >= strip).isEmpty():
        found = _whole(masks, *keys).select(*keys, _page_largest("_lines").alias("_a"))
        return found.select(*keys, F.col("_a.area").alias("area"), F.explode("_a.lines").alias("_line")).select(*keys, *out)
    # Keys as one struct: null keys are equal to each other.
    cut = masks.select(F.struct(*keys).alias("_page"), F.floor(F.col("y") / strip).alias("strip"), "y", "mask")
    strips = _whole(cut, "_page", "strip")
    # A strip without any pixel set has one row of nulls: it may be part of a page that has an area.
    found = cut_lineage(strips.select("_page", "strip", F.explode_outer(_strip_areas("_lines")).alias("_f")).select("_page", "strip", "_f.*"), "strip_areas")
    meet = found.where("side > 0").withColumn("strip", F.expr("if(side = 1, strip, strip + 1)"))
    # The upper strip's last line, then the lower strip's first.
    runs = F.struct((F.col("side") == 1).cast("int").alias("below"), "x0", "x1", "label")
    borders = meet.groupBy("_page", "strip").agg(F.sort_array(F.collect_list(runs)).alias("_runs")).where("_runs[0].below = 0 AND _runs[size(_runs) - 1].below = 1")
    links = borders.select("_page", F.explode(_border_links("_runs")).alias("_l")).select("_page", "_l.a", "_l.b")
    own = found.where("side = 0").join(contracted(links, ("_page",)), ["_page", "label"], "left").withColumn("root", F.coalesce("root", "label"))
    best = own.groupBy("_page", "root").agg(F.sum("area").alias("area")).groupBy("_page").agg(
        F.max_by(F.struct("root", "area"), F.struct("area", -F.col("root"))).alias("best")).select("_page", "best.*")
    chosen = own.select("_page", "strip", "label", "root").join(best, ["_page", "root"]).groupBy("_page", "strip").agg(F.collect_list("label").alias("labels"))
    marks = found.select("_page", "strip").distinct().join(best.select("_page", "area"), "_page", "left").join(chosen, ["_page", "strip"], "left")
    labels = F.coalesce("labels", F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    lines = strips.join(marks, ["_page", "strip"]).select("_page", F.expr("coalesce(area, 0L)").alias("area"), F.explode(_marked("_lines", labels)).alias("_line"))
    return lines.select(*[F.col(f"_page.{k}").alias(k) for k in keys], *out)


def _chain(points: np.ndarray) -> np.ndarray:
    """Convex hull, collinear points dropped, starting at the leftmost lowest point."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for x, y in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                out.pop()
            out.append((x, y))
        return out

    lower, upper = half(pts), half(reversed(pts))
    return np.array(lower[:-1] + upper[:-1])


def convex_hull(points: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_no"), chunk: int | None = CHUNK) -> DataFrame:
    """Hull points in order (pos 0, 1, ..).

    Only the outermost points of each line can be hull corners; that exact prefilter is a combined
    aggregate. Of these, hulls of ``chunk`` lines are merged, as a corner of the whole is one of its part:
    a page's last hull is that of the corners of its parts only. ``chunk`` None: pages are known to be small.
    Pages and parts pass in Arrow batches, many at a time.
    """
    bound_batches(points.sparkSession)
    ends = points.groupBy(*keys, F.col("y").cast("int").alias("y")).agg(F.min("x").cast("int").alias("x0"), F.max("x").cast("int").alias("x1"))
    part = [F.floor(F.col("y") / chunk).alias("_part")] if chunk else []
    hulls = ends.groupBy(*keys, *part).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("_ends")).select(*keys, hull_of_ends("_ends").alias("_hull"))
    if chunk:
        corners = F.expr("transform(flatten(collect_list(_hull)), p -> named_struct('y', p.y, 'x0', p.x, 'x1', p.x))")
        hulls = hulls.groupBy(*keys).agg(corners.alias("_ends")).select(*keys, hull_of_ends("_ends").alias("_hull"))
    return hulls.select(*keys, F.posexplode("_hull").alias("pos", "p")).select(*keys, "pos", "p.x", "p.y")
