"""Thinned strokes over many chunks against the serial rule; geometric joins against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.catalog.bilevel import _checksum
from pagelake.functions import cells
from pagelake.operators import objects, raster, strokes


def serial(points, least):
    kept, last = [points[0]], points[0]
    for p in points[1:]:
        if math.sqrt((p[1] - last[1]) ** 2 + (p[2] - last[2]) ** 2) >= least:
            kept.append(p)
            last = p
    return kept if kept[-1] == points[-1] else [*kept, points[-1]]


def wandering(n, step, seed):
    rng = np.random.default_rng(seed)
    return [(k + 1, float(x), float(y)) for k, (x, y) in enumerate(np.cumsum(rng.normal(0, step, (n, 2)), axis=0))]


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_strokes_equal_the_serial_rule(spark, chunk):
    shapes = {1: wandering(400, 0.5, 1), 2: wandering(400, 0.02, 2), 3: [(k, 5.0, 5.0) for k in range(1, 60)], 4: [(7, 0.0, 0.0)],
              5: [(k, 0.0, 0.0) for k in range(1, 50)] + [(50, 2.0, 0.0)], 6: wandering(100, 30.0, 3), 7: [(k * 5, k % 3.0, 0.0) for k in range(1, 80)]}
    if chunk > 3:
        shapes[None] = wandering(30, 1.0, 9)[:chunk - 1]
    rows = [(s, *p) for s, points in shapes.items() for p in points]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stroke_id long, seq int, x double, y double")
    got = {}
    for r in strokes.simplify_stroke(df.where("stroke_id IS NOT NULL"), 1.2, chunk).collect():
        got.setdefault(r.stroke_id, []).append((r.seq, r.x, r.y))
    assert {s: sorted(g) for s, g in got.items()} == {s: serial(p, 1.2) for s, p in shapes.items() if s is not None}


def test_a_stroke_of_a_million_points(spark):
    points = wandering(1_000_000, 0.4, 5)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(points, columns=["seq", "x", "y"])).withColumn("stroke_id", F.lit(1)).repartition(8)
    got = sorted(tuple(r) for r in strokes.simplify_stroke(df, 1.2, 1 << 16).select("seq", "x", "y").collect())
    assert got == serial(points, 1.2)


# ------------------------------------------------------------- joins in cells

def test_candidates_do_not_grow_with_the_page(spark):
    """Ten thousand small objects and a few of any size: a point meets those near it."""
    rng = random.Random(3)
    rows = [(1, 1, k, "rect", rng.uniform(-500, 9000), rng.uniform(0, 9000), rng.uniform(5, 60), rng.uniform(5, 60), "", 1.0) for k in range(10_000)]
    rows += [(1, 1, 10_000 + k, "rect", 0.0, 0.0, 300.0 * 4 ** (k % 6), 200.0, "", 1.0) for k in range(6)]
    boxes = spark.createDataFrame(rows, "doc_id long, page_no int, z int, type string, x double, y double, w double, h double, text string, size double")
    points = [(1, 1, k, rng.uniform(-400, 8000), rng.uniform(0, 8000)) for k in range(300)] + [(1, 1, 300, 64.0, 64.0), (1, 1, 301, 0.0, 0.0)]
    probes = spark.createDataFrame(points, "doc_id long, page_no int, point_id int, px double, py double")
    got = {r.point_id: r.hit_z for r in objects.objects_at_points(probes, boxes, 7.5).collect()}
    want = {p[2]: max((r[2] for r in rows if r[4] - 7.5 <= p[3] <= r[4] + r[6] + 7.5 and r[5] - 7.5 <= p[4] <= r[5] + r[7] + 7.5), default=None) for p in points}
    assert got == want
    held = boxes.select(F.explode(F.expr(cells.box_cells("x", "y", "x + w", "y + h"))).alias("c"))
    assert held.count() <= 4 * len(rows)
    per_point = probes.select("point_id", F.explode(F.expr(cells.point_cells("px", "py"))).alias("c")).join(held, "c").groupBy("point_id").count()
    assert per_point.agg(F.max("count")).first()[0] < 60


def test_erasing_and_redacting_equal_all_pairs(spark):
    rng = random.Random(4)
    ink = [(1, 1, s, 1.0 + 40 * (s % 3), q, rng.uniform(-200, 2000), rng.uniform(-200, 2000)) for s in range(60) for q in range(6)]
    rub = [(1, 1, rng.uniform(-200, 2000), rng.uniform(-200, 2000)) for _ in range(40)]
    gone = {i[2] for i in ink for e in rub if (i[5] - e[2]) ** 2 + (i[6] - e[3]) ** 2 < (8 + i[3]) ** 2}
    left = objects.erase_ink(spark.createDataFrame(ink, "doc_id long, page_no int, stroke_id int, width double, seq int, x double, y double"),
                             spark.createDataFrame(rub, "doc_id long, page_no int, x double, y double"))
    assert {r.stroke_id for r in left.collect()} == set(range(60)) - gone and 0 < len(gone) < 60
    words = [(1, 1, k, "w", x, y, x + rng.uniform(1, 300), y + 12) for k in range(400) for x, y in [(rng.uniform(-50, 1000), rng.uniform(-50, 1000))]]
    rects = [(1, 1, rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(0, 200), rng.uniform(0, 90)) for _ in range(12)] + [(1, 1, 64.0, 64.0, 0.0, 0.0)]
    hit = {w[2] for w in words for r in rects if w[4] < r[2] + r[4] and w[6] > r[2] and w[5] < r[3] + r[5] and w[7] > r[3]}
    kept = objects.redact_words(spark.createDataFrame(words, "doc_id long, page_no int, idx int, text string, x0 double, y0 double, x1 double, y1 double"),
                                spark.createDataFrame(rects, "doc_id long, page_no int, rx double, ry double, rw double, rh double"))
    assert {r.idx for r in kept.collect()} == set(range(400)) - hit and 0 < len(hit) < 400


# ------------------------------------------------------------- sketched colours

def test_sketched_colours_stay_within_their_bound(spark):
    rng = np.random.default_rng(1)
    rows = []
    for page, distinct in ((1, 3), (2, 900), (3, 20_000), (4, 60_000)):
        kinds = rng.choice(1 << 24, distinct, replace=False)
        px = np.concatenate([kinds, rng.choice(kinds, 64_000 - distinct)])
        rows += [(1, page, y, (line >> 16).tolist(), (line >> 8 & 255).tolist(), (line & 255).tolist()) for y, line in enumerate(px.reshape(-1, 500))]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, y int, r array<int>, g array<int>, b array<int>")
    exact = {r.page_no: r for r in raster.page_qa(df).collect()}
    approx = raster.page_qa_approx(df)
    assert approx._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for r in approx.collect():
        want = exact[r.page_no]
        assert [r[c] for c in raster._SHARES] == pytest.approx([want[c] for c in raster._SHARES], abs=1e-12)
        assert abs(r.n_colours - want.n_colours) <= 4 * 1.04 / 64 * want.n_colours
    together = raster.colours_of(approx, "doc_id").first().n_colours
    truth = df.selectExpr("inline(arrays_zip(r, g, b))").distinct().count()
    assert abs(together - truth) <= 4 * 1.04 / 64 * truth


def test_sketches_get_colours_of_a_batch_not_pixels(spark):
    rows = [(d, 1, y, *[[((d or 0) + y) % 3 * 50] * 64] * 3) for d in [*range(300), None] for y in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, y int, r array<int>, g array<int>, b array<int>").coalesce(1)
    counts = raster.colour_counts(df, ["doc_id", "page_no"])
    assert counts.count() == 301 * 3 and counts.agg({"n": "sum"}).first()[0] == 301 * 4 * 64
    approx = raster.page_qa_approx(df)
    assert "MapInArrow" in approx._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_colours) for r in approx.collect()) == [(False, d, 3) for d in range(300)] + [(True, 0, 3)]


def test_erased_lines_equal_a_search_per_pixel_in_batches(spark):
    rng = random.Random(9)
    drawn = [(1, 1, rng.uniform(0.01, 0.1), [(rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1)) for _ in range(rng.choice((1, 2, 4)))]) for _ in range(12)]
    df = spark.createDataFrame([(1, 1, y, *[[(x * k + y) % 200 for x in range(90)] for k in (1, 3, 7)]) for y in range(60)] + [(2, 1, 0, [1], [2], [3])],
                               "doc_id long, page_no int, y int, r array<int>, g array<int>, b array<int>")
    strokes = spark.createDataFrame(drawn, "doc_id long, page_no int, size double, points array<struct<x double, y double>>")
    burnt = raster.burn_erase(df, strokes, spark.createDataFrame([(1, 1, 90, 60)], "doc_id long, page_no int, w int, h int"))
    plan = burnt._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "exists(" not in plan

    def near(x, y):
        for _, _, size, points in drawn:
            rad, p = max(1.0, size * 90) / 2, [(a * 90, b * 60) for a, b in points]
            for (ax, ay), (bx, by) in zip(p, p[1:] or p):
                dx, dy = bx - ax, by - ay
                t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((x + 0.5 - ax) * dx + (y + 0.5 - ay) * dy) / (dx * dx + dy * dy)))
                if (x + 0.5 - ax - t * dx) ** 2 + (y + 0.5 - ay - t * dy) ** 2 <= rad * rad:
                    return True
        return False

    got = {(r.doc_id, r.y): (r.r, r.g, r.b) for r in burnt.collect()}
    assert got.pop((2, 0)) == ([1], [2], [3])
    white = {(x, y) for y in range(60) for x in range(90) if near(x, y)}
    assert 200 < len(white) < 5000
    assert got == {(1, y): tuple([255 if (x, y) in white else (x * k + y) % 200 for x in range(90)] for k in (1, 3, 7)) for y in range(60)}


# ------------------------------------------------------------- F3 (round 4): boxes below a Python function

def test_boxes_are_painted_below_a_function_of_the_lines(spark):
    rng = random.Random(3)
    drawn = [(1, 1, rng.randint(-5, 20), rng.randint(-5, 12), rng.randint(0, 12), rng.randint(0, 9), z, rng.choice([None, *range(256)])) for z in range(25)]
    df = spark.createDataFrame([(1, 1, y, [(x * 3 + y) % 200 for x in range(18)]) for y in range(11)] + [(1, 1, 11, None), (1, 1, 12, [None, 7]), (2, 1, 0, [1, 2])],
                               "doc_id long, page_no int, y int, px array<int>")
    boxes = spark.createDataFrame(drawn + [(1, 1, 1, 11, 1, 2, 99, 5)], "doc_id long, page_no int, x int, y int, w int, h int, z int, color int")
    burnt = raster.burn_rects(df, boxes)
    plan = burnt._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan  # nested ones kept Spark from seeing a function above them
    want = {(1, y): [(x * 3 + y) % 200 for x in range(18)] for y in range(11)} | {(1, 11): None, (1, 12): [None, 7], (2, 0): [1, 2]}
    for _, _, x, y, w, h, _, v in drawn + [(1, 1, 1, 11, 1, 2, 99, 5)]:
        for at in range(y, y + h):
            if line := want.get((1, at)):
                line[max(x, 0):max(x + w, 0)] = [v] * len(line[max(x, 0):max(x + w, 0)])
    assert {(r.doc_id, r.y): r.px for r in burnt.collect()} == want
    plain = df.where("y < 11")
    sums = _checksum(raster.burn_rects(plain, boxes.where("color IS NOT NULL")), "px")  # what reads the result is a Python function
    grey = {(r.doc_id, r.y): r.px for r in raster.burn_rects(plain, boxes.where("color IS NOT NULL")).collect()}
    assert {(r.doc_id, r.y): (r.checksum, r.total) for r in sums.collect()} == {k: (sum(v * (x + 1) for x, v in enumerate(px)), sum(px)) for k, px in grey.items()}
