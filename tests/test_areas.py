"""Connected areas and hulls of pages cut into strips against whole pages."""

import numpy as np
import pyarrow as pa
import pytest

from pagelake.operators import areas, detect, raster

MASK = "doc_id long, page_no int, y int, mask array<int>"


def biggest(mask):
    """Largest set of touching pixels by flooding, the first in reading order on ties."""
    left, best = {(int(y), int(x)) for y, x in np.argwhere(mask)}, set()
    for start in sorted(left):
        if start in left:
            left.discard(start)
            area, todo = {start}, [start]
            while todo:
                y, x = todo.pop()
                for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if p in left:
                        left.discard(p)
                        area.add(p)
                        todo.append(p)
            best = area if len(area) > len(best) else best
    return best


def spiral(n):
    out = np.zeros((n, n), int)
    y = x = 0
    dy, dx = 0, 1
    out[0, 0] = 1
    for _ in range(n * n):
        if not (0 <= y + 2 * dy < n + dy and 0 <= x + 2 * dx < n + dx) or not (0 <= y + dy < n and 0 <= x + dx < n) or (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and out[y + 2 * dy, x + 2 * dx]):
            dy, dx = dx, -dy
            if not (0 <= y + dy < n and 0 <= x + dx < n) or out[y + dy, x + dx]:
                break
        y, x = y + dy, x + dx
        out[y, x] = 1
    return out


@pytest.mark.parametrize("strip", [1, 3, 7, 1000])
def test_strips_give_the_area_of_the_whole_page(spark, strip):
    rng = np.random.default_rng(strip)
    comb = np.zeros((20, 21), int)
    comb[:, ::2], comb[19] = 1, 1
    pages = {1: (rng.random((30, 25)) < 0.55).astype(int), 2: (rng.random((30, 25)) < 0.62).astype(int), 3: spiral(17), 4: comb,
             5: np.zeros((9, 5), int), 6: np.ones((10, 3), int), 7: np.eye(8, dtype=int), None: (rng.random((12, 9)) < 0.5).astype(int)}
    rows = [(d, 1, y, line.tolist()) for d, m in pages.items() if d is not None or strip == 1000 for y, line in enumerate(m)]
    got = {}
    for r in areas.largest_component(spark.createDataFrame(rows, MASK).repartition(4), strip=strip).collect():
        got.setdefault(r.doc_id, {})[r.y] = (r.comp, r.area)
    for d, lines in got.items():
        best = biggest(pages[d])
        assert sorted(lines) == list(range(len(pages[d]))) and {a for _, a in lines.values()} == {len(best)}
        assert {(y, x) for y, (comp, _) in lines.items() for x, v in enumerate(comp) if v} == best
    assert len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("chunk", [1, 5, None])
def test_hulls_of_parts_give_the_hull(spark, chunk):
    rng = np.random.default_rng(8)
    sets = {1: rng.integers(0, 60, (300, 2)), 2: np.array([[3, 4]]), 3: np.array([[0, 0], [5, 5], [9, 9]]), 4: np.array([[2, y] for y in range(30)]),
            5: (30 + 30 * np.stack([np.cos(np.arange(90)), np.sin(np.arange(90))], axis=1)).astype(int)}
    rows = [(d, 1, int(x), int(y)) for d, p in sets.items() for x, y in p]
    got = {}
    for r in areas.convex_hull(spark.createDataFrame(rows, "doc_id long, page_no int, x int, y int"), chunk=chunk).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.x, r.y))
    for d, points in sets.items():
        hull = [(x, y) for _, x, y in sorted(got[d])]
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        assert hull[0] == min(map(tuple, points.tolist())) and set(hull) <= set(map(tuple, points.tolist()))
        if len(hull) > 2:
            n = len(hull)
            assert all(cross(hull[i], hull[(i + 1) % n], hull[(i + 2) % n]) > 0 for i in range(n))
            assert all(cross(hull[i], hull[(i + 1) % n], p) >= 0 for i in range(n) for p in map(tuple, points.tolist()))


def test_hulls_of_many_pages_pass_in_batches(spark):
    rng = np.random.default_rng(3)
    pages = {d: (rng.random((rng.integers(1, 9), rng.integers(1, 12))) < 0.7).astype(int) for d in range(80)}
    df = spark.createDataFrame([(d, 1, y, row.tolist()) for d, m in pages.items() for y, row in enumerate(m)], "doc_id long, page_no int, y int, comp array<int>")
    points = detect.boundary_points(df)
    hulls = areas.convex_hull(points, chunk=3)
    assert "FlatMapGroupsInPandas" not in hulls._jdf.queryExecution().executedPlan().toString()
    edge = {}
    for d, m in pages.items():
        out = np.pad(m, 1)
        inner = out[:-2, 1:-1] & out[2:, 1:-1] & out[1:-1, :-2] & out[1:-1, 2:]
        edge[d] = {(int(x), int(y)) for y, x in zip(*np.nonzero(m & ~inner & 1))}
    got, corners = {}, {}
    for r in points.collect():
        got.setdefault(r.doc_id, set()).add((r.x, r.y))
    assert got == {d: e for d, e in edge.items() if e}
    for r in hulls.orderBy("pos").collect():
        corners.setdefault(r.doc_id, []).append((r.x, r.y))
    assert corners == {d: [tuple(map(int, p)) for p in areas._chain(np.array(sorted(e)))] for d, e in edge.items() if e}


# ------------------------------------------------------------- F5-F8 (round 4): areas of many pages in one batch

@pytest.mark.parametrize("strip", [2, 1000])
def test_areas_of_many_pages_pass_in_batches(spark, strip):
    rng = np.random.default_rng(strip)
    pages = {d: (rng.random((rng.integers(1, 9), 1 + (d or 0) % 11)) < rng.choice([0, 0.5, 0.7, 1])).astype(int) for d in [*range(90), None]}
    df = spark.createDataFrame([(d, 1, y, row.tolist()) for d, m in pages.items() for y, row in enumerate(m)], MASK).coalesce(1)
    found = areas.largest_component(df, strip=strip)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, {})[r.y] = (r.comp, r.area)
    assert got.keys() == pages.keys()
    for d, lines in got.items():
        best = biggest(pages[d])
        assert sorted(lines) == list(range(len(pages[d]))) and {a for _, a in lines.values()} == {len(best)}
        assert {(y, x) for y, (comp, _) in lines.items() for x, v in enumerate(comp) if v} == best


def test_reduced_pages_are_gathered_once_for_all_steps(spark, monkeypatch):
    """Blur, threshold and areas of many pages in one batch are those of the single operators."""
    rng = np.random.default_rng(12)
    pages = {d: np.full((3, 4), 70) if d % 7 == 0 else rng.integers(0, 256, (rng.integers(2, 9), 2 + d % 9)) for d in range(60)}
    df = spark.createDataFrame([(d, 1, y, row.tolist()) for d, m in pages.items() for y, row in enumerate(m)], "doc_id long, page_no int, y int, px array<int>").coalesce(1)
    plan = detect.detect_document(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroups" not in plan
    blurred = {}
    for r in raster.box_blur(df).orderBy("y").collect():
        blurred.setdefault(r.doc_id, []).append(r.px)
    limit = {r.doc_id: r.threshold for r in raster.otsu(raster.box_blur(df)).collect()}
    order = list(pages)
    kind = pa.list_(pa.struct([("y", pa.int32()), ("px", pa.list_(pa.int32()))]))
    monkeypatch.setattr(areas, "PART", 100)
    found = detect._both_areas.func(pa.array([[{"y": y, "px": row.tolist()} for y, row in enumerate(pages[d])] for d in order], kind)).to_pylist()
    for d, both in zip(order, found):
        assert [b["bright"] for b in both] == [1, 0]
        for b in both:
            best = biggest((np.array(blurred[d]) > limit[d]) == (b["bright"] == 1))
            assert b["area"] == len(best)
            assert [(e["y"], e["x0"], e["x1"]) for e in b["ends"]] == [
                (y, min(x for v, x in best if v == y), max(x for v, x in best if v == y)) for y in sorted({v for v, _ in best})]
