"""Numbers and properties the operators must keep, on small hand-made inputs."""

import datetime as dt
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.fixed import T6_END_OF_BLOCK, T6_HORIZONTAL, T6_PASS, T6_VERTICAL
from pagelake.functions import fax
from pagelake.operators import (
    assemble, attempts, bilevel, binarize, detect, estimate, intake, layout, objects, options, palette, raster,
)
from pagelake.session import scratch_path
from pagelake.sinks import files as sinks
from pagelake.sources import files as sources
from pagelake.streaming import jobs

LINE = "doc_id long, page_no int, y int, px array<int>"


def lines(spark, img, doc=1, page=1):
    return spark.createDataFrame([(doc, page, y, [int(v) for v in row]) for y, row in enumerate(img)], LINE)


def back(df, col="px"):
    return np.array([r[col] for r in df.orderBy("y").collect()])


# ------------------------------------------------------------------- bilevel

def decode_t6(data, width, height):
    """Independent reader of the two-dimensional code."""
    bits = "".join(f"{b:08b}" for b in data)
    runs = [{}, {}]
    for colour in (0, 1):
        for r, w in enumerate(fax.TERMINATING[colour]):
            runs[colour][w] = r
        for r, w in enumerate(fax.MAKEUP[colour]):
            runs[colour][w] = 64 * (r + 1)
    modes = {w: ("v", d) for d, w in T6_VERTICAL.items()} | {T6_PASS: ("p", 0), T6_HORIZONTAL: ("h", 0)}
    at = 0

    def word(table):
        nonlocal at
        for n in range(1, 14):
            if bits[at:at + n] in table:
                at += n
                return table[bits[at - n:at]]
        raise ValueError(bits[at:at + 20])

    def run(colour):
        total = 0
        while True:
            r = word(runs[colour])
            total += r
            if r < 64:
                return total

    ref, out = np.zeros(width, int), []
    for _ in range(height):
        row, a0, colour = np.zeros(width, int), -1, 0
        while a0 < width:
            cand = [x for x in range(max(a0 + 1, 0), width) if ref[x] != (ref[x - 1] if x else 0) and ref[x] != colour]
            b1 = cand[0] if cand else width
            later = [x for x in range(b1 + 1, width) if ref[x] != ref[x - 1]]
            b2 = later[0] if later else width
            mode, d = word(modes)
            start = max(a0, 0)
            if mode == "p":
                row[start:b2] = colour
                a0 = b2
            elif mode == "v":
                row[start:b1 + d] = colour
                a0, colour = b1 + d, 1 - colour
            else:
                one, two = run(colour), run(1 - colour)
                row[start:start + one] = colour
                row[start + one:start + one + two] = 1 - colour
                a0 = start + one + two
        out.append(row)
        ref = row
    assert bits[at:at + 24] == T6_END_OF_BLOCK
    return np.array(out)


@pytest.fixture(scope="module")
def stress():
    rng = np.random.default_rng(7)
    img = np.zeros((60, 150), int)
    for _ in range(40):
        y, x = rng.integers(0, 55), rng.integers(0, 140)
        img[y:y + rng.integers(1, 6), x:x + rng.integers(1, 30)] ^= 1
    img[30:34] = rng.integers(0, 2, (4, 150))
    img[40] = 1
    return img


def test_fax_code_is_pixel_exact(spark, stress):
    bits = lines(spark, stress).withColumnRenamed("px", "bit")
    for codec in ("g4", "flate"):
        row = assemble.encode_bilevel(bits, codec).first()
        assert row.codec == codec
        if codec == "g4":
            got = decode_t6(row.stream, 150, 60)
        else:
            packed = np.unpackbits(np.frombuffer(zlib.decompress(row.stream), np.uint8).reshape(60, -1), axis=1)
            got = 1 - packed[:, :150]
        assert (got == stress).all()
    sizes = bilevel.page_codec_sizes(bits).first()
    auto = assemble.encode_bilevel(bits).first()
    assert len(auto.stream) == min(sizes.g4_bytes, sizes.flate_bytes)


def test_wide_runs(spark):
    img = np.zeros((3, 6000), int)
    img[1, 10:5500] = 1
    bits = lines(spark, img).withColumnRenamed("px", "bit")
    assert (decode_t6(assemble.encode_bilevel(bits, "g4").first().stream, 6000, 3) == img).all()


def test_runs_cover_the_line(spark, stress):
    runs = bilevel.pixel_runs(lines(spark, stress).withColumnRenamed("px", "bit"))
    assert {r[0] for r in runs.groupBy("y").sum("length").select("sum(length)").collect()} == {150}
    bits = bilevel.g4_line_bits(lines(spark, stress).withColumnRenamed("px", "bit"))
    assert bits.where("bits < 1").isEmpty()


def test_pixel_counts_of_diff(spark, stress):
    a = lines(spark, stress)
    assert raster.raster_diff(a, a).first().n_diff == 0
    other = stress.copy()
    other[3, 4] ^= 1
    assert raster.raster_diff(a, lines(spark, other)).first().n_diff == 1
    assert raster.raster_diff(a, lines(spark, other[:-1])).first().n_diff == -1


def dark_photo():
    rng = np.random.default_rng(3)
    yy, xx = np.mgrid[0:150, 0:112]
    r = np.hypot(yy - 75, xx - 56) / 94
    g = 150 - 71 * np.clip(r, 0, 1) + rng.integers(-23, 24, (150, 112))
    for k in range(14):
        g[30 + k * 6, 30:80] = 20
    return np.clip(g, 0, 255).astype(int)


def test_binarize_by_hand(spark):
    """Paper of 200 everywhere: the bar is 200 - 28 = 172, and -4 more bias or 10 more contrast move it as told."""
    g = np.full((16, 16), 200)
    g[5, 3], g[6, 3], g[7, 3] = 120, 160, 180
    black = lambda **o: set(map(tuple, np.argwhere(back(binarize.binarize(lines(spark, g), dark_areas="ignore", block=16, **o), "bit"))))
    # The block's mean is a little under the paper: (253 * 200 + 460) / 256 = 199.45.
    assert black() == {(5, 3), (6, 3)}
    assert black(bias=20) == {(5, 3)}  # 199.45 - 48 = 151.45
    assert black(bias=-16) == {(5, 3), (6, 3), (7, 3)}  # 199.45 - 12 = 187.45
    assert black(contrast=40) == {(5, 3), (6, 3), (7, 3)}  # 199.45 - 14 = 185.45


def test_binarize_does_not_see_a_shift_of_blocks(spark):
    """An even page has no black whatever its tone; doubling the page sideways doubles the result away from the seam."""
    for tone in (40, 120, 250):
        assert back(binarize.binarize(lines(spark, np.full((24, 24), tone)), dark_areas="ignore", block=8), "bit").sum() == 0
    g = np.full((24, 24), 230)
    g[::5, 6:18] = 40
    once = back(binarize.binarize(lines(spark, g), dark_areas="ignore", block=8), "bit")
    twice = back(binarize.binarize(lines(spark, np.hstack([g, g])), dark_areas="ignore", block=8), "bit")
    assert (twice[:, :12] == once[:, :12]).all() and (twice[:, 36:] == once[:, 12:]).all()


def test_dark_photo_border(spark):
    g = dark_photo()
    share = {m: back(binarize.binarize(lines(spark, g), dark_areas=m, block=8), "bit")[:12].mean() for m in ("auto", "invert")}
    assert share["auto"] < 0.3 and share["invert"] > share["auto"] + 0.2


def test_bias_is_monotone(spark):
    g = dark_photo()
    black = [back(binarize.binarize(lines(spark, g), b, 0, "ignore", block=16), "bit").sum() for b in (-20, 0, 20)]
    assert black[0] >= black[1] >= black[2]


# -------------------------------------------------------------------- colour

def test_palette_pages(spark):
    rng = np.random.default_rng(5)
    rgb = rng.integers(0, 200, (40, 30, 3))
    rgb[:5] = 255
    df = spark.createDataFrame(
        [(1, 1, y, *[[int(v) for v in rgb[y, :, c]] for c in range(3)]) for y in range(40)],
        "doc_id long, page_no int, y int, r array<int>, g array<int>, b array<int>",
    )
    idx, pal = palette.quantize_indexed(df, 16)
    table = {r.k: (r.r, r.g, r.b) for r in pal.collect()}
    assert table[0] == (255, 255, 255) and len(table) == 16
    got = back(idx, "idx")
    assert (got[:5] == 0).all()
    cols = np.array([table[k] for k in range(16)])
    near = ((rgb[5:, :, None] - cols) ** 2).sum(-1)
    assert (np.take_along_axis(near, got[5:, :, None], 2)[..., 0] == near.min(-1)).all()
    row = assemble.encode_indexed(idx, pal).first()
    raw = np.frombuffer(zlib.decompress(row.stream), np.uint8).reshape(40, 15)
    assert (np.stack([raw >> 4, raw & 15], 2).reshape(40, 30) == got).all() and len(row.palette) == 96


# ------------------------------------------------------------------ geometry

def test_bed_fraction(spark):
    px = [(round(215.9 / 25.4 * d), round(297 / 25.4 * d), d) for d in (300, 600)] + [(2480, 3508, 300)]
    df = spark.createDataFrame([(k, w, h, d, "left", "top") for k, (w, h, d) in enumerate(px)],
                               "doc_id long, px_w int, px_h int, scan_dpi int, origin_x string, origin_y string")
    df = df.selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS found_{c}" for c in ("x0", "y0", "x1", "y1")])
    rows = layout.pick_sheet(layout.bed_a4(df)).orderBy("doc_id").collect()
    for r in rows[:2]:
        assert abs(r.sheet[1].x - 210 / 215.9) < 0.001
    assert rows[2].sheet is None


def test_sheet_edges(spark):
    shadow = [255] * 300
    shadow[4:7] = [252, 249, 253]
    bar = [255] * 300
    bar[20:32] = [60] * 12
    glass = [200] * 12 + [255] * 288
    df = spark.createDataFrame([(1, shadow), (2, bar), (3, glass), (4, [255, 255])], "id long, prof array<int>")
    assert [r.edge for r in detect.sheet_edge(df).orderBy("id").collect()] == [7, 0, 12, 0]


def test_sheet_on_bed(spark):
    img = np.full((170, 120), 250)
    img[:, 114:] = 215
    img[153:] = 215
    r = detect.detect_sheet(lines(spark, img)).first()
    assert abs(r.found_x1 - 114 / 120) < 0.02 and abs(r.found_y1 - 153 / 170) < 0.02 and r.found_x0 == 0


def test_document_corners(spark):
    h, w = 150, 200
    want = [(.15, .12), (.85, .18), (.9, .88), (.12, .8)]
    yy, xx = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for (ax, ay), (bx, by) in zip(want, want[1:] + want[:1]):
        inside &= (bx - ax) * w * (yy - ay * h) - (by - ay) * h * (xx - ax * w) >= 0
    r = detect.detect_document(lines(spark, np.where(inside, 230, 40))).first()
    for p, (x, y) in zip(r.doc_quad, want):
        assert abs(p.x - x) < 0.04 and abs(p.y - y) < 0.04


def test_largest_component(spark):
    """Sets of touching pixels by union of neighbours, then the largest set."""
    mask = (np.random.default_rng(2).random((40, 50)) < 0.55).astype(int)
    owner = {(int(y), int(x)): (int(y), int(x)) for y, x in np.argwhere(mask)}

    def root(p):
        while owner[p] != p:
            p = owner[p]
        return p

    for y, x in list(owner):
        for other in ((y, x + 1), (y + 1, x)):
            if other in owner:
                owner[root(other)] = root((y, x))
    groups = {}
    for p in owner:
        groups.setdefault(root(p), set()).add(p)
    best = max(groups.values(), key=len)
    out = detect.largest_component(lines(spark, mask).withColumnRenamed("px", "mask"))
    assert set(map(tuple, np.argwhere(back(out, "comp")).tolist())) == best and out.first().area == len(best)


def test_colour_planes_are_treated_alike(spark):
    """RGB scanlines come out as three grey pages would."""
    rng = np.random.default_rng(4)
    rgb = {c: rng.integers(0, 256, (20, 16)) for c in "rgb"}
    df = spark.createDataFrame([(1, 1, y, *[[int(v) for v in rgb[c][y]] for c in "rgb"]) for y in range(20)],
                               "doc_id long, page_no int, y int, r array<int>, g array<int>, b array<int>")
    quad = spark.createDataFrame([(1, 1, 16, 20, 150, 140, [(0.1, 0.0), (1.0, 0.2), (0.9, 1.0), (0.0, 0.8)])],
        "doc_id long, page_no int, src_w int, src_h int, out_w int, out_h int, quad array<struct<x: double, y: double>>")
    strokes = spark.createDataFrame([(1, 1, 0.2, [(0.2, 0.2), (0.8, 0.7)])], "doc_id long, page_no int, size double, points array<struct<x: double, y: double>>")
    sizes = spark.createDataFrame([(1, 1, 16, 20)], "doc_id long, page_no int, w int, h int")
    box = spark.createDataFrame([(1, 1, 2, 3, 5, 6, 10, 20, 30, 0)], "doc_id long, page_no int, x int, y int, w int, h int, r int, g int, b int, z int")
    warped, erased, burnt = detect.warp_perspective(df, quad), raster.burn_erase(df, strokes, sizes), raster.burn_rects(df, box)
    for c, v in zip("rgb", (10, 20, 30)):
        grey = lines(spark, rgb[c])
        assert (back(warped, c) == back(detect.warp_perspective(grey, quad))).all()
        assert (back(erased, c) == back(raster.burn_erase(grey, strokes, sizes))).all()
        want = rgb[c].copy()
        want[3:9, 2:7] = v
        assert (back(burnt, c) == want).all()


def test_map_of_a_trapezium_by_hand(spark):
    """Corners (0, 0), (4, 0), (3, 2), (1, 2) of a 5 x 3 page: the centre of the unit square goes to the diagonals' meeting."""
    quad = [(0.0, 0.0), (1.0, 0.0), (0.75, 1.0), (0.25, 1.0)]
    df = spark.createDataFrame([(5, 3, quad)], "src_w int, src_h int, quad array<struct<x: double, y: double>>")
    c = detect.quad_coefficients(df).first()
    at = lambda u, v: tuple((c[f"c{a}"] * u + c[f"c{b}"] * v + c[f"c{k}"]) / (c.cg * u + c.ch * v + 1) for a, b, k in ("abc", "def"))
    for (u, v), want in {(0, 0): (0, 0), (1, 0): (4, 0), (1, 1): (3, 2), (0, 1): (1, 2), (0.5, 0.5): (2, 4 / 3)}.items():
        assert at(u, v) == pytest.approx(want)


def test_warp_is_identity_on_the_full_page(spark):
    img = np.arange(63).reshape(7, 9)
    quad = spark.createDataFrame(
        [(1, 1, 9, 7, 9, 7, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])],
        "doc_id long, page_no int, src_w int, src_h int, out_w int, out_h int, quad array<struct<x: double, y: double>>")
    assert (back(detect.warp_perspective(lines(spark, img), quad)) == img).all()


def test_hull_of_a_square(spark):
    pts = spark.createDataFrame([(1, 1, x, y) for x in range(5) for y in range(5)], "doc_id long, page_no int, x int, y int")
    assert [(r.x, r.y) for r in detect.convex_hull(pts).orderBy("pos").collect()] == [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_erase_stroke(spark):
    df = spark.createDataFrame([(1, 1, 0.1, [(0.1, 0.5), (0.9, 0.5)])],
                               "doc_id long, page_no int, size double, points array<struct<x: double, y: double>>")
    sizes = spark.createDataFrame([(1, 1, 200, 100)], "doc_id long, page_no int, w int, h int")
    out = back(raster.burn_erase(lines(spark, np.zeros((100, 200), int)), df, sizes))
    assert out[50, 100] == 255 and out[50, 12] == 255 and out[20, 100] == 0 and out[50, 2] == 0


# -------------------------------------------------------------------- intake

@pytest.mark.parametrize("seed", [1, 2])
def test_free_names_one_by_one(spark, seed):
    """Giving names to the arrivals one at a time, each time as the only arrival, comes to the same."""
    rng = random.Random(seed)
    pool = ["a.pdf", "a_2.pdf", "a_3.pdf", "a_2_2.pdf", "b.pdf", "b_2.jpg", "c_2.pdf", "a_2_3.pdf", "a_999.pdf"]
    arrivals = [rng.choice(pool) for _ in range(7)]
    existing = rng.sample(["a.pdf", "a_4.pdf", "b_2.pdf", "a_2_2.pdf", "c_2_2.pdf"], 3)
    schema = "seq long, name string, now_ms long"
    rows = [(k, n, 10_000 + k) for k, n in enumerate(arrivals)]
    names = lambda rows, have: [r.free_name for r in intake.allocate_names(
        spark.createDataFrame(rows, schema), spark.createDataFrame([(n,) for n in have], "name string"), chunk=4).orderBy("seq").collect()]
    together, one_by_one = names(rows, existing), []
    for row in rows:
        one_by_one += names([row], existing + one_by_one)
    assert together == one_by_one and len({*together, *existing}) == len(together) + len(existing)


def test_names_run_out(spark):
    inc = spark.range(510).selectExpr("id AS seq", "'x.pdf' AS name", "id + 9000 AS now_ms")
    got = [r.free_name for r in intake.allocate_names(inc, spark.createDataFrame([], "name string")).orderBy("seq").collect()]
    assert got[497] == "x_498.pdf" and got[498] == "x_9498.pdf"


def test_names_with_one_stamp_stay_apart(spark):
    inc = spark.range(600).selectExpr("id AS seq", "'a.pdf' AS name", "77L AS now_ms")
    have = ["a_77.pdf", "a_77-3.pdf", "a_9.pdf"]
    got = [r.free_name for r in intake.allocate_names(inc, spark.createDataFrame([(n,) for n in have], "name string"), chunk=50).orderBy("seq").collect()]
    assert len(set(got)) == 600 and not set(got) & set(have) and got[496] == "a_77-2.pdf" and got[497] == "a_77-4.pdf"


def test_clean_names(spark):
    df = spark.createDataFrame([("../../etc/passwd.pdf", 5), ("ohne-endung", 5), ("Rechnung Stadtwerke.pdf", 5), ("", 5), ("Übung/ä?.PDF", 5)],
                               "name string, now_ms long")
    got = {r.name: (r.pdf_name, r.raw_name) for r in intake.safe_names(df).collect()}
    assert got["../../etc/passwd.pdf"][0] == "passwd.pdf" and got["ohne-endung"][0] == "ohne-endung.pdf"
    assert got["Rechnung Stadtwerke.pdf"][0] == "Rechnung Stadtwerke.pdf"
    assert got[""] == ("scan_5.pdf", "datei_5.pdf") and got["Übung/ä?.PDF"][0] == "_.PDF"


def test_merge_counts_pages(spark):
    sel = spark.createDataFrame([(1, 0, 10, "pdf", True), (1, 1, 11, "pdf", True), (1, 2, 12, "image", True), (2, 0, 10, "pdf", False)],
                                "merged_id long, order_no long, doc_id long, kind string, readable boolean")
    pages = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "doc_id long, page_no int")
    merged, aborted = intake.merge_documents(sel, pages)
    assert [(r.pos, r.doc_id, r.a4_sheet) for r in merged.orderBy("pos").collect()] == [(1, 10, False), (2, 10, False), (3, 11, False), (4, 12, True)]
    assert [r.merged_id for r in aborted.collect()] == [2]


# ------------------------------------------------------------------- objects

def test_edit_replay(spark):
    ops = [("rotate", 0), ("duplicate", 1), ("delete", 0), ("undo", 0), ("move_left", 2), ("insert_blank", 0), ("redo", 0), ("all_a4", 0)]
    df = spark.createDataFrame([(1, k, o, a, 2) for k, (o, a) in enumerate(ops)], "doc_id long, seq long, op string, at int, n_pages int")
    got = [(r.src, r.rotate, r.resized, r.blank_w) for r in objects.edit_replay(df).orderBy("pos").collect()]
    assert got == [(0, 90, True, None), (1, 0, True, None), (1, 0, True, None), (None, 0, False, 595.28)]


def test_stroke_path(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 5.0), (1, 3, 20.0, 0.0), (1, 4, 30.0, 8.0), (2, 1, 3.0, 4.0)],
                               "stroke_id long, seq int, x double, y double")
    rows = objects.smooth_stroke(df).orderBy("stroke_id", "i").collect()
    assert "".join(r.path for r in rows if r.stroke_id == 1).startswith("M 0 0 C 1.67 0.83 6.67 5 10 5 C ")
    assert rows[-1].path == "M 3 4 L 3.1 4"


def test_lossless_ignores_overrides(spark):
    pages = spark.createDataFrame([(1, 1)], "doc_id long, page_no int")
    ov = spark.createDataFrame([(1, 1, "extrem-sw", 5)], "doc_id long, page_no int, preset string, bias int")
    r = options.resolve_page_options(pages, ov, options.preset_table(spark), {"mode": "lossless"}).first()
    assert r.color_mode is None and not r.overridden


def test_estimate_uses_three_pages(spark):
    pages = spark.createDataFrame([(1, p, 1000) for p in range(1, 6)], "doc_id long, page_no int, orig_bytes long")
    sizes = spark.createDataFrame([(1, p, k, 100 * p) for p in range(1, 6) for k in ("mittel", "verlustfrei")],
                                  "doc_id long, page_no int, preset string, bytes long")
    got = {r.preset: (r.est_bytes, r.estimated) for r in estimate.estimate_savings(pages, sizes).collect()}
    assert got == {"mittel": (1500, True), "verlustfrei": (1500, False)}


# --------------------------------------------------------------- files, parts

def test_document_parts_form_a_file(spark, stress):
    bits = lines(spark, stress).withColumnRenamed("px", "bit")
    one = assemble.encode_bilevel(bits).drop("doc_id", "page_no")
    pages = spark.range(1, 8).selectExpr("7L AS doc_id", "CAST(id AS INT) AS page_no", "595.28D AS w_pt", "841.89D AS h_pt").crossJoin(one)
    parts = assemble.assemble_documents(pages, chunk=3).selectExpr("concat(doc_id, '.pdf') AS name", "offset", "content")
    folder = scratch_path(spark, "docs")
    done = sinks.write_parts(parts, folder).first()
    assert done.complete and os.listdir(folder) == ["7.pdf"]
    data = open(f"{folder}/7.pdf", "rb").read()
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start:start + 4] == b"xref" and len(data) == done.bytes
    count = int(data[start:].split()[2])
    table = data[start:].split(b"\n", 2)[2]
    for k in range(1, count):
        entry = table[20 * k:20 * k + 20]
        assert data[int(entry[:10]):].startswith(f"{k} 0 obj".encode()), k
    assert data.count(b"/Type /Page ") == 7 and data.count(b"/Type /Pages ") == 4


def test_handoff_last_name_wins(spark):
    df = spark.createDataFrame([(1, "a.pdf", bytearray(b"one"), 5), (2, "x/a.pdf", bytearray(b"two"), 5), (3, "b", bytearray(b""), 5)],
                               "seq long, name string, content binary, now_ms long")
    folder = scratch_path(spark, "out")
    done, refused = sinks.handoff(df, folder)
    assert [(r.name, r.bytes) for r in done.collect()] == [("a.pdf", 3)] and open(f"{folder}/a.pdf").read() == "two"
    assert os.listdir(folder) == ["a.pdf"] and [r.reason for r in refused.collect()] == ["empty"]
    assert sinks.delete_files(spark.createDataFrame([("a.pdf",), ("gone.pdf",)], "name string"), folder).count() == 2
    assert os.listdir(folder) == []


def test_folder_sources(spark, tmp_path):
    for p in ("scan-a.pdf", "notiz.txt", "Unterordner/scan-b.pdf", "1/2/3/deep.pdf", ".x.pdf"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    assert sorted(r.name for r in sources.import_folder(spark, str(tmp_path)).collect()) == ["scan-a.pdf", "scan-b.pdf"]
    assert [r.name for r in sources.raw_catalog(spark, str(tmp_path)).collect()] == ["scan-a.pdf"]
    got = jobs.drain(jobs.intake_stream(spark, str(tmp_path), settle_ms=0), "intake")
    assert {(r.name, r.reason) for r in got.collect()} == {("scan-a.pdf", None), ("notiz.txt", "unknown ending")}


def test_profile_round(spark):
    folder = scratch_path(spark, "prof")
    assert sources.profile_snapshot(spark, folder).isEmpty()
    os.makedirs(folder)
    bad = ["{oops", '"a": 1}', '{"a": 1} x', "1, 2", "1]", "1}"]
    df = spark.createDataFrame([(1, '{"a": 1}'), *[(k + 2, t) for k, t in enumerate(bad)]], "owner long, document string")
    assert [r.reason for r in sinks.profile_write(df, folder).collect()] == ["not json"] * len(bad)
    assert [r.owner for r in sources.profile_snapshot(spark, folder).collect()] == [1]
    sinks.profile_write(spark.createDataFrame([(3, "[]")], "owner long, document string"), folder)
    assert [r.owner for r in sources.profile_snapshot(spark, folder).collect()] == [3]


# ----------------------------------------------------------------- streaming

def attempts_log(seed, n=200):
    rng = random.Random(seed)
    t = dt.datetime(2024, 1, 1)
    return [(b, t + dt.timedelta(minutes=k), 1000 * b + k, rng.random() > 0.4, rng.random() < 0.02) for b in range(12) for k in range(n // 12)]


def test_collector_equals_batch_form(spark):
    rows = attempts_log(4)
    folder = scratch_path(spark, "attempts")
    schema = "batch_id long, ts timestamp, event_id long, ok boolean, cancel boolean"
    for k in range(4):
        part = [r for r in rows if r[2] % 1000 // 4 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    log = spark.createDataFrame(rows, schema).selectExpr("*", "event_id % 1000 + 1 AS seq")
    want = {(r.batch_id, r.n_pages, r.status, r.failed_page) for r in attempts.batch_summary(log, 6, chunk=4).collect()}
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    last = {}

    def keep(batch, _):
        last.update({r.batch_id: (r.batch_id, r.n_pages, r.status, r.failed_page) for r in batch.collect()})

    jobs.drain_batches(jobs.scan_batch_collector(src, 6), "collector", keep, "update")
    assert set(last.values()) == want
    assert attempts.batch_outcome(log, 6, chunk=4).count() == sum(w[1] for w in want)


def test_batch_of_three_with_one_retry(spark):
    log = spark.createDataFrame([(1, k + 1, ok, False) for k, ok in enumerate([True, False, True, True])],
                                "batch_id long, seq long, ok boolean, cancel boolean")
    r = attempts.batch_summary(log, 3).first()
    assert (r.n_pages, r.status) == (3, "finished")


def test_debounce_stream_equals_batch(spark):
    t = dt.datetime(2024, 1, 1)
    gaps = [0, 0.3, 0.5, 2, 0.1, 0.79, 0.81, 5]
    at, rows = t, []
    for k, g in enumerate(gaps):
        at += dt.timedelta(seconds=g)
        rows.append((1, ["signatures", "settings"][k % 2], float(k), at, k))
    rows.append((2, "stamps", 1.0, t + dt.timedelta(hours=1), 99))
    schema = "owner long, key string, value double, ts timestamp, seq long"
    df = spark.createDataFrame(rows, schema)
    keys = ["signatures", "stamps", "settings"]
    want = jobs.debounced_profile(df, keys).where("owner = 1").collect()
    assert [r.n_changes for r in sorted(want)] == [3, 3, 1, 1]
    # The third upload changes signatures alone and still carries the settings; stamps were never set.
    assert [(r.signatures, r.stamps, r.settings) for r in sorted(want)][2] == (6.0, None, 5.0)
    folder = scratch_path(spark, "changes")
    for part in (df.where("seq < 3 OR seq = 5"), df.where("seq IN (3, 4)"), df.where("seq > 5")):  # three files, late rows
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.debounced_profile(spark.readStream.schema(schema).parquet(folder), keys, late="1 second")
    got = jobs.carry_forward(jobs.drain(stream, "debounce"), keys).where("owner = 1").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


# --------------------------------------------------------------------- chains

def test_chains(spark):
    from pagelake.plans import chains

    g = dark_photo()
    rgb = lines(spark, g).selectExpr("doc_id", "explode(array(1, 2)) AS page_no", "y", "px AS r", "px AS g", "px AS b")
    pages = spark.createDataFrame([(1, 1, 112.0, 150.0), (1, 2, 112.0, 150.0)], "doc_id long, page_no int, w_pt double, h_pt double")
    ov = spark.createDataFrame([(1, 1, "extrem-sw", 0), (1, 2, "extrem-farbe", 0)], "doc_id long, page_no int, preset string, bias int")
    # Page 3 has neither override nor picture, page 4 a picture, page 5 an override but no scanlines.
    pages = pages.unionByName(spark.createDataFrame([(1, k, 112.0, 150.0) for k in (3, 4, 5)], pages.schema))
    ov = ov.unionByName(spark.createDataFrame([(1, 5, "extrem-sw", 0)], ov.schema))
    pictures = spark.createDataFrame([(1, 4, 8, 8, bytearray(b"picture")), (1, 1, 8, 8, bytearray(b"unused"))],
                                     "doc_id long, page_no int, w_px int, h_px int, stream binary")
    parts, left_out = chains.compress(pages, rgb, ov, {"mode": "raster", "color_mode": "color", "dpi": 150}, pictures)
    assert sorted((r.page_no, r.reason) for r in left_out.collect()) == [(3, "no picture stream"), (5, "no scanlines")]
    data = b"".join(bytes(r.content) for r in parts.orderBy("offset").collect())
    assert data.startswith(b"%PDF-1.5") and data.endswith(b"%%EOF\n") and b"/Indexed" in data and data.count(b"/DCTDecode") == 1
    at = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    head, count = data[at:].split(b"\n", 2)[:2]
    assert head == b"xref" and data.count(b"/Type /Page ") == 3 and b"unused" not in data
    table = data[at + len(head) + len(count) + 2 :]
    for k in range(1, int(count.split()[1])):
        place = int(table[20 * k : 20 * k + 10])
        assert data[place:].startswith(b"%d 0 obj" % k)

    scans = spark.createDataFrame([(1, 1, 200, 240, None, "left", "top")],
                                  "doc_id long, page_no int, px_w int, px_h int, scan_dpi int, origin_x string, origin_y string")
    # Large enough that the dark frame's own outline exceeds 98.5 % of the page.
    sheet = np.full((240, 200), 30)
    sheet[60:181, 40:161] = 220
    flat = back(chains.straighten(scans, lines(spark, sheet)))
    assert abs(flat.shape[0] - 1.2 * 120) <= 4 and abs(flat.shape[1] - 1.2 * 120) <= 4 and flat[10:-10, 10:-10].min() > 200

    files = spark.createDataFrame([("b.pdf", 2, 10, True), ("a.png", 1, 11, True), ("c.pdf", 3, 12, True)],
                                  "name string, modified_ms long, doc_id long, readable boolean")
    sel = spark.createDataFrame([("a.png",), ("b.pdf",)], "name string")
    merged, lineage = chains.take_over(files, sel, spark.createDataFrame([(10, 1), (10, 2)], "doc_id long, page_no int"), 5)
    assert [(r.pos, r.doc_id) for r in merged.orderBy("pos").collect()] == [(1, 11), (2, 10), (3, 10)]
    assert [r.name for r in lineage.orderBy("order_no").collect()] == ["a.png", "b.pdf"]


# ---------------------------------------------------------------- silent losses

def test_null_keys_are_numbered_too(spark):
    from pagelake import keys

    df = spark.createDataFrame([(1, 1), (None, 2), (None, 3), (1, None)], "k long, t long")
    got = keys.ordered_index(df, ["k"], F.floor(F.col("t") / 2), ["t"]).collect()
    assert sorted(((r.k or 0), r.t or 0, r.idx) for r in got) == [(0, 2, 1), (0, 3, 2), (1, 0, 1), (1, 1, 2)]
    total = keys.running_total(df, ["k"], F.floor(F.col("t") / 2), ["t"], "t", "before").collect()
    assert len(total) == 4 and {r.before for r in total if r.k is None} == {0, 2}
    beside = keys.with_neighbour(keys.ordered_index(df, ["k"], F.lit(0), ["t"]), ["k"], "idx", -1, ["t"], "_prev").collect()
    assert {r.t_prev for r in beside if r.k is None} == {None, 2}


def test_underscored_files_are_listed(spark, tmp_path):
    for name in ("a.pdf", "_5.pdf", ".hidden.pdf", "_x.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "_deep" / "b").mkdir(parents=True)
    (tmp_path / "_deep" / "b" / "c.PDF").write_bytes(b"x")
    assert {r.name for r in sources.raw_catalog(spark, str(tmp_path)).collect()} == {"a.pdf", "_5.pdf"}
    found = {(r.name, r.depth) for r in sources.import_folder(spark, str(tmp_path)).collect()}
    assert found == {("a.pdf", 0), ("_5.pdf", 0), ("c.PDF", 2)}


def test_last_value_of_a_field_or_page_counts(spark):
    from pagelake.operators import objects, options

    fields = spark.createDataFrame([(1, "f", "text", None)], "doc_id long, name string, type string, value string")
    values = spark.createDataFrame([(1, "f", "z", 1), (1, "f", "b", 2)], "doc_id long, name string, value string, order_no int")
    assert [r.value for r in objects.form_fill(fields, values).collect()] == ["b"]
    pages = spark.createDataFrame([(1, 1)], "doc_id long, page_no int")
    over = spark.createDataFrame([(1, 1, "stark", 0, 1), (1, 1, "extrem-sw", 4, 2)], "doc_id long, page_no int, preset string, bias int, order_no int")
    (row,) = options.resolve_page_options(pages, over, options.preset_table(spark), {"mode": "raster", "color_mode": "color", "dpi": 150}).collect()
    assert (row.color_mode, row.bias) == ("bw", 4)


def test_other_stores_are_refused():
    from pagelake.session import local_path

    assert local_path("file:///a/b") == "/a/b" and local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError):
        local_path("s3a://bucket/x")
