"""Target-size rasters and searchable documents against plain Python."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.operators import assemble, bilevel, resample, textlayer
from pagelake.plans import chains

from .test_goldens import decode_t6


def area_mean(img, th, tw):
    """Every target pixel by its covered source area, in whole numbers."""
    h, w = img.shape
    out = np.zeros((th, tw), int)
    for ty in range(th):
        for tx in range(tw):
            total = 0
            for y in range(ty * h // th, -(-(ty + 1) * h // th)):
                for x in range(tx * w // tw, -(-(tx + 1) * w // tw)):
                    oy = min((y + 1) * th, (ty + 1) * h) - max(y * th, ty * h)
                    ox = min((x + 1) * tw, (tx + 1) * w) - max(x * tw, tx * w)
                    total += int(img[y, x]) * oy * ox
            out[ty, tx] = (2 * total + w * h) // (2 * w * h)
    return out


def rows_of(pages):
    return [(doc, page, y, h, tw, th, [int(v) for v in row], [int(v) // 2 for v in row])
            for (doc, page, img, th, tw) in pages for h in [len(img)] for y, row in enumerate(img)]


SIZED = "doc_id long, page_no int, y int, h int, w_px int, h_px int, px array<int>, other array<int>"


def test_resampling_equals_area_means(spark):
    rng = np.random.default_rng(4)
    pages = [(1, 1, rng.integers(0, 256, (9, 7)), 4, 3), (1, 2, rng.integers(0, 256, (9, 7)), 4, 3), (2, 1, rng.integers(0, 256, (5, 6)), 11, 13),
             (3, 1, rng.integers(0, 256, (40, 30)), 40, 30), (None, 1, rng.integers(0, 256, (6, 5)), 1, 1), (4, 1, rng.integers(0, 256, (1, 1)), 3, 2),
             (5, 1, rng.integers(0, 256, (301, 17)), 100, 16)]
    df = spark.createDataFrame(rows_of(pages), SIZED).repartition(5)
    got = {}
    for r in resample.resample(df, ("px", "other"), ("h",)).collect():
        got.setdefault((r.doc_id, r.page_no), {})[r.y] = (r.px, r.other, r.h)
    assert len(got) == len(pages)
    for doc, page, img, th, tw in pages:
        lines = got[doc, page]
        assert sorted(lines) == list(range(th)) and {v[2] for v in lines.values()} == {len(img)}
        assert np.array_equal([lines[y][0] for y in range(th)], area_mean(img, th, tw))
        assert np.array_equal([lines[y][1] for y in range(th)], area_mean(img // 2, th, tw))


def test_resampling_gaps_and_nothing(spark):
    img = np.arange(24).reshape(6, 4) * 9
    rows = [r for r in rows_of([(1, 1, img, 2, 2)]) if r[2] not in (1, 2)] + [(2, 1, 0, 1, 3, 3, [], []), (3, 1, 0, 1, None, 3, [1], [1]), (4, 1, 0, 1, 1, 1, None, None)]
    got = resample.resample(spark.createDataFrame(rows, SIZED)).orderBy("y").collect()
    assert [(r.doc_id, r.px) for r in got] == [(1, area_mean(img[:1], 1, 2)[0].tolist()), (1, area_mean(img[3:], 1, 2)[0].tolist())]
    assert resample.resample(spark.createDataFrame([], SIZED)).collect() == []


def test_only_narrowed_lines_are_exchanged(spark):
    df = spark.createDataFrame(rows_of([(1, 1, np.zeros((4, 4)), 2, 2)]), SIZED)
    plan = resample.resample(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.rindex("MapInArrow")


# ------------------------------------------------------------- word layer

def objects_of(data):
    """Objects by number, found through the index at the end of the file."""
    at = int(data[data.rindex(b"startxref") + 9 :].split()[0])
    head, count = data[at:].split(b"\n", 2)[:2]
    assert head == b"xref"
    n, table = int(count.split()[1]), data[at + len(head) + len(count) + 2 :]
    out = {}
    for k in range(1, n):
        place = int(table[20 * k : 20 * k + 10])
        assert data[place:].startswith(b"%d 0 obj\n" % k)
        out[k] = data[place : data.index(b"\nendobj", place)]
    assert b"/Size %d " % n in data[at:]
    return out


def texts_of(objects):
    """Words of each page in page order, with their fonts resolved."""
    def kids(k):
        for ref in re.search(rb"/Kids \[(.*?)\]", objects[k])[1].split(b" 0 R"):
            if ref.strip():
                child = int(ref)
                yield from kids(child) if b"/Type /Pages" in objects[child] else [child]

    root = int(re.search(rb"/Pages (\d+)", objects[1])[1])
    for page in kids(root):
        body = objects[int(re.search(rb"/Contents (\d+)", objects[page])[1])]
        stated = int(re.search(rb"/Length (\d+)", body)[1])
        content = body[body.index(b"stream\n") + 7 : body.rindex(b"\nendstream")]
        assert len(content) == stated
        if b"Tj" in content:
            font = objects[int(re.search(rb"/Font << /F0 (\d+)", objects[page])[1])]
            assert b"/BaseFont /Helvetica" in font and b"BT 3 Tr" in content
        yield [(bytes.fromhex(t.decode()).decode("cp1252"), float(s), float(x), float(y))
               for s, x, y, t in re.findall(rb"/F0 (\S+) Tf 1 0 0 1 (\S+) (\S+) Tm <([0-9A-F]*)> Tj", content)]


@pytest.mark.parametrize("chunk", [2, 3, 512])
def test_words_stand_in_the_document(spark, chunk):
    encoded = spark.createDataFrame([(7, p, 200.0, 300.0, 8, 8, "g4", bytearray(b"stream %d" % p), None) for p in (1, 2, 4, 5, 9)] + [(8, 3, 10.0, 10.0, 8, 8, "g4", bytearray(b"x"), None)],
                                    "doc_id long, page_no int, w_pt double, h_pt double, w_px int, h_px int, codec string, stream binary, palette string")
    words = spark.createDataFrame([(7, 1, 0, "Hällo", 1.5, 290.0, 12.0), (7, 1, 1, "(wörld)", 40.0, 290.0, 12.0), (7, 4, 5, "zweite", 1.0, 2.0, 2.0), (7, 4, 3, "€“x”", 0.004, 2.0, 72.0),
                                   (7, 9, 0, "end", 1.0, 1.0, 9.0), (7, 3, 0, "no such page", 1.0, 1.0, 9.0)], "doc_id long, page_no int, idx int, text string, x double, y double, size double")
    for layer in (words, None):
        parts = assemble.assemble_documents(encoded, layer, chunk).orderBy("doc_id", "offset").collect()
        for doc in (7, 8):
            own = [p for p in parts if p.doc_id == doc]
            for a, b in zip(own, own[1:]):
                assert a.offset + len(a.content) == b.offset
            pages = list(texts_of(objects_of(b"".join(bytes(p.content) for p in own))))
            if doc == 8 or layer is None:
                assert pages == [[]] * (1 if doc == 8 else 5)
            else:
                assert pages == [[("Hällo", 12, 1.5, 290), ("(wörld)", 12, 40, 290)], [], [("€“x”", 72, 0, 2), ("zweite", 2, 1, 2)], [], [("end", 9, 1, 1)]]


def test_compress_brings_pages_to_size_and_keeps_words(spark):
    rng = np.random.default_rng(3)
    grey = np.where(rng.random((120, 90)) < 0.02, 20, 235)
    grey[40:60, 20:60] = 10
    lines = spark.createDataFrame([(1, p, y, [int(v) for v in row]) for p in (1, 3) for y, row in enumerate(grey)], "doc_id long, page_no int, y int, r array<int>")
    lines = lines.selectExpr("doc_id", "page_no", "y", "r", "r AS g", "r AS b")
    pages = spark.createDataFrame([(1, 1, 12.0, 16.0), (1, 3, 12.0, 16.0)], "doc_id long, page_no int, w_pt double, h_pt double")
    ov = spark.createDataFrame([(1, 1, "extrem-sw", 0), (1, 3, "extrem-farbe", 0)], "doc_id long, page_no int, preset string, bias int")
    words = spark.createDataFrame([(1, 3, 0, " Rechnung ", 10.0, 10.0, 60.0, 25.0), (1, 3, 1, "日本", 0.0, 0.0, 5.0, 5.0)],
                                  "doc_id long, page_no int, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    parts, left_out = chains.compress(pages, lines, ov, {"mode": "raster", "color_mode": "color", "dpi": 150}, None, words)
    assert left_out.count() == 0
    objects = objects_of(b"".join(bytes(r.content) for r in parts.orderBy("offset").collect()))
    sizes = sorted(tuple(map(int, re.search(rb"/Width (\d+) /Height (\d+)", o).groups())) for o in objects.values() if b"/Subtype /Image" in o)
    assert sizes == [(25, 33), (50, 67)]  # 150 dpi in colours, 300 dpi in black and white
    first, second = texts_of(objects)
    assert first == [] and second == [("Rechnung", 4.5, 3.0, pytest.approx(16 - 25 * 72 / 240, abs=0.006))]
    (image,) = [o for o in objects.values() if b"/Width 50 " in o]
    data = image[image.index(b"stream\n") + 7 : image.rindex(b"\nendstream")]
    bits = decode_t6(data, 50, 67) if b"/CCITTFaxDecode" in image else np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).reshape(67, 56)[:, :50]
    want = area_mean(grey, 67, 50)
    inner = bits[25:31, 14:31]
    assert inner.min() == inner.max() and want[25:31, 14:31].max() < 60


def test_pages_are_coded_once(spark):
    rng = np.random.default_rng(6)
    bits = spark.createDataFrame([(1, p, y, rng.integers(0, 2, 5 + 4 * p).tolist()) for p in (1, 2, 3) for y in range(4)], "doc_id long, page_no int, y int, bit array<int>")
    for r in bilevel.pack_bits(bilevel.changing_elements(bits)).collect():
        assert bytes(r.packed) == np.packbits(np.array(r.bit) == 0).tobytes()
        assert r.changes == [x for x, v in enumerate(r.bit) if v != ([0] + r.bit)[x]]
    pages = assemble.encode_bilevel(bits).selectExpr("*", "100D AS w_pt", "100D AS h_pt")
    parts = assemble.assemble_documents(pages)
    assert "EvalPython" not in parts._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.offset, bytes(r.content)) for r in parts.collect())
    assert all(a + len(c) == b for (a, c), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0
