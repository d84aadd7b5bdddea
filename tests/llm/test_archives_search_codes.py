"""WARC archives, lexical search and vector codes against plain Python, round trips and damaged files."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from pagelake.llm import search, vector_codes, warc
from . import cases

# ---------------------------------------------------------------- archives

PAGE_SCHEMA = "page_id long, url string, html string, payload string, record_id string, _first long, type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], PAGE_SCHEMA)


def page_rows():
    body = "<p>" + cases.prose(60) + "</p>"
    return [
        (1, "http://a.example/1", body), (2, "http://a.example/2", body), (3, None, body), (7, "http://b.example/ü x\r\ny", body + "é"),
        (4, "http://c.example/", "short"), (5, "http://c.example/", "short"), (6, None, None), (8, "", ""), (None, "http://n.example/", body), (None, None, None),
        (9, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "ü" * 50), (14, "u", "ü" * 50),
        (1, "http://a.example/1", body), (15, "long", "<b>" + "z " * 800_000), (16, "nul", "\x00\r\n\r\nWARC/1.1\r\n" * 20), (None, "only", "n" * 200), (None, "only", "n" * 200),
    ]


def wanted_pages(rows):
    least = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            least[data] = min(i, least.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = least.get(data)
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archives_give_back_every_page(spark, tmp_path):
    rows = page_rows()
    got = warc.archive_pages(pages(spark, rows).repartition(3), f"file:{tmp_path}/w")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == wanted_pages(rows)
    assert warc.archive_pages(pages(spark, []).repartition(2), f"{tmp_path}/none").collect() == []


def test_records_and_positions(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}", cases.prose(200)) for i in range(120)]
    warc.write_archives(warc.mark_revisits(pages(spark, rows)).coalesce(1), str(tmp_path))
    (path,) = tmp_path.glob("*.warc.zst")
    assert sorted(p.name for p in tmp_path.iterdir()) == [path.name]  # nothing staged is left
    data = path.read_bytes()
    assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + struct.unpack("<I", data[4:8])[0]]))
    got = warc.read_archives(spark, str(tmp_path)).orderBy("position").collect()
    assert got[0].type == "warcinfo" and len(got) == 121 and all(r.error is None for r in got)
    assert sum(r.length for r in got) == len(data) - got[0].position
    for r in got[1:]:  # a record can be read from its place alone
        text = zstandard.ZstdDecompressor(dict_data=words).decompress(data[r.position : r.position + r.length])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and bytes(r.payload) in text
        assert r.headers["warc-record-id"] == r.record_id and r.http_length == len(r.payload)
    assert {(r.uri, bytes(r.payload).decode()) for r in got[1:]} == {(u, h) for _, u, h in rows}


GOOD = warc.page_record({"payload_bytes": 3, "date": None, "uri": "http://x/", "payload_digest": hashlib.sha256(b"abc").hexdigest(), "type": "response", "record_id": "<urn:a>", "payload": b"abc"})


@pytest.mark.parametrize("change, error", [
    (lambda d: d, None),
    (lambda d: d.replace(b"WARC/1.1", b"WARC/3.0"), "version"),
    (lambda d: d.replace(b"WARC-Date: ", b"WARC-When: "), "no warc-date"),
    (lambda d: d.replace(b"WARC-Date: ", b"WARC Date: "), "header line"),
    (lambda d: d.replace(b"WARC-Date: ", b"WARC-Date; "), "header line"),
    (lambda d: re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: x\r\n\r\nHTTP", d), "length"),
    (lambda d: re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 9999\r\n\r\nHTTP", d), "length"),
    (lambda d: d + d, "more than one record in a frame"),
    (lambda d: d[:-2] + b"xx", "no closing line ends"),
    (lambda d: d.replace(b"abc", b"abd"), "payload digest"),
    (lambda d: d.replace(b"text/html", b"text/htmx"), "block digest"),
    (lambda d: b"nothing", "header has no end"),
])
def test_records_are_checked(change, error):
    assert warc.parse(change(GOOD))["error"] == error


def frames_of(data, chunk):
    class Stream:
        at = 0

        def read(self, n):
            self.at, start = self.at + chunk, self.at
            return data[start : start + chunk]

    return list(warc.Frames(Stream()))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_damage_is_passed_over(chunk):
    press = zstandard.ZstdCompressor(write_checksum=True).compress
    one, two, three = (press(GOOD + bytes([i]) * 50) for i in range(3))
    plain = frames_of(one + two + three, chunk)
    assert [(p, n) for p, n, _, _ in plain] == [(0, len(one)), (len(one), len(two)), (len(one) + len(two), len(three))]
    bad = two[:20] + bytes([two[20] ^ 0xFF, two[21] ^ 0xFF]) + two[22:]
    got = frames_of(one + bad + three, chunk)
    assert got[0][3] is None and got[-1][2].endswith(b"\x02" * 50) and {g[3] for g in got[1:-1]} == {"frame cannot be decoded"}
    assert [g[3] for g in frames_of(one + two[:-9], chunk)] == [None, "frame is cut off"]
    skip = struct.pack("<II", 0x184D2A51, 5) + b"12345"
    assert [g[3] for g in frames_of(one + skip + two, chunk)] == [None, None]
    assert [g[3] for g in frames_of(struct.pack("<II", warc.DICTIONARY_MAGIC, 9) + b"no dict!!" + one, chunk)] == ["dictionary", None]
    assert [g[3] for g in frames_of(b"junk" + one, chunk)] == ["frame cannot be decoded", None]
    assert frames_of(b"", chunk) == []


def test_revisit_without_response_is_reported(spark):
    read = spark.createDataFrame([("<b>", "revisit", "u", "<a>", None, 5, "d", None)],
                                 "record_id string, type string, uri string, refers_to string, error string, http_length long, payload_digest string, payload binary")
    assert [r.error for r in warc.resolve(read).collect()] == ["no response"]


# ---------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def wanted_ranks(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms, df = len(counted), sum(n for _, _, n in counted), Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, shard_rows", [(50, 1 << 16), (3, 40)])
def test_search_equals_scoring_everything(spark, monkeypatch, k, shard_rows):
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    rng = random.Random(5)
    rows = cases.awkward_rows() + [(100 + i, cases.prose(rng.randrange(1, 90), rng), "en", "a") for i in range(400)]
    rows += [(600 + i, "same words ÄÖ ß x9", "de", "b") for i in range(70)] + [(700, "Z_z-z\x7fq\x00r", "en", "c"), (701, "　日本 語", "ja", "c")]
    items = [(1, cases.prose(30, rng)), (2, "the of and"), (3, None), (4, "  .,"), (5, "same WORDS äö"), (5, "x9 x9"), (None, "日本 語 z q r"), (6, "　日本 語 unknownterm"), (7, "the")]
    docs = cases.table(spark, rows).repartition(3)
    queries = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, term long")
    index = search.build_index(docs)
    got = search.search(index, queries, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == wanted_ranks([(r[0], r[1]) for r in rows], items, k)
    assert search.search(search.build_index(cases.empty(spark)), queries).collect() == []
    assert search.search(index, queries.where("false")).collect() == []


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rows = [(i, cases.prose(40), "en", "a") for i in range(80)]
    items = [(i, cases.prose(12)) for i in range(20)]
    got = search.search(search.build_index(cases.table(spark, rows)), spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert sorted(map(tuple, got), key=str) == wanted_ranks([(r[0], r[1]) for r in rows], items, 5)


def test_blocks_are_rejected_unread():
    """A rare term decides; of the common term's list only the blocks of candidates are decoded."""
    n = 20_000
    pads = np.full(n, 20 * 100, np.int64)

    def made(weight, docs, tf):
        heads = np.arange(0, len(docs), search.BLOCK)
        gaps = np.diff(docs, prepend=0)
        gaps[heads] = 0
        meta = np.stack([docs[heads], np.maximum.reduceat(tf, heads)], axis=1).astype("<u4")
        return search.TermList(weight, len(docs), meta.tobytes(), gaps.astype("<u2").tobytes(), tf.astype("<u1").tobytes(), pads)

    rare = made(9000, np.arange(40, 12_000, 200), np.ones(60, np.int64))
    common = made(90, np.arange(n), 1 + np.arange(n) % 3)
    found, score = search.best([common, rare], n, np.arange(n), 10)
    want = np.zeros(n, np.int64)
    for one in (rare, common):
        docs, parts = one.decode(np.arange(one.n))
        want[docs] += parts
    order = np.lexsort([np.arange(n), -want])[:10]
    assert found.tolist() == order.tolist() and score.tolist() == want[order].tolist()
    common.decoded = 0
    search.best([common, rare], n, np.arange(n), 10)
    assert 0 < common.decoded <= 60 < common.n


# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, row long, part string, position int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)


def wanted_codes(rows, parts=4, entries=256, rounds=4):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    book = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        where = [[nearest(p, x[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for e in range(len(book[p])):
                own = [x[p] for x, w in zip(cut, where) if w[p] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = Counter()
    for r, e in zip(rows, error):
        total[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), e, total[r[2]], sha) for r, f, e in zip(rows, found, error)), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vector_rows(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(width)], rng.choice([0, 1, 2, None])) for i in rng.sample(range(10 * n), n)]
    return rows + [(None, [0.5] * width, 1), (7, None, 1), (8, [float("nan")] * width, 1), (9, [None] * width, 0), (10, [float("inf")] + [0.0] * (width - 1), 0),
                   *[(20_000 + i, [0.25] * width, 3) for i in range(n // 2)], (5, [0.1] * width, 2), (5, [-0.1] * width, 2), (5, [0.1] * width, 2)]


@pytest.mark.parametrize("n, width, entries", [(300, 8, 16), (40, 4, 256), (120, 12, 5)])
def test_codes_equal_plain_lloyd(spark, n, width, entries):
    rows = vector_rows(n, width, n)
    assert shown(vector_codes.compress(vectors(spark, rows).repartition(3), entries=entries)) == wanted_codes(rows, entries=entries)


def test_codes_of_large_components_and_odd_lengths(spark):
    rows = [(i, [float(2 ** (i % 18)), -3.0 * i, 1e5 / (i + 1), -(2.0**17)], i % 2) for i in range(60)]
    want = wanted_codes(rows, entries=9)
    odd = [(500, [1.0, 2.0], 0), (501, [], 1)]
    got = shown(vector_codes.compress(vectors(spark, rows + odd), entries=9))
    assert [r for r in got if r[1]] == want and sorted(r[0] for r in got if not r[1]) == [500, 501]
    assert all(r[2:] == (None, None, None) for r in got if not r[1])
    assert shown(vector_codes.compress(vectors(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1), (2, [0.0] * 4, 1)])))[0][1] == "00000000"
    assert shown(vector_codes.compress(vectors(spark, []))) == []
    assert shown(vector_codes.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 0)]))) == [(1, None, None, None, None)]


def test_only_changed_parts_move(spark):
    """Members are found without an exchange, and a round appends two rows per change."""
    rows = [(r[0], r[1], r[2]) for r in vector_rows(400, 8, 3) if r[0] is not None]
    whole = vector_codes.integers(vectors(spark, rows)).withColumn("row", F.monotonically_increasing_id())
    whole = whole.withColumn("v", F.expr("transform(v, x -> int(x))"))
    book = vector_codes.first_book(whole, 4, 16)
    cut = F.posexplode(F.array(*[F.slice("v", 2 * p + 1, 2) for p in range(4)])).alias("position", "part")
    start = vector_codes._assigned(whole.select("row", cut), book, "row")
    with vector_codes.Residents(spark, 2, 4) as home:
        home.add(start.select("row", "position", *vector_codes._owned(F.col("new"), 4), F.lit(0).alias("round"), F.lit(True).alias("arrives"), "part"))
        plan = home.members().groupBy("position", "entry", "salt").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        n = 4 * whole.count()
        sizes = [spark.table(home.name).count()]
        for turn in (1, 2, 3):
            book = home.updated(book)
            changed = vector_codes._assigned(home.members(), book, "row", "entry", "round").where("new != entry")
            moved = changed.count()
            home.add(vector_codes._moves(changed, turn, 4))
            sizes.append(spark.table(home.name).count())
            assert home.members().count() == n and sizes[-1] - sizes[-2] == 2 * moved < n
        assert sizes[0] == n
    assert not spark.catalog.tableExists(home.name)
