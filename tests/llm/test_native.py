"""Sharding, mixing and URL filters against plain Python; no Python runs in their plans."""

import datetime as dt
import random
from collections import defaultdict
from fractions import Fraction
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pagelake.llm import mixing, sharding, url_filter
from . import cases


def test_ring_places_rows_clockwise(spark):
    rows = cases.awkward_rows() + [(1000 + i, f"text {i}", "en", "a") for i in range(200)]
    docs = cases.table(spark, rows)
    got = sharding.shard(docs, shards=5, virtual_nodes=8, cells=64).collect()
    owner = {r.cell: r.owner for r in sharding.ring(spark, 5, 8, 64).collect()}
    text = F.coalesce("text", F.lit("")).cast("binary")
    placed = docs.select("doc_id", F.crc32(text).alias("crc"), "text").withColumn("h", F.xxhash64(F.lit(4), "doc_id", "crc")).collect()
    n, fill, want = len(placed), [0] * 5, defaultdict(list)
    room = [n // 5 + (s < n % 5) for s in range(5)]
    for r in sorted(placed, key=lambda r: (r.h % 2**64, r.doc_id is not None, r.doc_id, r.crc)):
        cell = r.h % 2**64 >> 58
        while fill[owner[cell % 64]] >= room[owner[cell % 64]]:
            cell += 1
        s = owner[cell % 64]
        data = (r.text or "").encode()
        want[r.doc_id].append((s, fill[s], len(data) + 1, crc32(data)))
        fill[s] += 1
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.shard, r.slot, r.size, r.text_crc32))
        assert r.law == "rows" and r.grown_shard is None
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_ring_moves_little(spark):
    docs = cases.table(spark, [(i, str(i), "en", "a") for i in range(3000)], extra=False)
    a = {r.doc_id: r.shard for r in sharding.shard(docs, shards=8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(docs, shards=9).collect()}
    assert sum(a[i] != b[i] for i in a) < 1500  # dealing by a new modulus would move about 2667
    assert sharding.shard(cases.empty(spark)).collect() == []


def wanted_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            break
        target |= {s: Fraction(3 * sizes[s]) for s in over}
        free -= over
        rest = sum(sizes.values()) - sum(target.values())
    return target | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_meets_targets(spark, block):
    rows = cases.awkward_rows() + [(100 + i, cases.prose(5 + i % 40), "en", "xyzuv"[i % 5]) for i in range(60)] + [(500, "tiny", "en", "w")]
    got = mixing.mix(cases.table(spark, rows), block).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    target = wanted_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(target[r.source]))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").encode().split())) for i, t, *_ in rows)
    assert all(abs(taken[s] - float(t)) <= 1 for s, t in target.items())
    again = mixing.mix(cases.table(spark, rows), block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_spreads_sources(spark):
    goals = mixing.targets(spark.createDataFrame([("a", 6000), ("b", 6000), ("c", 6000)], "source string, source_size long"))
    slots = mixing.schedule(goals, 10).orderBy("t", "rank").collect()
    quota = {r.source_no: r.quota for r in goals.collect()}
    assert all(sum(r.take for r in slots if r.source_no == s) == q for s, q in quota.items())
    seen = defaultdict(int)
    for i, r in enumerate(slots, 1):
        seen[r.source_no] += 1
        assert all(abs(seen[s] - i * q / 18000) < 6 for s, q in quota.items())


def test_mix_of_nothing(spark):
    assert mixing.mix(cases.empty(spark)).collect() == []
    blank = cases.table(spark, [(1, None, "en", "a"), (2, " ", "en", None)])
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]


def plain_verdicts(captures, changes):
    history = defaultdict(dict)
    for name, pattern, action, at in changes:
        if None not in (name, pattern, action, at) and action in ("add", "remove"):
            key = history[name, pattern]
            key[at] = max(action, key.get(at, ""))
    out = []
    for page, url, at in captures:
        host, path = "", ""
        if url and "://" in url:
            host, _, path = url.split("://", 1)[1].partition("/")
            host = host.split("?")[0].split("#")[0].rpartition("@")[2].split(":")[0].lower().rstrip(".")
            path = path.split("?")[0].split("#")[0]
        labels, keys = host.split("."), set()
        if host:
            keys = {host} | {".".join(labels[i:]) for i in range(len(labels) - 1)}
            segments = [s for s in path.split("/") if s]
            keys |= {"/".join([host, *segments[: i + 1]]) for i in range(len(segments))}
        held = []
        for (name, pattern), times in history.items():
            past = [t for t in times if at is not None and t <= at]
            if pattern in keys and past and times[max(past)] == "add":
                held.append(name)
        out.append((str(page), len(held), ",".join(sorted(set(held)))))
    return sorted(out)


def test_url_filter(spark):
    rng, day = random.Random(2), dt.datetime(2024, 3, 1)
    when = lambda: day + dt.timedelta(minutes=rng.choice([0, 30, 59, 60, 61, 1440, rng.randrange(5000)]))
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "localhost"]
    urls = [f"{s}://{u}{h}{p}" for s in ("http", "HTTPS") for u in ("", "me@", "me:pw@") for h in (*hosts, "A.EXAMPLE.com:80", "x.org.")
            for p in ("", "/", "/p/q?x=1", "//p#f", "?q")] + [None, "", "no address", "http://"]
    captures = [(i, rng.choice(urls), when() if i % 9 else None) for i in range(400)] + [(1, "http://x.org/", day)] * 2
    patterns = [*hosts, "a.example.com/p", "x.org/p/q", "com", None]
    changes = [(rng.choice(["s", "t", None]), rng.choice(patterns), rng.choice(["add", "remove", "other"]), when()) for _ in range(300)]
    changes += changes[:20]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumns({x: F.lit(1) for x in ("host", "list", "at")})
    h = spark.createDataFrame(changes, "list string, pattern string, action string, at timestamp")
    got = url_filter.judge(c, h).collect()
    assert sorted((str(r.page_id), r.n_active, r.lists) for r in got) == plain_verdicts(captures, changes)
    assert all(r.blocked == (r.n_active > 0) for r in got) and any(r.blocked for r in got)
    assert url_filter.judge(c.limit(0), h).collect() == []
    assert not any(r.blocked for r in url_filter.judge(c, h.limit(0)).collect())


@pytest.mark.parametrize("make", [sharding.shard, mixing.mix])
def test_plans_stay_native(spark, make):
    plan = make(cases.table(spark).select("doc_id", "text", "lang", "source", "n_chars"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
