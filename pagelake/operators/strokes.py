"""Pen strokes thinned by distance, however long a stroke is.

A point is kept when it is far enough from the last kept one. What follows a kept point
depends on that point alone: the first later one at that distance. So every point has one successor, and what
is kept is the way from a stroke's first point along the successors. A stroke is cut into chunks; in
each, points with a successor in the chunk lead to one without, an *exit*. Exits find their successors
in later chunks, which gives a map from exits to exits; the way through it is found by doubling: after k rounds
steps of length 2^k are known. Then each chunk that the way enters is walked from where it enters. No task
holds more than a chunk, and a stroke of n chunks takes about log2(n) rounds. Strokes of one chunk take none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage

CHUNK = 4096
_POINT = "stroke_id {0}, seq int, x double, y double"


def successors(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """For each point the first later one at a distance of ``least`` or more; -1 where there is none."""
    n = len(x)
    out, open_, step = np.full(n, -1), np.arange(n), 1
    while len(open_ := open_[open_ + step < n]):
        far = np.sqrt((x[open_ + step] - x[open_]) ** 2 + (y[open_ + step] - y[open_]) ** 2) >= least
        out[open_[far]] = open_[far] + step
        open_, step = open_[~far], step + 1
    return out


def exits(follow: np.ndarray) -> np.ndarray:
    """The point without successor that each one leads to."""
    out = np.arange(len(follow))
    for i in range(len(follow) - 1, -1, -1):
        if follow[i] >= 0:
            out[i] = out[follow[i]]
    return out


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    group = group.sort_by("seq")
    return (*(group[c].to_numpy() for c in ("seq", "x", "y")), group)


def _leaving(least: float):
    """Exits of a chunk; ``head`` marks the one that its first point leads to."""
    def run(group: pa.Table) -> pa.Table:
        seq, x, y, group = _columns(group)
        follow = successors(x, y, least)
        at = np.flatnonzero(follow < 0)
        return group.select(["stroke_id", "chunk", "seq", "x", "y"]).take(pa.array(at)).append_column("head", pa.array(at == exits(follow)[0]))

    return run


def _entering(least: float):
    """For exits of earlier chunks: where they enter this chunk, and the exit they reach; those that pass it by have neither."""
    def run(group: pa.Table) -> pa.Table:
        late = group.filter(pc.is_valid(group["from_seq"]))
        seq, x, y, _ = _columns(group.filter(pc.is_null(group["from_seq"])))
        leads = exits(successors(x, y, least))
        enter, reach = [], []
        for ox, oy in zip(late["x"].to_numpy(), late["y"].to_numpy()):
            far = np.sqrt((x - ox) ** 2 + (y - oy) ** 2) >= least
            first = int(np.argmax(far)) if far.any() else None
            enter.append(None if first is None else int(seq[first]))
            reach.append(None if first is None else int(seq[leads[first]]))
        return pa.table({"stroke_id": late["stroke_id"], "from_seq": late["from_seq"], "x": late["x"], "y": late["y"], "chunk": late["chunk"],
                         "enter": pa.array(enter, pa.int32()), "reach": pa.array(reach, pa.int32())})

    return run


def _walk(least: float):
    def run(group: pa.Table) -> pa.Table:
        seq, x, y, group = _columns(group)
        follow, at, kept = successors(x, y, least), int(np.searchsorted(seq, group["enter"][0].as_py())), []
        while at >= 0:
            kept.append(at)
            at = follow[at]
        return group.select(["stroke_id", "seq", "x", "y"]).take(pa.array(kept))

    return run


def _by_doubling(links: DataFrame, start: DataFrame) -> DataFrame:
    """All (stroke_id, seq) that ``start`` reaches over links (stroke_id, seq, reach)."""
    seen, steps = start, links
    while not steps.isEmpty():
        more = seen.join(steps, ["stroke_id", "seq"]).select("stroke_id", F.col("reach").alias("seq"))
        seen = cut_lineage(seen.unionByName(more).distinct(), "reached")
        twice = steps.select("stroke_id", F.col("seq").alias("_from"), F.col("reach").alias("seq")).join(steps, ["stroke_id", "seq"])
        steps = cut_lineage(twice.select("stroke_id", F.col("_from").alias("seq"), "reach"), "steps")
    return seen


def _next_in_reach(waiting: DataFrame, spans: DataFrame, least: float) -> DataFrame:
    """Few pass the next chunk by; they go on to the first later one whose farthest corner is far enough."""
    boxes = spans.select("stroke_id", F.col("chunk").alias("_to"), "x0", "x1", "y0", "y1")
    far = "greatest(abs(x - x0), abs(x - x1)) * greatest(abs(x - x0), abs(x - x1)) + greatest(abs(y - y0), abs(y - y1)) * greatest(abs(y - y0), abs(y - y1))"
    reach = waiting.join(boxes, "stroke_id").where(f"_to > chunk AND {far} >= {least * least * (1 - 1e-9)}D")
    return reach.groupBy("stroke_id", "from_seq", "x", "y").agg(F.min("_to").alias("chunk"))


def _entries(points: DataFrame, spans: DataFrame, least: float, kind: str) -> DataFrame:
    """Where the way of kept points enters each chunk of strokes of several chunks: (stroke_id, chunk, enter)."""
    long = cut_lineage(points.join(spans.where("n_chunks > 1").select("stroke_id").distinct(), "stroke_id", "left_semi"), "long_strokes")
    by = ["stroke_id", "chunk"]
    leaving = cut_lineage(long.groupBy(*by).applyInArrow(_leaving(least), f"stroke_id {kind}, chunk long, seq int, x double, y double, head boolean"), "exits")
    waiting = leaving.select("stroke_id", F.col("seq").alias("from_seq"), "x", "y", "chunk")
    ahead = spans.where("after IS NOT NULL").select(*by, "after")
    aim, found = waiting.join(ahead, by).withColumn("chunk", F.col("after")).drop("after"), []
    while True:
        waiting = cut_lineage(aim, "waiting")
        if waiting.isEmpty():
            break
        own = long.join(waiting.select(*by).distinct(), by, "left_semi")
        met = cut_lineage(own.unionByName(waiting, allowMissingColumns=True).groupBy(*by).applyInArrow(
            _entering(least), f"stroke_id {kind}, from_seq int, x double, y double, chunk long, enter int, reach int"), "entered")
        found.append(met.where("enter IS NOT NULL"))
        aim = _next_in_reach(met.where("enter IS NULL").select("stroke_id", "from_seq", "x", "y", "chunk"), spans, least)
    first = leaving.where("head").join(spans.where("number = 1").select(*by), by, "left_semi").select("stroke_id", "seq")
    if not found:
        return spans.where("n_chunks > 1 AND number = 1").select(*by, F.col("first").alias("enter"))
    links = reduce(DataFrame.unionByName, found)
    way = _by_doubling(links.select("stroke_id", F.col("from_seq").alias("seq"), "reach"), first)
    later = links.join(way.withColumnRenamed("seq", "from_seq"), ["stroke_id", "from_seq"], "left_semi").select(*by, "enter")
    return later.unionByName(spans.where("n_chunks > 1 AND number = 1").select(*by, F.col("first").alias("enter")))


def simplify_stroke(points: DataFrame, least: float = 1.2, chunk: int = CHUNK) -> DataFrame:
    """Keep a point when it is far enough from the last kept one; the last point always stays.

    ``points``: stroke_id, seq, x, y; seq is unique in a stroke. Chunks are cut by seq.
    """
    kind = dict(points.dtypes)["stroke_id"]
    cut = points.select("stroke_id", F.col("seq").cast("int").alias("seq"), "x", "y", F.floor(F.col("seq") / chunk).alias("chunk"))
    whole = W.partitionBy("stroke_id")
    spans = cut_lineage(
        cut.groupBy("stroke_id", "chunk").agg(F.min("seq").alias("first"), F.max(F.struct("seq", "x", "y")).alias("last"),
                                              *[f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))])
        .withColumns({"n_chunks": F.count(F.lit(1)).over(whole), "number": F.row_number().over(whole.orderBy("chunk")), "after": F.lead("chunk").over(whole.orderBy("chunk"))}), "spans")
    enter = spans.where("n_chunks = 1").select("stroke_id", "chunk", F.col("first").alias("enter"))
    if not spans.where("n_chunks > 1").isEmpty():
        enter = enter.unionByName(_entries(cut, spans, least, kind))
    kept = cut.join(enter, ["stroke_id", "chunk"]).groupBy("stroke_id", "chunk").applyInArrow(_walk(least), _POINT.format(kind))
    last = spans.where("number = n_chunks").select("stroke_id", "last.*")
    return kept.unionByName(last).dropDuplicates(["stroke_id", "seq"])
