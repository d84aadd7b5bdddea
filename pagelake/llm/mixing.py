"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot t of the schedule takes the golden-ratio point frac(t * 0.618...) and maps it
through the cumulative target shares to a source; the slot's rank among its
source's slots picks the block of that source. Blocks are cut, all of the same
number of words, from the source's documents in a fixed random order, read round
and round up to three times. A source's last block is cut to its exact target,
and a source that the points have given too few slots takes the missing ones at
the end of the schedule, too many are left out: discrepancy moves slots in time,
never a total. As a block ends in words, at most one document of a source is
taken in part.

Targets: weights 1, 2, 3, repeating over the sources by code point, null last,
share the words of all documents; no target exceeds three times its source, the
excess goes to the others by weight. This is the share ``w * level`` with one
level for all, found from running sums over the sources sorted by size / weight.

A source may hold most rows: order, positions and ranks come from cells and
blocks, so its rows spread over tasks. One row per source is all that is ever
gathered by a window over the sources. Everything is DataFrame functions.

Defined results: null text has size 0, takes nothing; a null source is a source of
its own, distinct from any text. Repeated rows are separate documents. A table
without words has zero targets. Null doc_ids are ordered like ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagelake.session import cut_lineage
from .ranks import before_in_order, cell_of, unsigned
from .words import WORD

BLOCK_WORDS, PASSES = 256, 3
#: Golden-ratio points in integers: (t * GOLDEN mod PERIOD) / PERIOD.
PERIOD, GOLDEN = 2147483647, 1327217885
GRID, SLOT_CHUNK = 1 << 12, 1 << 14
_SEED = 5


def row_hash(doc_id: Column, text: Column) -> Column:
    """Random order of a source's documents, the same in every run."""
    return F.xxhash64(F.lit(_SEED), doc_id, text)


def targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """source, source_no, source_size, target (double) and quota (whole words) of (source, source_size)."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn(
        "source_no", F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    ).withColumn("weight", ((F.col("source_no") - 1) % 3 + 1).cast("double")).withColumn("limit", F.col("source_size") * passes)
    # Filled in this order, each source stops the rising level at its limit; the first that the level passes by sets it.
    order = W.orderBy(F.col("limit") / F.col("weight"), "source_no")
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "stopped", F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))).withColumn(
        "level", (F.col("total") - F.col("stopped")) / F.col("rest")
    ).withColumn("holds", F.col("level") * F.col("weight") <= F.col("limit"))
    level = F.min(F.when(F.col("holds"), F.struct(F.col("stopped"), F.col("level")))).over(everything)["level"]
    share = F.least(level * F.col("weight"), F.col("limit").cast("double"))
    return ranked.withColumn("target", F.coalesce(share, F.lit(0.0))).select(
        "source", "source_no", "source_size", "target", F.least(F.round("target").cast("long"), "limit").alias("quota")
    )


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """source_no, rank from 0, t (place in the schedule) and take (words) for every slot."""
    spark = goals.sparkSession
    wanted = goals.where("quota > 0").withColumn("slots", F.ceil(F.col("quota") / block))
    before = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    wanted = wanted.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn(
        "all", F.sum("slots").over(everything)
    )
    wanted = cut_lineage(wanted, "goals")
    # Point u falls to the source whose part of the slots, laid end to end, holds u.
    cut = wanted.select(
        "source_no", (F.col("first") / F.col("all")).alias("low"), ((F.col("first") + F.col("slots")) / F.col("all")).alias("high")
    ).withColumn("grid", F.explode(F.expr(f"sequence(CAST(floor(low * {GRID}) AS INT), least(CAST(floor(high * {GRID}) AS INT), {GRID - 1}))")))
    count = wanted.agg(F.coalesce(F.max("all"), F.lit(0))).first()[0]
    points = spark.range(count).select(
        F.col("id").alias("t"), (((F.col("id") % PERIOD) * GOLDEN % PERIOD) / PERIOD).alias("u")
    ).withColumn("grid", F.floor(F.col("u") * GRID).cast("int"))
    drawn = points.join(cut, "grid").where("u >= low AND u < high").select("source_no", "t")
    drawn = drawn.withColumn("chunk", F.floor(F.col("t") / SLOT_CHUNK))
    drawn = before_in_order(drawn, ["source_no"], "chunk", ["t"], F.lit(1), "rank")
    given = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("given"))
    missing = wanted.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where(
        "given < slots"
    ).select("source_no", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"), F.lit(count).alias("t"))
    slots = drawn.select("source_no", "rank", "t").unionByName(missing)
    return slots.join(wanted.select("source_no", "quota", "slots"), "source_no").where("rank < slots").select(
        "source_no", "rank", "t", F.least(F.lit(block), F.col("quota") - F.col("rank") * block).alias("take")
    )


def pieces(placed: DataFrame, block: int, passes: int) -> DataFrame:
    """The part of each document in each block of its source's stream, as far as the quota reaches.

    source_no, rank (the block), start (the document), and from, to: words inside the block.
    """
    rounds = placed.where("size > 0").withColumn("pass", F.explode(F.expr(f"sequence(0L, {passes - 1}L)"))).withColumn(
        "a", F.col("start") + F.col("pass") * F.col("source_size")
    ).where("a < quota").withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota")))
    blocks = rounds.select("source_no", "start", "a", "b", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")).alias("rank"))
    return blocks.select(
        "source_no", "rank", "start", F.greatest(F.col("a") - F.col("rank") * block, F.lit(0)).alias("from"),
        F.least(F.col("b") - F.col("rank") * block, F.lit(block)).alias("to"),
    )


def mix(docs: DataFrame, block: int = BLOCK_WORDS, passes: int = PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and h (hash of id and text) of every row.

    ``taken`` counts the words of the document in the blocks that the schedule takes.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select("doc_id", "source", size.alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    own = cut_lineage(own.withColumn("cell", cell_of(F.col("h"))), "sized")
    goals = cut_lineage(targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), passes), "targets")
    named = goals.withColumnRenamed("source", "name")
    numbered = own.join(named, own["source"].eqNullSafe(named["name"])).drop("name")
    # A document with words is known by where it starts in its source's stream.
    placed = before_in_order(numbered, ["source_no"], "cell", [unsigned(F.col("h")), "doc_id", "size"], F.col("size"), "start")
    placed = cut_lineage(placed, "placed")
    used = pieces(placed, block, passes).join(schedule(goals, block), ["source_no", "rank"])
    taken = used.withColumn("words", F.least("to", "take") - F.col("from")).where("words > 0").groupBy(
        "source_no", "start"
    ).agg(F.sum("words").alias("words"))
    return placed.join(taken, ["source_no", "start"], "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long").alias("taken"), "h",
    )
