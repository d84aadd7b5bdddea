"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of ``CELLS`` positions; a row belongs to
the first virtual node clockwise from its hash. Loads are bounded exactly: with n
rows, the first n mod shards shards hold one row more than the others, so counts
are at most one apart (law ``rows``). Rows are taken in ring order; those that
find their shard full continue clockwise to the next shard with room. A shard
that fills up only diverts what lies behind it, which keeps movement small when
shards are added or rows come and go.

Rows in ring order form consecutive stretches that go to one shard, at most one
per virtual node and one more per shard that fills up. The stretches come from
the row counts of the ring's positions alone, by folds inside one SQL row of
fixed size; the rows themselves are only ranked in their position and joined to
the stretch that holds their rank. Everything is DataFrame functions.

Defined results: null text has no bytes and size 1. Null and repeated doc_ids are
placed by the hash of id and text; rows that agree in both are interchangeable
and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pagelake.session import cut_lineage
from .ranks import before_in_order, cell_of, unsigned

SHARDS, VIRTUAL_NODES, CELLS = 16, 64, 1 << 12
_SEED = 4


def ring(spark: SparkSession, shards: int, virtual_nodes: int, cells: int = CELLS) -> DataFrame:
    """Owner of each ring position: the shard of the next virtual node clockwise.

    Two virtual nodes at one position: the one with the smaller hash counts.
    """
    nodes = spark.range(shards * virtual_nodes).select(
        F.expr(f"CAST(id div {virtual_nodes} AS INT)").alias("shard"), (F.col("id") % virtual_nodes).alias("node")
    ).withColumn("h", F.xxhash64(F.lit(_SEED), "shard", "node"))
    at = nodes.groupBy(cell_of(F.col("h"), cells).alias("cell")).agg(F.min_by("shard", "h").alias("shard"))
    ahead = W.orderBy("cell").rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        spark.range(cells).select(F.col("id").cast("int").alias("cell")).join(at, "cell", "left")
        .select("cell", F.coalesce(F.first("shard", True).over(ahead), F.first("shard", True).over(whole)).alias("owner"))
    )


def stretches(owners: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """cell, shard, from and to (ranks in ring order) and slot_from, for every stretch.

    One row folds over the ring: the rows of a position go to its owner while that
    has room, then clockwise to the owners of the next positions.
    """
    full = owners.join(counts, "cell", "left").select("cell", "owner", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    one = full.agg(
        F.array_sort(F.collect_list(F.struct("cell", "owner", "rows"))).alias("ring"), F.sum("rows").alias("total")
    ).select("ring", "total", F.transform("ring", lambda x: x["owner"]).alias("owners"))
    one = one.withColumn(
        "room", F.expr(f"transform(sequence(0, {shards - 1}), s -> total div {shards} + IF(s < total % {shards}, 1L, 0L))")
    )
    part = "struct<cell:int,shard:int,from:bigint,to:bigint,slot:bigint>"
    step = f"""aggregate(
        IF(p.rows <= acc.room[p.owner], array(p.owner),
           array_distinct(concat(slice(owners, p.cell + 1, size(owners)), slice(owners, 1, p.cell)))),
        named_struct('room', acc.room, 'rank', acc.rank, 'rest', p.rows, 'parts', CAST(array() AS array<{part}>)),
        (b, s) -> IF(least(b.rest, b.room[s]) <= 0, b, named_struct(
            'room', transform(b.room, (r, i) -> IF(i = s, r - least(b.rest, b.room[s]), r)),
            'rank', b.rank + least(b.rest, b.room[s]),
            'rest', b.rest - least(b.rest, b.room[s]),
            'parts', array_append(b.parts, named_struct('cell', p.cell, 'shard', s, 'from', b.rank,
                'to', b.rank + least(b.rest, b.room[s]), 'slot', limits[s] - b.room[s])))))"""
    # Folds over blocks of positions inside a fold over the blocks: no long array grows by single entries.
    blocks = 64
    fold = f"""aggregate(x.part, named_struct('room', x.room, 'rank', x.rank, 'parts', CAST(array() AS array<{part}>)),
        (acc, p) -> transform(array({step}),
            d -> named_struct('room', d.room, 'rank', d.rank, 'parts', concat(acc.parts, d.parts)))[0])"""
    outer = f"""aggregate(sequence(0, (size(ring) - 1) div {blocks}),
        named_struct('room', room, 'rank', 0L, 'parts', CAST(array() AS array<array<{part}>>)),
        (o, k) -> transform(
            array(named_struct('part', slice(ring, k * {blocks} + 1, {blocks}), 'room', o.room, 'rank', o.rank)),
            x -> transform(array({fold}),
                f -> named_struct('room', f.room, 'rank', f.rank, 'parts', array_append(o.parts, f.parts)))[0])[0])"""
    return one.withColumn("limits", F.col("room")).select(F.explode(F.flatten(F.expr(f"{outer}.parts"))).alias("p")).select("p.*")


def shard(
    docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not by key) of every row."""
    spark = docs.sparkSession
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    ).withColumn("h", F.xxhash64(F.lit(_SEED), "doc_id", "text_crc32"))
    rows = cut_lineage(rows.withColumn("cell", cell_of(F.col("h"), cells)), "ring-rows")
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    parts = cut_lineage(stretches(ring(spark, shards, virtual_nodes, cells), counts, shards), "stretches")
    ranked = before_in_order(
        rows.withColumn("g", F.lit(0)), ["g"], "cell", [unsigned(F.col("h")), "doc_id", "text_crc32"], F.lit(1), "rank"
    )
    held = ranked.join(F.broadcast(parts), "cell").where("rank >= from AND rank < to")
    return held.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("rank") - F.col("from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
