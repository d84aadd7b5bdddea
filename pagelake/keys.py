"""Ordered numbering that does not put one key into one task.

A plain ``row_number() OVER (PARTITION BY key)`` sends every row of a key to a
single task. Here a deterministic, order-preserving *chunk* column splits each
key; rows are numbered inside a chunk and shifted by the summed sizes of the
earlier chunks. Only one row per (key, chunk) is ever gathered by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _chunk_offsets(work: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Sum of ``value`` over the earlier chunks of each key: _group and _offset."""
    totals = work.groupBy("_group").agg(value.alias("_total"))
    before = W.partitionBy(*[F.col("_group")[k] for k in keys]).orderBy(F.col("_group")["_chunk"]).rowsBetween(
        W.unboundedPreceding, -1
    )
    return totals.select("_group", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def _grouped(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Key and chunk as one struct: structs are equal where both have a null, so no row is lost in a join."""
    return df.withColumn("_chunk", chunk).withColumn("_group", F.struct(*keys, "_chunk")).drop("_chunk")


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    name: str = "idx",
) -> DataFrame:
    """1-based position inside ``keys``; ``chunk`` must be monotone in ``order``. A null key is a key."""
    work = _grouped(df, keys, chunk)
    offsets = _chunk_offsets(work, keys, F.count(F.lit(1)))
    inside = W.partitionBy("_group").orderBy(*order)
    return (
        work.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, "_group")
        .withColumn(name, F.col("_rank") + F.col("_offset"))
        .drop("_group", "_rank", "_offset")
    )


def with_neighbour(
    df: DataFrame, keys: Sequence[str], idx: str, shift: int, columns: Sequence[str], suffix: str
) -> DataFrame:
    """Attach ``columns`` of the row at ``idx + shift`` (null outside).

    The join key contains the position, so a long sequence spreads over tasks.
    """
    other = df.select(
        F.struct(*keys, (F.col(idx) - shift).cast(df.schema[idx].dataType).alias(idx)).alias("_place"),
        *[F.col(c).alias(f"{c}{suffix}") for c in columns],
    )
    return df.withColumn("_place", F.struct(*keys, idx)).join(other, "_place", "left").drop("_place")


def running_total(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str | Column], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over the *earlier* rows of the key (0 for the first), chunked as above."""
    work = _grouped(df, keys, chunk)
    offsets = _chunk_offsets(work, keys, F.sum(value))
    inside = W.partitionBy("_group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        work.withColumn("_part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, "_group")
        .withColumn(name, F.col("_part") + F.col("_offset"))
        .drop("_group", "_part", "_offset")
    )
