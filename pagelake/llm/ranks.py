"""Exact positions and running sums in a fixed random order, without one long sort.

A row's 64-bit hash places it in one of many cells of equal hash width. Cells are
counted with partial aggregates, the few cell totals are summed up in order, and
rows are sorted only inside their cell. Group columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS = 1 << 12


def cell_of(key: Column, cells: int = CELLS) -> Column:
    """0 to cells - 1 by the top bits of a hash, ascending with the unsigned hash; cells is a power of two."""
    return F.shiftrightunsigned(key, 64 - (cells.bit_length() - 1)).cast("int")


def unsigned(key: Column) -> Column:
    """A long that sorts as the unsigned value of ``key``."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def before_in_order(
    df: DataFrame, groups: Sequence[str], cell: str, order: Sequence[Column | str], value: Column, name: str
) -> DataFrame:
    """Add the sum of ``value`` over the group's rows that come earlier; ``cell`` must ascend with ``order``."""
    work = df.withColumn("_value", value.cast("long"))
    totals = work.groupBy(*groups, cell).agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*groups).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, cell, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*groups, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        work.withColumn("_part", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*groups, cell]).withColumn(name, F.col("_part") + F.col("_offset"))
        .drop("_value", "_part", "_offset")
    )
