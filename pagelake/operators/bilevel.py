"""Runs, code lengths and packed sizes of black-and-white scanlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from ..arrows import as_lists, bound_batches, flat, list_sizes, within
from ..fixed import (
    T4_BLACK_MAKEUP, T4_BLACK_TERMINATING, T4_SHARED_MAKEUP, T4_WHITE_MAKEUP, T4_WHITE_TERMINATING, T6_END_OF_BLOCK,
)
from ..functions import fax
from .raster import PAGE


@F.arrow_udf(ArrayType(IntegerType()))
def _changes(bits: pa.Array) -> pa.Array:
    sizes, v = list_sizes(bits), flat(bits)
    at = within(sizes)
    before = np.where(at > 0, np.concatenate([v[:1], v[:-1]]), 0)
    found = v != before
    line = np.repeat(np.arange(len(sizes)), sizes)
    return as_lists(at[found].astype(np.int32), np.bincount(line[found], minlength=len(sizes)), pa.int32())


def changing_elements(bits: DataFrame) -> DataFrame:
    """Positions where a pixel differs from the one before it (white before the first)."""
    bound_batches(bits.sparkSession)
    return bits.withColumn("changes", _changes("bit"))


def pixel_runs(bits: DataFrame) -> DataFrame:
    """Maximal runs per line; colours alternate from white, whose first run may be empty."""
    edges = changing_elements(bits).selectExpr(
        *PAGE, "y", "concat(array(0), changes, array(size(bit))) AS e"
    )
    return edges.selectExpr(
        *PAGE, "y",
        """posexplode(transform(sequence(0, size(e) - 2), k ->
             named_struct('colour', CAST(k % 2 AS INT), 'start', e[k], 'length', e[k + 1] - e[k]))) AS (k, run)""",
    ).selectExpr(*PAGE, "y", "k", "run.colour AS colour", "run.start AS start", "run.length AS length")


def _lengths(words: list[str]) -> str:
    return "array(" + ", ".join(str(len(w)) for w in words) + ")"


def run_code_bits(runs: DataFrame) -> DataFrame:
    """One-dimensional code length of each run; the code tables are plan constants."""

    def by_colour(white: list[str], black: list[str], index: str) -> str:
        return f"CASE WHEN colour = 0 THEN get({_lengths(white)}, {index}) ELSE get({_lengths(black)}, {index}) END"

    split = runs.withColumn("_rep", F.expr("CAST(greatest(0, (length - 64) div 2560) AS INT)")).withColumn(
        "_rest", F.expr("length - _rep * 2560")
    )
    makeup = by_colour(T4_WHITE_MAKEUP + T4_SHARED_MAKEUP, T4_BLACK_MAKEUP + T4_SHARED_MAKEUP, "CAST(_rest div 64 - 1 AS INT)")
    term = by_colour(T4_WHITE_TERMINATING, T4_BLACK_TERMINATING, "CAST(_rest % 64 AS INT)")
    longest = len(T4_SHARED_MAKEUP[-1])
    return split.withColumn(
        "bits", F.expr(f"_rep * {longest} + CASE WHEN _rest >= 64 THEN {makeup} ELSE 0 END + {term}")
    ).drop("_rep", "_rest")


@F.arrow_udf(BinaryType())
def _packed_bits(bits: pa.Array) -> pa.Array:
    sizes, black = list_sizes(bits), flat(bits) == 0
    wide = -(-sizes // 8)
    row = np.zeros(8 * int(wide.sum()), bool)
    row[np.repeat(8 * (np.cumsum(wide) - wide), sizes) + within(sizes)] = black
    ends = np.concatenate([[0], np.cumsum(wide)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.packbits(row))])


def pack_bits(bits: DataFrame) -> DataFrame:
    """Eight pixels a byte, 1 = white, lines byte-aligned."""
    bound_batches(bits.sparkSession)
    return bits.withColumn("packed", _packed_bits("bit"))


def pack_nibbles(indexed: DataFrame) -> DataFrame:
    """Two palette indices a byte, high nibble first, lines byte-aligned."""
    byte = "get(idx, CAST(2 * k AS INT)) * 16 + coalesce(get(idx, CAST(2 * k + 1 AS INT)), 0)"
    return indexed.withColumn(
        "packed",
        F.expr(f"unhex(array_join(transform(sequence(0, (size(idx) + 1) div 2 - 1), k -> lpad(hex({byte}), 2, '0')), ''))"),
    )


_g4_bits = pandas_udf(fax.line_bits, IntegerType())
_deflated = pandas_udf(fax.deflated_length, LongType())


def _with_line_above(bits: DataFrame) -> DataFrame:
    above = F.lag("changes").over(W.partitionBy(*PAGE).orderBy("y"))
    return changing_elements(bits).withColumn(
        "above", F.coalesce(above, F.expr("CAST(array() AS ARRAY<INT>)"))
    )


def g4_line_bits(bits: DataFrame) -> DataFrame:
    """Two-dimensional code length of each line, given the line above it."""
    return _with_line_above(bits).select(*PAGE, "y", _g4_bits("above", "changes", F.size("bit")).alias("bits"))


def g4_page_bytes(bits: DataFrame) -> DataFrame:
    """Whole bytes of a coded page including its end mark."""
    return g4_line_bits(bits).groupBy(*PAGE).agg(F.sum("bits").alias("b")).selectExpr(
        *PAGE, f"CAST(ceil((b + {len(T6_END_OF_BLOCK)}) / 8) AS BIGINT) AS g4_bytes"
    )


def packed_page(bits: DataFrame) -> DataFrame:
    """Packed lines of a page in order as one value (at most 2 MB at the pixel cap)."""
    return pack_bits(bits).groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("y", F.hex("packed").alias("h")))).alias("l")
    ).selectExpr(*PAGE, "unhex(array_join(transform(l, e -> e.h), '')) AS packed")


def deflate_size(bits: DataFrame) -> DataFrame:
    return packed_page(bits).select(*PAGE, _deflated("packed").alias("flate_bytes"))


def page_codec_sizes(bits: DataFrame) -> DataFrame:
    """Both encoded sizes of every page, ready for ``codec_choice``."""
    return g4_page_bytes(bits).join(deflate_size(bits), PAGE)
