"""Arrow batches in tasks: bounded in bytes, flat values instead of Python lists, sorted keys summed as they pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches sent to Python hold so many rows and bytes at most, however wide a row is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every batch that has rows."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def list_sizes(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def within(sizes: np.ndarray) -> np.ndarray:
    """Place of every value in its list, of lists laid end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def as_lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def new_keys(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row's key differs from that of the row before; nulls are equal to each other."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        alone = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), alone).to_numpy(zero_copy_only=False)
    return out


def key_numbers(columns: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """First row of every key and the number of each row's key; nulls are equal to each other."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return np.unique(code, return_index=True)[1], code


def sum_lists(batch: pa.RecordBatch, keys: Sequence[str], firsts: Sequence[str], sums: Sequence[str], lists: Sequence[str]) -> pa.RecordBatch:
    """Rows of one key next to each other become one: ``sums`` and, element by element, ``lists`` are added up, ``firsts`` kept."""
    starts = np.flatnonzero(new_keys([batch.column(k) for k in keys]))
    at = pa.array(starts)
    columns = {c: batch.column(c).take(at) for c in [*keys, *firsts]}
    for c in sums:
        columns[c] = pa.array(np.add.reduceat(batch.column(c).to_numpy(), starts))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
    for c in lists:
        sizes = list_sizes(batch.column(c))
        width = sizes[starts]
        base = np.cumsum(width) - width
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        total = np.zeros(width.sum(), np.int64)
        if len(starts) == batch.num_rows:
            total = flat(batch.column(c))
        else:
            np.add.at(total, np.repeat(base[group], sizes) + place, flat(batch.column(c)))
        columns[c] = as_lists(total, width, pa.int64())
    return pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], names=batch.schema.names)


def summed_by_key(df: DataFrame, keys: Sequence[str], firsts: Sequence[str], sums: Sequence[str], lists: Sequence[str],
                  finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One row per key, through ``finish``.

    Rows meet by key and are summed as a sorted stream; a task holds one batch and the
    row that a batch ends with. Every list of a key must have the same length.
    """
    bound_batches(df.sparkSession)
    names = [*keys, *firsts, *sums, *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            whole = sum_lists(batch, keys, firsts, sums, lists)
            held = whole.slice(whole.num_rows - 1)
            if whole.num_rows > 1:
                yield finish(whole.slice(0, whole.num_rows - 1))
        if held is not None:
            yield finish(held)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
