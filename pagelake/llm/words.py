"""Words and 64-bit word hashes of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh3_64_intdigest

WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that a task holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 values (wraps on purpose)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lowered; bytes.split() cuts at 0x20 and 0x09-0x0D only."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` words; a shorter, non-empty sequence gives one hash for all of it."""
    size = min(n, len(h))
    if not size:
        return h
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, np.uint64(size))
        for i in range(size):
            out = mix(out * _STEP + h[i : len(h) - size + 1 + i])
    return out


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` gets a record batch and returns one, or none; batches are bounded in bytes."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Numpy arrays as one list column, without a Python object per value."""
    ends = np.zeros(len(parts) + 1, np.int32)
    ends[1:] = np.cumsum([len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.array([])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
