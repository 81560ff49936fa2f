"""What the training-data operators share: Arrow batches as byte arrays, word hashing, stage tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.tables import arrow_map, materialize

__all__ = ["arrow_map", "blocks", "by_place", "integer_key", "chunks", "grouped", "materialize", "mix", "powers", "prefix_sums", "span_hash", "spans_of", "utf8"]

#: Bytes of text that a kernel turns into numpy arrays at once; one longer text is taken alone.
CHUNK_BYTES = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def by_place(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ..., so that no name of a user's column meets one that an operator uses."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as long, a null as the smallest. Keys give the order here, so other than integers are refused."""
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} should be an integer, not {df.schema[key].dataType.simpleString()}")
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)))


def blocks(column: pa.Array, limit: int, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, base): rows of at most about `limit` bytes of text; of a longer text one block after
    another, each with the `overlap` first bytes of the next, and base its place in the text."""
    for a, b in chunks(column, limit):
        data, offsets = utf8(column.slice(a, b - a))
        if len(data) <= limit + overlap:
            yield a, data, offsets, 0
            continue
        for base in range(0, len(data) - overlap, limit):
            part = data[base : base + limit + overlap]
            yield a, part, np.array([0, len(part)]), base


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text (one row at least)."""
    n = len(column)
    if not n:
        return
    lengths = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    start = 0
    while start < n:
        end = int(np.searchsorted(lengths, lengths[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, nulls as empty, and the offsets of its rows in them."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit of 64-bit values over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Weighted prefix sums from which span_hash takes the hash of any span."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes have equal hashes wherever they lie."""
    _, inverse = powers(len(sums))
    return mix(((sums[end] - sums[start]) * inverse[start]) ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses a row's boundary."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first column."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != key:
                yield rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield rows
