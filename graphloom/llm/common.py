"""What the operators of this subpackage share: settings, written stages, views of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from graphloom import session

# Text per numpy step; a longer text is a step of its own.
STEP_BYTES = 1 << 21

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the package; Arrow batches small enough for long texts."""
    session.prepare(spark)
    # Rows here do not widen behind a shuffle; their figures were taken with tasks as large as the session has them.
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder; its shuffle files go once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN)
    conf.set(_CLEAN, "true")
    try:
        return session.cut(df)
    finally:
        conf.set(_CLEAN, before)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows, holding at most ``limit`` bytes, one row at least."""
    low, total = 0, len(offsets) - 1
    while low < total:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), total, low + (rows or total))
        yield low, high
        low = high


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of every word, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    odd = np.uint64(0x9E3779B97F4A7C15 ^ (seed << 1))
    h = _mix((lengths.astype(np.uint64) + np.uint64(seed)) * odd)
    at, todo = 0, np.arange(len(starts))
    while len(todo):
        lane = lanes[starts[todo] + at] & MASK[np.minimum(lengths[todo] - at, 8)]
        h[todo] = _mix((h[todo] ^ lane) * odd)
        at += 8
        todo = todo[lengths[todo] > at]
    return h


def rolling(h: np.ndarray, n: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of ``n`` neighbours, len(h) - n + 1 of them."""
    size = len(h) - n + 1
    out = np.zeros(max(size, 0), np.uint64)
    if size > 0:
        for k in range(n):
            out *= np.uint64(factor)
            out += h[k : k + size]
        _mix(out)
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n`` neighbours, by doubling."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = n - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
