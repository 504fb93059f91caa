"""What the text operators share: table reading, bounded blocks of text, and words as hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Inside a task, texts are handled as one byte buffer
with offsets, so that splitting and hashing are array operations over whole blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Keep the batches that reach Python small, in rows and in bytes: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def sealed(df: DataFrame) -> DataFrame:
    """The same rows; filters on them are not moved below, where each would repeat the expressions it looks at."""
    return df.withColumn("_seal", F.monotonically_increasing_id()).where("_seal >= 0").drop("_seal")


def own_names(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to add itself, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1 + column.offset)[column.offset:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each row's words begin (n + 1 entries)."""
    inside = _IS_WORD[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)  # a word never runs over the end of its row
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """64-bit polynomial hashes of byte ranges, all ranges of a block at once."""

    def __init__(self) -> None:
        self._size = 0

    def _grow(self, n: int) -> None:
        if n > self._size:
            size = max(n, BLOCK_BYTES) + 64
            with np.errstate(over="ignore"):
                steps = np.full(size, _BASE, np.uint64)
                steps[0] = 1
                self._powers = np.cumprod(steps)
                steps[:] = _INVERSE
                steps[0] = 1
                self._inverses = np.cumprod(steps)
            self._size = size

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=total[1:])
        return total

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[ends] - prefix[starts]) * self._inverses[starts])


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return h ^ (h >> np.uint64(32))


_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased and up to three marks off each edge, and where each row's words begin."""
    starts, ends, upto = word_bounds(data, offsets)
    data = LOWER[data]
    for _ in range(3 if len(starts) else 0):
        starts = starts + ((starts < ends) & _EDGE[data[np.minimum(starts, len(data) - 1)]])
        ends = ends - ((starts < ends) & _EDGE[data[ends - 1]])
    return hasher.ranges(hasher.prefix(data), starts, ends), upto
