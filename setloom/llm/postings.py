"""Per-document multisets of keys in blocks, and sums of key values that only the whole corpus tells.

A task packs its documents into blocks of bounded text. A block holds its distinct keys once and, for each document, the
numbers of its keys and how often each occurs. Only the distinct keys of a block travel by key: they meet the value of the
key, go back to their block, and the sums of each document are taken inside the block. What moves by key is what the blocks
hold, not what the documents hold; a key that is in every document has one row a block. Nothing is broadcast.

Blocks are checkpointed, as they are read twice: to find the keys, and to sum. Keys and numbers travel compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

_CODEC = "zstd"


def row_groups(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``limit`` characters, or of one longer text, with their texts (null: empty)."""
    group, size, first = [], 0, 0
    for value in texts.to_pylist():
        group.append(value or "")
        size += len(group[-1])
        if size >= limit:
            yield first, first + len(group), group
            first, group, size = first + len(group), [], 0
    if group:
        yield first, first + len(group), group


def schema(kept: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(kept)),
        T.StructField("packed", T.BinaryType()), T.StructField("keys", T.BinaryType())])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed buffer: their number of bytes first, each array by its bytes of like weight."""
    parts = []
    for values in arrays:
        raw = values if isinstance(values, bytes) else np.ascontiguousarray(
            values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
        small = pa.compress(raw, codec=_CODEC, asbytes=True)
        parts += [np.array([len(raw), len(small)], np.int64).tobytes(), small]
    return b"".join(parts)


def unpack(packed: bytes, *kinds) -> list:
    out, at = [], 0
    for kind in kinds:
        raw, small = np.frombuffer(packed, np.int64, 2, at).tolist()
        held = pa.decompress(packed[at + 16:at + 16 + small], raw, codec=_CODEC, asbytes=True)
        at += 16 + small
        if kind is not bytes:
            width = np.dtype(kind).itemsize
            held = np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(width, -1).T).view(kind).ravel()
        out.append(held)
    return out


class Packer:
    """Gathers documents of one task and gives a block when ``limit`` bytes of text are in."""

    def __init__(self, limit: int):
        self.limit, self.made = limit, 0
        self._clear()

    def _clear(self) -> None:
        self.bytes, self.rows, self.sizes, self.numbers, self.times = 0, [], [], [], []

    def add(self, rows: pa.StructArray, sizes: np.ndarray, numbers: np.ndarray, n_bytes: int) -> None:
        """``numbers``: the keys of all documents one after the other, with repeats; ``sizes``: how many each has."""
        span = int(numbers.max(initial=0)) + 1
        doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        held, times = np.unique(doc * span + numbers, return_counts=True)
        self.sizes.append(np.bincount(held // span, minlength=len(sizes)))
        self.numbers.append(held % span)
        self.times.append(times.astype(np.uint32))
        self.rows.append(rows)
        self.bytes += n_bytes

    @property
    def full(self) -> bool:
        return self.bytes >= self.limit

    def block(self, keys_of: Callable[[np.ndarray], pa.Array]) -> Iterator[pa.RecordBatch]:
        """The block gathered so far, if any. ``keys_of`` names the keys behind numbers: strings or longs."""
        if not self.rows:
            return
        sizes, times = np.concatenate(self.sizes), np.concatenate(self.times)
        used, which = np.unique(np.concatenate(self.numbers), return_inverse=True)
        self.numbers, self.times = [], []
        held_by = np.bincount(which, minlength=len(used))
        totals = np.bincount(which, weights=times, minlength=len(used)).astype(np.uint32)
        # Frequent keys first: small numbers pack better.
        order = np.argsort(-held_by, kind="stable")
        totals = totals[order]
        place = np.empty(len(used), np.int64)
        place[order] = np.arange(len(used))
        # Places of a document in ascending order, each but its first as the distance to the one before.
        ranked = np.repeat(np.arange(len(sizes)), sizes) * len(used) + place[which]
        del which, place
        sort = np.argsort(ranked)
        ranked, times = ranked[sort] % max(len(used), 1), times[sort]
        del sort
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        step = np.diff(ranked, prepend=0)
        step[firsts] = ranked[firsts]
        step = step.astype(np.uint32)
        del ranked
        names = keys_of(used[order])
        number = (TaskContext.get().partitionId() << 32) | self.made
        rows = pa.concat_arrays(self.rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
             pa.array([pack(sizes.astype(np.uint32), step, times)], pa.binary()),
             pa.array([_pack_keys(names, totals)], pa.binary())], names=["block", "rows", "packed", "keys"])
        self.made += 1
        self._clear()


def _pack_keys(names: pa.Array, totals: np.ndarray) -> bytes:
    if pa.types.is_string(names.type):
        raw = [x.encode() for x in names.to_pylist()]
        return pack(totals, np.fromiter(map(len, raw), np.uint32, len(raw)), b"".join(raw))
    return pack(totals, names.to_numpy().astype(np.int64))


def _unpack_keys(packed: bytes, key: pa.DataType) -> tuple[np.ndarray, pa.Array]:
    if pa.types.is_string(key):
        totals, sizes, raw = unpack(packed, np.uint32, np.uint32, bytes)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        return totals, pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    totals, keys = unpack(packed, np.uint32, np.int64)
    return totals, pa.array(keys, pa.int64())


def block_keys(blocks: DataFrame, key: T.DataType) -> DataFrame:
    """``block, place, key, total``: the distinct keys of each block and how often each occurs in it."""
    kind = pa.string() if isinstance(key, T.StringType) else pa.int64()

    def run(batches):
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals, keys = _unpack_keys(packed, kind)
                block = np.full(len(keys), number)
                for i in range(0, len(keys), 50_000):
                    j = min(i + 50_000, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[i:j]), pa.array(np.arange(i, j, dtype=np.int32)), keys.slice(i, j - i),
                         pa.array(totals[i:j].astype(np.int64))], names=["block", "place", "key", "total"])

    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()),
                        T.StructField("key", key), T.StructField("total", T.LongType())])
    return blocks.select("block", "keys").mapInArrow(run, out)


GATHERED = 1 << 20


def _gather(found: DataFrame, names: list[str]) -> DataFrame:
    """``block, found``: values for the places of a block, packed as far as a task meets them together."""

    def rows(parts):
        block, place, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, block))
        block, place, values = block[order], place[order].astype(np.uint32), [v[order] for v in values]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        packed = [pack(np.diff(place[i:j], prepend=np.uint32(0)), *[v[i:j] for v in values]) for i, j in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(packed, pa.binary())], names=["block", "found"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                held += batch.num_rows
            if held >= GATHERED:
                yield rows(parts)
                parts, held = [], 0
        if held:
            yield rows(parts)

    return found.select("block", "place", *[F.col(n).cast("long") for n in names]).mapInArrow(run, "block long, found binary")


def key_sums(blocks: DataFrame, key: T.DataType, values_of: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
    """The packed rows, each with the sum of every named key value over its keys, repeats included.

    ``values_of`` gets ``block, place, key, total`` rows, a key once a block, and gives ``block, place`` with the named
    values of the key there; a key without values is worth nothing.
    """
    blocks = cut_lineage(blocks)
    back = _gather(values_of(block_keys(blocks, key)), names).groupBy("block").agg(F.collect_list("found").alias("found"))
    kept = blocks.schema["rows"].dataType.elementType
    out = T.StructType([*kept.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                sizes, step, times = unpack(column["packed"][i].as_py(), np.uint32, np.uint32, np.uint32)
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                # Distances back to places: a running sum that starts anew with each document.
                upto = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])
                which = upto[1:] - np.repeat(upto[starts], sizes)
                worth = np.zeros((len(names), int(which.max(initial=0)) + 1), np.int64)
                for packed in column["found"][i].as_py() or []:
                    place, *values = unpack(packed, np.uint32, *[np.int64] * len(names))
                    place = np.cumsum(place, dtype=np.int64)
                    for k, v in enumerate(values):
                        worth[k, place] = v
                sums = []
                for value in worth:
                    total = np.concatenate([[0], np.cumsum(value[which] * times.astype(np.int64))])
                    sums.append(pa.array(total[ends] - total[starts], pa.int64()))
                yield pa.RecordBatch.from_arrays([*column["rows"][i].values.flatten(), *sums], names=out.names)

    return blocks.select("block", "rows", "packed").join(back, "block", "left").mapInArrow(run, out)
