"""Chat formatting: conversations to one marked text each, with the loss mask of the assistant's words.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is put before each backslash
and before each ``|`` that follows ``<``, so no control string can appear there and reading back is exact; a line feed
in a role is written as backslash and ``n``.

A batch of turns is assembled in columns: the byte lengths of all segments give cumulative offsets, and scatter indices
place headers, escaped texts and trailers in one buffer that becomes the Arrow column. Rows of a conversation arrive
together (hash partitioning on the conversation, sorted by turn); one that runs over the end of a batch is carried over.

A null text, role or turn counts as empty; a null conversation is one of its own. Rows that tie on the turn follow the
order of role and text. An empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, byte_view

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"

_BACKSLASH, _LESS, _BAR, _LF, _N = 0x5C, 0x3C, 0x7C, 0x0A, 0x6E


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the given runs, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def escape(data: np.ndarray, offsets: np.ndarray, line_feeds: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets of rows given as one buffer."""
    n = len(data)
    feed = (data == _LF) if line_feeds else np.zeros(n, bool)
    marked = (data == _BACKSLASH) | feed
    bars = np.flatnonzero(data == _BAR)
    bars = bars[bars > 0]
    bars = bars[data[bars - 1] == _LESS]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    marked[bars[~first[bars]]] = True
    grown = np.concatenate([[0], np.cumsum(marked)])
    out = np.full(n + int(grown[-1]), _BACKSLASH, np.uint8)
    out[np.arange(n) + grown[1:]] = np.where(feed, _N, data).astype(np.uint8)
    return out, offsets + grown[offsets]


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Join the segments of each row: k columns of n rows to one buffer. Returns it and the (n, k + 1) segment offsets."""
    sizes = np.stack([np.diff(offsets) for _, offsets in segments], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    begins = ends - sizes
    out = np.empty(int(ends.ravel()[-1]) if ends.size else 0, np.uint8)
    for k, (data, offsets) in enumerate(segments):
        out[ranges(begins[:, k], sizes[:, k])] = data[offsets[0]:offsets[-1]]
    return out, np.concatenate([begins, ends[:, -1:]], axis=1)


def _constant(value: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(value.encode(), np.uint8)
    return np.tile(raw, n), np.arange(n + 1) * len(raw)


def _code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position of UTF-8 bytes."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _format(turns: pa.Table) -> pa.RecordBatch:
    """One row per conversation of turns that are whole and in order."""
    n = turns.num_rows
    roles = escape(*byte_view(turns["role"]), line_feeds=True)
    texts = escape(*byte_view(turns["text"]))
    data, at = assemble([_constant(START, n), roles, _constant("\n", n), texts, _constant(END + "\n", n)])
    keys = turns["conv_id"].combine_chunks()
    first = np.concatenate([[0], _changes(keys)])
    bounds = np.concatenate([at[first, 0], [len(data)]])
    points = _code_points(data)
    loss = np.flatnonzero(pc.fill_null(pc.equal(turns["role"], ASSISTANT), False).to_numpy(zero_copy_only=False))
    group = np.searchsorted(first, np.arange(n), "right") - 1
    base = points[bounds[group[loss]]]
    spans = pa.StructArray.from_arrays(
        [pa.array(points[at[loss, 3]] - base), pa.array(points[at[loss, 4]] - base)], names=["start", "end"])
    span_ends = np.concatenate([[0], np.cumsum(np.bincount(group[loss], minlength=len(first)))]).astype(np.int32)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([
        keys.take(pa.array(first)),
        pa.array(np.diff(np.concatenate([first, [n]])).astype(np.int64)),
        formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(span_ends), spans),
    ], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def _changes(keys: pa.Array) -> np.ndarray:
    """Places whose key differs from the one before; null is a key of its own."""
    values, nulls = pc.fill_null(keys, 0).to_numpy(), pc.is_null(keys).to_numpy(zero_copy_only=False)
    return np.flatnonzero((values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1])) + 1


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a conversation ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("conv_id")
        if held and held[-1].column("conv_id")[-1].as_py() != keys[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        inside = _changes(keys)
        if len(inside):
            yield pa.Table.from_batches([*held, batch.slice(0, int(inside[-1]))])
            held = [batch.slice(int(inside[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` rows to ``SCHEMA`` rows. Loss spans are code point ranges of ``formatted``."""
    bounded_batches(turns.sparkSession)
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        yield from map(_format, _whole(batches))

    return ordered.mapInArrow(run, SCHEMA)


def unescape(value: Column, line_feeds: bool = False) -> Column:
    """Undo ``escape`` on a text column: the character after a backslash stands for itself."""
    if not line_feeds:
        return F.regexp_replace(value, r"(?s)\\(.)", "$1")
    parts = F.regexp_extract_all(value, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x == r"\n", "\n").otherwise(unescape(x))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role and text) and ``loss`` (array of text), both read from ``formatted`` alone."""
    body = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    cut = F.transform(body, lambda x: F.struct(
        F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1).alias("role"), x.alias("x")))
    turns = F.transform(cut, lambda x: F.struct(
        unescape(x["role"], line_feeds=True).alias("role"),
        unescape(F.substr(x["x"], F.lit(len(START) + 2) + F.length(x["role"]))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss": loss})
