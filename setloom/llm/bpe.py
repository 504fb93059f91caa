"""Byte-level BPE: texts to token ids and back.

A text is cut by the vocabulary's pattern; each distinct piece of a block is merged once. Pieces become rows of padded
matrices, one per length bucket. In each round every row merges its leftmost pair of minimum rank; rows without a
mergeable pair leave the matrix (compaction). Pairs are looked up in an open-addressing hash table. Pieces longer than
the last bucket use the same law on one array: all occurrences of the minimum pair are merged in a round, left to right,
up to the first one whose merge makes a pair of lower rank.

Nulls count as empty texts and give no ids; decoding null ids gives no bytes. Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_batches, own_names

WIDTHS = (2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
KNOWN = 60_000  # pieces or stretches that are remembered; more cost memory and gain no time
BATCH = "2m"  # ids, bytes and texts of a batch are in memory together
_NONE = np.int32(0x7FFFFFFF)
_STRETCH = regex.compile(r"\s*\S+|\s+").findall
_SPACE_BEFORE_SPACE = regex.compile(r"\s ").search


@dataclass(frozen=True)
class Vocabulary:
    """Rank file and split pattern. The file must be readable at this path by every executor.

    ``cut_before_space`` may be set where no match of the pattern runs from a non-space into white space: texts are
    then cut there first, and each distinct stretch is split by the pattern once.
    """

    path: str
    pattern: str
    cut_before_space: bool = False


class Runs:
    """Integer runs of any length under dense numbers, in one growing array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.size, self.pool = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def add(self, names: list[str], sizes: np.ndarray, values: np.ndarray) -> None:
        first = len(self.number)
        self.number.update(zip(names, range(first, first + len(names)), strict=True))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, values.astype(np.int32)])

    def numbers(self, names: list[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, names), np.int64, n)

    def read(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the runs and their values in one array."""
        sizes = self.size[numbers]
        return sizes, self.pool[spread(self.start[numbers], sizes)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class PairTable:
    """Rank of the token that two tokens join to; open addressing with linear probes."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._values = np.full(1 << bits, _NONE, np.int32)
        self._probes = 1
        left, worth = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slots(left)
        while len(left):
            free = np.flatnonzero(self._keys[slot] < 0)
            self._keys[slot[free]] = left[free]
            self._values[slot[free]] = worth[free]
            lost = self._keys[slot] != left
            self._values[slot[~lost]] = worth[~lost]
            left, worth, slot = left[lost], worth[lost], (slot[lost] + 1) & self._mask
            self._probes += bool(len(left))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        flat = keys.ravel()
        slot = self._slots(flat)
        held = self._keys[slot]
        out = np.where(held == flat, self._values[slot], _NONE)
        open_ = np.flatnonzero((held != flat) & (held >= 0))
        for _ in range(self._probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self._mask
            held = self._keys[slot[open_]]
            hit = held == flat[open_]
            out[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out.reshape(keys.shape)


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = PairTable(self.ranks)
        self.split = regex.compile(vocabulary.pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token_bytes: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token_bytes[rank] = token
        self.pieces, self.stretches = Runs(), Runs()  # ids of a piece, pieces of a stretch
        self.apart = vocabulary.cut_before_space
        self.cut = self._cut_text if self.apart else self.split

    def _cut_text(self, text: str) -> list[str]:
        if _SPACE_BEFORE_SPACE(text):
            return _STRETCH(text)
        first, *rest = text.split(" ")
        rest = [" " + x for x in rest]
        return [first, *rest] if first else rest

    def learn(self, stretches: set[str]) -> None:
        """Split and merge what is new; all is forgotten when it is too much."""
        if len(self.stretches.number) > KNOWN or len(self.pieces.number) > KNOWN:
            self.stretches.clear()
            self.pieces.clear()
        new = list(stretches.difference(self.stretches.number))
        pieces, sizes = self._split_all(new) if self.apart else self._split_each(new)
        self._learn_pieces(set(pieces).difference(self.pieces.number))
        self.stretches.add(new, sizes, self.pieces.numbers(pieces, len(pieces)))

    def _split_each(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        split = [self.split(x) for x in texts]
        return list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))

    def _split_all(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The same, in one call: stretches that begin with a space part where they meet; the others go first, each alone."""
        texts.sort(key=lambda x: x[0] == " " and not x[-1].isspace())
        alone = next((i for i, x in enumerate(texts) if x[0] == " " and not x[-1].isspace()), len(texts))
        first, sizes = self._split_each(texts[:alone])
        pieces = self.split("".join(texts[alone:]))
        piece_ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        text_ends = np.cumsum(np.fromiter(map(len, texts[alone:]), np.int64, len(texts) - alone))
        upto = np.searchsorted(piece_ends, text_ends, "right")
        return first + pieces, np.concatenate([sizes, np.diff(upto, prepend=0)])

    def _learn_pieces(self, new: set[str]) -> None:
        names = list(new)
        raw = [piece.encode() for piece in names]
        whole = np.fromiter(map(self.ranks.get, raw, repeat(-1)), np.int32, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(length) - length
        done = whole >= 0
        self._add([names[i] for i in np.flatnonzero(done)], whole[done][:, None])
        for i in np.flatnonzero(~done & (length > WIDTHS[-1])):
            self._add([names[i]], self._merge_long(self.byte_ids[data[start[i]:start[i] + length[i]]])[None, :])
        bucket = np.searchsorted(WIDTHS, length)
        for k, width in enumerate(WIDTHS):
            rows = np.flatnonzero(~done & (bucket == k))
            for at in range(0, len(rows), 4000):
                part = rows[at:at + 4000]
                column = np.arange(width)
                place = np.minimum(start[part][:, None] + column, len(data) - 1)
                state = np.where(column < length[part][:, None], self.byte_ids[data[place]], np.int32(-1))
                self._add([names[i] for i in part], self._merge_rows(state))

    def _add(self, names: list[str], ids: np.ndarray) -> None:
        held = ids >= 0
        self.pieces.add(names, held.sum(axis=1), ids[held])

    def _merge_rows(self, state: np.ndarray) -> np.ndarray:
        """All merges of the rows of a padded matrix of byte ids; -1 pads."""
        result = np.full_like(state, -1)
        ranks = self._pair_ranks(state)
        origin = np.arange(len(state))
        while len(state):
            n = np.arange(len(state))
            at = ranks.argmin(axis=1)
            best = ranks[n, at]
            done = best == _NONE
            if done.any():  # compaction: finished rows leave, then columns that no row uses any more
                result[origin[done], :state.shape[1]] = state[done]
                keep = np.flatnonzero(~done)
                used = int((state[keep] >= 0).sum(axis=1).max(initial=2))
                state, ranks, origin = state[keep, :used], ranks[keep, :used - 1], origin[keep]
                at, best, n = at[keep], best[keep], n[:len(keep)]
                if not len(keep):
                    break
            width = state.shape[1]
            # The merged token takes the pair's place and all behind it moves up by one.
            column = np.arange(width - 1)
            behind = column > at[:, None]
            state[:, :-1] = np.where(behind, state[:, 1:], state[:, :-1])
            state[:, -1] = -1
            state[n, at] = best
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            for left in (at - 1, at):
                a, b = state[n, np.maximum(left, 0)], state[n, np.minimum(left + 1, width - 1)]
                there = (left >= 0) & (left < width - 1) & (b >= 0)
                found = np.where(there, self.pairs.find(a, np.maximum(b, 0)), _NONE)
                rows = np.flatnonzero((left >= 0) & (left < width - 1))
                ranks[rows, left[rows]] = found[rows]
        return result

    def _pair_ranks(self, state: np.ndarray) -> np.ndarray:
        a, b = state[:, :-1], state[:, 1:]
        return np.where(b >= 0, self.pairs.find(np.maximum(a, 0), np.maximum(b, 0)), _NONE)

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        while len(ids) > 1:
            ranks = self.pairs.find(ids[:-1], ids[1:])
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            # Of overlapping occurrences every second one counts from the left.
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1]))
            first = at[np.searchsorted(run, run, "left")]
            at = at[(at - first) % 2 == 0]
            joined = np.full(len(at), best, ids.dtype)
            touching = np.concatenate([[False], np.diff(at) == 2])
            before = np.where(touching, best, ids[np.maximum(at - 1, 0)])
            after = ids[np.minimum(at + 2, len(ids) - 1)]
            low = (at > 0) & (self.pairs.find(before, joined) < best)
            low |= (at + 2 < len(ids)) & (self.pairs.find(joined, after) < best)
            if low.any():
                at = at[:int(np.argmax(low)) + 1]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        cut = [self.cut(t) for t in texts]
        held = np.fromiter(map(len, cut), np.int64, len(cut))
        every = list(chain.from_iterable(cut))
        self.learn(set(every))
        stretches = self.stretches.numbers(every, len(every))
        pieces_each, pieces = self.stretches.read(stretches)
        ids_each, ids = self.pieces.read(pieces)
        return _totals(_totals(ids_each, pieces_each), held), ids

    def decode(self, ids: np.ndarray) -> bytes:
        names = self.token_bytes
        found = [names[i] if 0 <= i < len(names) else None for i in ids.tolist()]
        if None in found:
            raise ValueError("an id is not in the vocabulary")
        return b"".join(found)


def _totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each run."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


@lru_cache(maxsize=2)
def coder(vocabulary: Vocabulary) -> Coder:
    """One coder per worker process and vocabulary."""
    return Coder(vocabulary)


def _row_groups(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for value in texts.to_pylist():
        group.append(value or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "token_ids", raw: str | None = None) -> DataFrame:
    """Add ``ids`` (array of int) to each row. No shuffle; every text is encoded whole.

    With ``raw`` also the bytes that the ids stand for, as ``decode`` gives them: by the same worker, with one coder.
    """
    bounded_batches(df.sparkSession, size=BATCH)
    kept = own_names(df, ids) if raw is None else own_names(df, ids, raw)
    names = kept.columns
    place = names.index(text)
    found = kept.withColumn(ids, F.array().cast("array<int>"))
    out = (found if raw is None else found.withColumn(raw, F.lit(b"").cast("binary"))).schema

    def run(batches):
        pa.default_memory_pool().release_unused()  # what earlier jobs left in this worker
        work = coder(vocabulary)
        for batch in batches:
            done = [work.encode(group) for group in _row_groups(batch.column(place))]
            ends = np.concatenate([[0], *(sizes for sizes, _ in done)]).cumsum().astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *(found for _, found in done)])
            added = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            if raw is not None:
                added.append(pa.array((work.decode(values[a:b]) for a, b in pairwise(ends.tolist())), pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=out.names)

    return kept.mapInArrow(run, out)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", raw: str = "decoded") -> DataFrame:
    """Add ``raw`` (binary): the bytes that the ids stand for."""
    bounded_batches(df.sparkSession)
    kept = own_names(df, raw)
    names = kept.columns
    place = names.index(ids)
    out = kept.withColumn(raw, F.lit(b"").cast("binary")).schema

    def run(batches):
        work = coder(vocabulary)
        for batch in batches:
            lists = batch.column(place)
            values = np.asarray(lists.flatten(), dtype=np.int64)
            sizes = [0 if n is None else n for n in pc.list_value_length(lists).to_pylist()]
            ends = np.cumsum([0, *sizes])
            found = [work.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*names, raw])

    return kept.mapInArrow(run, out)


