"""Alignment of two tokenizers on the same texts, and how often their ids are linked in the corpus.

A text with a space before it is encoded by A (byte-level BPE file) and B (sentence-piece model, which adds that space
itself); special tokens are never made and their strings are plain text. The byte offsets at which tokens of both end cut
the text into groups: cumulative ends go into end-to-index dictionaries, the intersection of their keys, sorted, slices both
id lists. Inside each slice every A token is linked to every B token whose byte range overlaps its own.

``align`` gives ids, group ends and links of each document. ``link_sums`` counts each linked id pair over the whole corpus
and gives, per document, the sums over its links.

Texts that are null or empty, or whose tokens do not spell space + text in both, have no tokens: zeros and empty lists.
Every input row gives one row, repeated rows and null ids included; long texts are encoded whole; an empty table gives no
rows. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import postings
from .bpe import _totals, spread
from .text import bounded_batches, own_names

BLOCK_BYTES = 8 << 20
KNOWN = 600_000  # stretches that are remembered
_BEFORE_SPACE = regex.compile(r"(?<=\S)(?= )", regex.V1).split
_SPACE_BEFORE_SPACE = regex.compile(r"\s ").search
_BYTE_PIECE = regex.compile(r"<0x([0-9A-F]{2})>").fullmatch
_INNER_SPACE = regex.compile("[^▁]▁").search
_B_BITS = 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Pair:
    """Files of the two tokenizers, readable at these paths by every executor."""

    a: str
    b: str


@dataclass
class Aligned:
    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray  # A tokens up to the end of each group
    b_cut: np.ndarray
    left: np.ndarray  # A index of each link
    right: np.ndarray


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before each common end."""
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1), strict=True))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    return (np.fromiter(map(a_at.__getitem__, common), np.int64, len(common)),
            np.fromiter(map(b_at.__getitem__, common), np.int64, len(common)))


def expand_links(a_ends: np.ndarray, b_ends: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B index of every link, slice by slice.

    No two tokens of a slice end together before its end, so its links are one fewer than its tokens. Where one side has a
    single token it is linked to all of the other; else the next link moves on in the side whose token ends first.
    """
    a_from, b_from = np.concatenate([[0], a_cut[:-1]]), np.concatenate([[0], b_cut[:-1]])
    n_a, n_b = a_cut - a_from, b_cut - b_from
    size = n_a + n_b - 1
    slice_ = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(slice_)) - np.repeat(np.cumsum(size) - size, size)
    left = a_from[slice_] + np.minimum(step, n_a[slice_] - 1)
    right = b_from[slice_] + np.minimum(step, n_b[slice_] - 1)
    broad = (n_a > 1) & (n_b > 1)
    wide = np.flatnonzero(broad)
    if len(wide):
        here = broad[slice_]
        # The links of a wide slice end where a token of either side ends.
        ends = np.union1d(a_ends[spread(a_from[wide], n_a[wide])], b_ends[spread(b_from[wide], n_b[wide])])
        left[here], right[here] = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return left, right


class Known:
    """What is known of stretches under dense numbers: ids, ends of groups and pair keys in growing arrays, groups as text."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.spelt = np.zeros(0, bool)
        none = np.zeros(0, np.int64)
        self.sizes = dict.fromkeys(("a", "b", "a_cut", "b_cut", "key"), none)
        self.starts = dict(self.sizes)
        self.pools = {n: none if n == "key" else none.astype(np.int32) for n in self.sizes}

    def add(self, names: list[str], spelt: np.ndarray, texts: list[str], n_a, n_b, n_group, n_link, a, b, a_cut, b_cut, key) -> None:
        """Sizes and values are those of the stretches that are spelt."""
        first = len(self.number)
        self.number.update(zip(names, range(first, first + len(names)), strict=True))
        self.texts += texts
        self.spelt = np.concatenate([self.spelt, spelt])
        for name, some, values in (("a", n_a, a), ("b", n_b, b), ("a_cut", n_group, a_cut), ("b_cut", n_group, b_cut), ("key", n_link, key)):
            sizes = np.zeros(len(names), np.int64)
            sizes[spelt] = some
            pool = self.pools[name]
            self.starts[name] = np.concatenate([self.starts[name], len(pool) + np.cumsum(sizes) - sizes])
            self.sizes[name] = np.concatenate([self.sizes[name], sizes])
            self.pools[name] = np.concatenate([pool, values.astype(pool.dtype)])

    def read(self, name: str, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the runs and their values in one array."""
        sizes = self.sizes[name][numbers]
        return sizes, self.pools[name][spread(self.starts[name][numbers], sizes)].astype(np.int64)


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, pair: Pair):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(pair.a)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(self.tokenizer.to_str())
        kind = told["pre_tokenizer"] or {}
        if told["normalizer"] is not None or kind.get("type") != "ByteLevel" or kind["add_prefix_space"]:
            raise ValueError("tokenizer A must be byte-level, without normaliser and without a space of its own")
        letters = byte_letters()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name in (
            self.tokenizer.id_to_token(i) or "" for i in range(size))]
        self.model = sentencepiece.SentencePieceProcessor(model_file=pair.b)
        self.b_bytes = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            byte = _BYTE_PIECE(name) if self.model.is_byte(i) else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _B_BITS:
            raise ValueError("vocabularies beyond a million ids do not fit the pair key")
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        # No pre-token of the byte-level pattern runs from a non-space into white space, and where no piece of B has a
        # space behind anything else, no merge of B crosses such a place: stretches from there on are aligned once.
        self.apart = kind["use_regex"] and not any(_INNER_SPACE(self.model.id_to_piece(i)) for i in range(len(self.b_bytes)))
        self.known = Known()

    def _cut(self, text: str) -> list[str]:
        """Stretches of a text that begins with a space, each with a space in front as B adds one."""
        if not self.apart:
            return [text]
        if _SPACE_BEFORE_SPACE(text):
            found = _BEFORE_SPACE(text)
        else:
            found = [" " + x for x in text[1:].split(" ")]
        if len(found) > 1 and found[-1] == " ":  # B would see nothing there
            found[-2:] = [found[-2] + " "]
        return found

    def _learn(self, new: list[str]) -> None:
        """Both tokenizers on new stretches, and their groups and links as if they were one text."""
        a = [x.ids for x in self.tokenizer.encode_batch(new, add_special_tokens=False)]
        b = self.model.encode([x[1:] for x in new], num_threads=1)
        raw = [x.encode() for x in new]
        spelt = _spelt(a, self.a_bytes, self.a_size, raw) & _spelt(b, self.b_bytes, self.b_size, raw)
        good = np.flatnonzero(spelt).tolist()
        n_a, n_b = (np.fromiter((len(ids[k]) for k in good), np.int64, len(good)) for ids in (a, b))
        a, b = (np.fromiter(chain.from_iterable(ids[k] for k in good), np.int64, n) for ids, n in ((a, n_a.sum()), (b, n_b.sum())))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_cut, b_cut = group_ends(a_ends, b_ends)
        left, right = expand_links(a_ends, b_ends, a_cut, b_cut)
        # Every stretch ends in a common end.
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        upto_group, upto_link = np.searchsorted(a_cut, upto_a, "right"), np.searchsorted(left, upto_a, "left")
        n_group, n_link = np.diff(upto_group, prepend=0), np.diff(upto_link, prepend=0)
        told = groups_text(Aligned(a, b, a_cut, b_cut, left, right)).split(";") if len(a) else []
        texts = [""] * len(new)
        for k, end, n in zip(good, upto_group.tolist(), n_group.tolist(), strict=True):
            texts[k] = told[end - 1] if n == 1 else ";".join(told[end - n:end])
        self.known.add(new, spelt, texts, n_a, n_b, n_group, n_link, a, b, a_cut - np.repeat(upto_a - n_a, n_group),
                       b_cut - np.repeat(upto_b - n_b, n_group), (a[left] << _B_BITS) | b[right])

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of each text, one text after the other, and how many; none where a text has no tokens."""
        if len(self.known.number) > KNOWN:
            self.known.clear()
        cut = [self._cut(" " + t) if t else [] for t in texts]
        every = list(chain.from_iterable(cut))
        new = set(every).difference(self.known.number)
        if new:
            self._learn(list(new))
        numbers = np.fromiter(map(self.known.number.__getitem__, every), np.int64, len(every))
        held = np.fromiter(map(len, cut), np.int64, len(cut))
        whole = _totals(~self.known.spelt[numbers], held) == 0
        return numbers[np.repeat(whole, held)], np.where(whole, held, 0)

    def align(self, texts: list[str]) -> list[Aligned]:
        numbers, held = self._numbers(texts)
        ends = np.cumsum(held)
        return [self._one(numbers[end - n:end]) for n, end in zip(held.tolist(), ends.tolist(), strict=True)]

    def _one(self, numbers: np.ndarray) -> Aligned:
        known = self.known
        (n_a, a), (n_b, b) = known.read("a", numbers), known.read("b", numbers)
        n_group, a_cut = known.read("a_cut", numbers)
        a_cut = a_cut + np.repeat(np.cumsum(n_a) - n_a, n_group)
        b_cut = known.read("b_cut", numbers)[1] + np.repeat(np.cumsum(n_b) - n_b, n_group)
        if not len(a):
            return Aligned(a, b, a_cut, b_cut, a, b)
        return Aligned(a, b, a_cut, b_cut, *expand_links(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_cut, b_cut))

    def summaries(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """Of each text the numbers of A tokens, B tokens, groups and links, and its groups as text; all pair keys of the links."""
        numbers, held = self._numbers(texts)
        sizes = [self.known.sizes[n][numbers] for n in ("a", "b", "a_cut", "key")]
        names = list(map(self.known.texts.__getitem__, numbers.tolist()))
        ends = np.cumsum(held).tolist()
        groups = [";".join(names[end - n:end]) for n, end in zip(held.tolist(), ends, strict=True)]
        return [_totals(x, held) for x in sizes], self.known.read("key", numbers)[1], groups


def _spelt(ids: list[list[int]], names: list[bytes], sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether each list of ids spells its bytes."""
    flat = list(chain.from_iterable(ids))
    spans = _totals(sizes[np.array(flat, np.int64)], np.fromiter(map(len, ids), np.int64, len(ids)))
    # Right as a whole and each of the right length: all are right.
    if np.array_equal(spans, np.fromiter(map(len, raw), np.int64, len(raw))) and (
            b"".join(map(names.__getitem__, flat)) == b"".join(raw)):
        return np.ones(len(raw), bool)
    return np.fromiter((b"".join(map(names.__getitem__, found)) == x for found, x in zip(ids, raw, strict=True)), bool, len(raw))


def groups_text(x: Aligned) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``: decimal ids in order."""
    n_a, n_b = len(x.a), len(x.b)
    order = np.empty(n_a + n_b, np.int64)
    ids = np.concatenate([x.a, x.b])
    sign = np.zeros(n_a + n_b, np.int64)
    a_group = np.repeat(np.arange(len(x.a_cut)), np.diff(x.a_cut, prepend=0))
    b_group = np.repeat(np.arange(len(x.b_cut)), np.diff(x.b_cut, prepend=0))
    sign[x.a_cut - 1] = 1
    sign[n_a + x.b_cut - 1] = 2
    order[np.arange(n_a) + np.concatenate([[0], x.b_cut])[a_group]] = np.arange(n_a)
    order[np.arange(n_b) + x.a_cut[b_group]] = n_a + np.arange(n_b)
    return "".join(map(_SIGNED.__getitem__, (3 * ids + sign)[order].tolist()))[:-1]


class _SignedIds(dict):
    """Text of id and sign by their joint number, made on first use; ids are those of two vocabularies."""

    def __missing__(self, number: int) -> str:
        self[number] = f"{number // 3}{',|;'[number % 3]}"
        return self[number]


_SIGNED = _SignedIds()


@lru_cache(maxsize=1)
def aligner(pair: Pair) -> Aligner:
    """One aligner per worker process and pair of files."""
    return Aligner(pair)


def _columns(df: DataFrame, text: str, added: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    kept = own_names(df, *added)
    others = [c for c in kept.columns if c != text]
    return kept.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")), others


def align(df: DataFrame, pair: Pair, text: str = "text") -> DataFrame:
    """Add ``a_ids``, ``b_ids``, ``a_group_ends``, ``b_group_ends``, ``link_a``, ``link_b`` (arrays). No shuffle."""
    bounded_batches(df.sparkSession)
    added = ("a_ids", "b_ids", "a_group_ends", "b_group_ends", "link_a", "link_b")
    ordered, others = _columns(df, text, added)
    out = T.StructType([*ordered.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in added)])

    def run(batches):
        work = aligner(pair)
        for batch in batches:
            for i, j, group in postings.row_groups(batch.column(len(others))):
                found = work.align(group)
                lists = [pa.array([getattr(x, n).tolist() for x in found], pa.list_(pa.int32()))
                         for n in ("a", "b", "a_cut", "b_cut", "left", "right")]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *lists], names=out.names)

    return ordered.mapInArrow(run, out)


def link_blocks(df: DataFrame, pair: Pair, text: str = "text") -> DataFrame:
    """Blocks of linked id pairs; rows keep all columns but the text, with counts and the digest of the groups."""
    bounded_batches(df.sparkSession)
    ordered, others = _columns(df, text, (*COUNTS, "groups_sha256", "n_best", "count_sum"))
    rows = T.StructType([*ordered.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in COUNTS),
                         T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        work = aligner(pair)
        packer = postings.Packer(BLOCK_BYTES)

        def keys_of(numbers):
            return pa.array(numbers, pa.int64())

        for batch in batches:
            for i, j, group in postings.row_groups(batch.column(len(others))):
                counts, keys, groups = work.summaries(group)
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
                packer.add(pa.StructArray.from_arrays(
                    [*batch.slice(i, j - i).columns[:len(others)], *map(pa.array, counts), pa.array(digests, pa.string())],
                    names=rows.names), counts[-1], keys, sum(map(len, group)))
                if packer.full:
                    yield from packer.block(keys_of)
        yield from packer.block(keys_of)

    return ordered.mapInArrow(run, postings.schema(rows))


def pair_counts(every: DataFrame) -> DataFrame:
    """``key, n, best`` of ``key, total`` rows: links that hold the pair, and that number again where no other pair of
    the B id has more. A B id meets at most the A vocabulary, so its window is bounded."""
    counts = every.groupBy("key").agg(F.sum("total").alias("n"))
    b = F.col("key").bitwiseAND((1 << _B_BITS) - 1)
    most = F.max("n").over(Window.partitionBy(b))
    return counts.withColumn("best", (F.col("n") == most).cast("long"))


def link_sums(df: DataFrame, pair: Pair, text: str = "text") -> DataFrame:
    """All columns but the text, with the counts of tokens, groups and links, the digest of the groups, and over the links
    ``n_best`` (the pair is a most frequent one of its B id) and ``count_sum`` (corpus count of the pair)."""
    def counted(every: DataFrame) -> DataFrame:
        return every.select("block", "place", "key").join(pair_counts(every), "key")

    found = postings.key_sums(link_blocks(df, pair, text), T.LongType(), counted, ["best", "n"])
    return found.withColumnRenamed("best", "n_best").withColumnRenamed("n", "count_sum")
