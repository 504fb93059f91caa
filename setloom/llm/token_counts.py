"""Tokens of texts under a tokenizer file, counted once per distinct pre-token.

Texts are cut into pre-tokens by the library's own rules. The pieces of a distinct pre-token are counted once in the whole
corpus; the counts meet the pre-token frequencies of each document (``postings``) and are summed there. Token ids are never
made. Strings of special tokens inside a text count as the one token they are, as the library does by default; neither
begin nor end tokens are added, and nothing is cut off or padded.

Null texts count as empty: no bytes, no tokens. Every input row gives one row, repeated rows and null ids included; long
texts are read whole; an empty table gives no rows. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from . import postings
from .bpe import Runs, _totals
from .text import bounded_batches, own_names

BLOCK_BYTES = 16 << 20
KNOWN = 300_000  # stretches that are remembered; pre-tokens of a block are at most twice as many
_STRETCH = regex.compile(r"\s*\S+|\s+").findall


class Splitter:
    """Texts to numbers of pre-tokens, for one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        added = told["added_tokens"]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("special tokens must be plain strings, matched before normalisation")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        # No pre-token of the byte-level pattern runs from a non-space into white space, and none looks back.
        kind = told["pre_tokenizer"] or {}
        self.apart = told["normalizer"] is None and kind.get("type") == "ByteLevel" and kind["use_regex"] and (
            not kind["add_prefix_space"])
        self.forget()

    def forget(self) -> None:
        self.stretches, self.names = Runs(), {}

    @property
    def heavy(self) -> bool:
        return len(self.names) > 2 * KNOWN

    def _pre_tokens(self, stretch: str) -> list[str]:
        tok = self.tokenizer
        if tok.normalizer is not None:
            stretch = tok.normalizer.normalize_str(stretch)
        if tok.pre_tokenizer is None:
            return [stretch] if stretch else []
        return [name for name, _ in tok.pre_tokenizer.pre_tokenize_str(stretch)]

    def _learn(self, new: list[str]) -> None:
        sizes, values = [], []
        for stretch in new:
            found = self._pre_tokens(stretch)
            sizes.append(len(found))
            values += [self.names.setdefault(name, len(self.names)) for name in found]
        self.stretches.add(new, np.array(sizes, np.int64), np.array(values, np.int32))

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of each text, their numbers, and the special tokens of each text."""
        special = np.zeros(len(texts), np.int64)
        cut = []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                special[i] = len(parts) - 1
            cut.append([s for part in parts for s in (_STRETCH(part) if self.apart else [part] if part else [])])
        every = [s for stretches in cut for s in stretches]
        if len(self.stretches.number) > KNOWN:
            self.stretches.clear()
        self._learn(list(set(every).difference(self.stretches.number)))
        each, numbers = self.stretches.read(self.stretches.numbers(every, len(every)))
        return _totals(each, np.fromiter(map(len, cut), np.int64, len(cut))), numbers.astype(np.int64), special


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    """One splitter per worker process and file."""
    return Splitter(path)


def pre_token_blocks(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Blocks of pre-token frequencies; rows keep all columns but the text, with ``n_bytes`` and ``n_special``."""
    bounded_batches(df.sparkSession)
    kept = own_names(df, "n_bytes", "n_special", "n_tokens")
    others = [c for c in kept.columns if c != text]
    rows = T.StructType([*kept.select(*[F.col(f"`{c}`") for c in others]).schema.fields,
                         T.StructField("n_bytes", T.LongType()), T.StructField("n_special", T.LongType())])

    def run(batches):
        work = splitter(path)
        work.forget()
        packer = postings.Packer(BLOCK_BYTES)

        def keys_of(numbers):
            names = list(work.names)
            return pa.array([names[i] for i in numbers.tolist()], pa.string())

        for batch in batches:
            for i, j, group in postings.row_groups(batch.column(len(others))):
                sizes, numbers, special = work.split(group)
                n_bytes = np.fromiter((len(t.encode()) for t in group), np.int64, len(group))
                part = batch.slice(i, j - i)
                packer.add(pa.StructArray.from_arrays(
                    [*part.columns[:len(others)], pa.array(n_bytes), pa.array(special)], names=rows.names),
                    sizes, numbers, int(n_bytes.sum()))
                if packer.full or work.heavy:
                    yield from packer.block(keys_of)
                    work.forget()
        yield from packer.block(keys_of)
        work.forget()  # idle workers keep nothing

    ordered = kept.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    return ordered.mapInArrow(run, postings.schema(rows))


def count_pieces(every: DataFrame, path: str) -> DataFrame:
    """``block, place, pieces`` of ``block, place, key`` rows: in how many tokens the library cuts the pre-token.

    Equal pre-tokens of all blocks meet in one sorted run, whose first row counts them. A pre-token is in a block once, so
    a run is no longer than the number of blocks, and it streams.
    """

    def run(batches):
        model = splitter(path).tokenizer.model
        last, last_pieces = None, 0
        for batch in batches:
            pieces = np.empty(batch.num_rows, np.int64)
            for i, name in enumerate(batch.column(2).to_pylist()):
                if name != last:
                    last, last_pieces = name, len(model.tokenize(name))
                pieces[i] = last_pieces
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pieces)], names=["block", "place", "pieces"])

    runs = every.select("block", "place", "key").repartition("key").sortWithinPartitions("key")
    return runs.mapInArrow(run, "block long, place int, pieces long")


def count_tokens(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    blocks = pre_token_blocks(df, path, text)
    found = postings.key_sums(blocks, T.StringType(), lambda every: count_pieces(every, path), ["pieces"])
    return found.withColumn("n_tokens", F.col("n_special") + F.col("pieces")).drop("n_special", "pieces")
