"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives ``FEATURES`` statistics. They are standardised by the training rows' moments and mapped by random cosines
(a fixed seed) that approximate a Gaussian kernel; ridge weights solve normal equations that are summed over partitions,
so every labelled training row counts. Raw scores of the training rows are binned, and the pool-adjacent-violators rule
over the bins gives the monotone map to probabilities.

Null and empty texts have all counts zero and are scored like any other text. Without training rows, or with one class
alone, every score is the share of label 1 (one half without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sums import partition_sum
from .text import LOWER, Hasher, blocks, bounded_batches, byte_view, own_names, word_bounds

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "shouts", "bars", "high_bytes",
    "line_words", "closed_lines", "repeated_lines", "same_as_before", "distinct_words", "capital_words", "lone_words",
    "symbol_ends",
)
DIMENSIONS = 256
RIDGE = 1e-3
BINS = 1000
SEED = 7


def _member(chars: str) -> np.ndarray:
    held = np.zeros(256, bool)
    held[[ord(c) for c in chars]] = True
    return held


_UPPER, _DIGIT = _member("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _member("0123456789")
_SYMBOL, _MARK = _member("#*$%&|<>@^~=+_{}[]\\"), _member(".,;:?!")
_CLOSE = _member(".!?:;\"')")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """How many different hashes each row has."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=rows).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a block."""
    rows = len(offsets) - 1
    starts, ends, upto = word_bounds(data, offsets)
    n_bytes, n_words = np.diff(offsets).astype(np.float64), np.diff(upto).astype(np.float64)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
    word_row = np.repeat(np.arange(rows), np.diff(upto))

    def share(held: np.ndarray) -> np.ndarray:
        return _per_row(held, offsets) * per_byte

    def of_words(held: np.ndarray) -> np.ndarray:
        return np.bincount(word_row, held, rows) * per_word

    prefix = hasher.prefix(LOWER[data])
    hashes = hasher.ranges(prefix, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    first, last = data[starts], data[ends - 1]

    # Lines with a word: where they begin and end, in words.
    feeds = np.searchsorted(starts, np.flatnonzero(data == 10))
    cuts = np.unique(np.concatenate([upto, feeds, [0, len(starts)]]))
    a, b = cuts[:-1], cuts[1:]
    line_row = word_row[a] if len(a) else np.zeros(0, np.int64)
    n_lines = np.bincount(line_row, minlength=rows).astype(np.float64)
    per_line = 1 / np.maximum(n_lines, 1)
    line_hash = hasher.ranges(prefix, starts[a], ends[b - 1])
    closed = np.bincount(line_row, _CLOSE[last[b - 1]], rows)
    return np.stack([
        np.log1p(n_bytes), np.log1p(n_words), np.bincount(word_row, ends - starts, rows) * per_word,
        share(_UPPER[data]), share(_DIGIT[data]), share(_SYMBOL[data]), share(_MARK[data]), share(data == 33),
        share(data == 124), share(data >= 128), np.log1p(n_words * per_line), closed * per_line,
        (n_lines - _distinct(line_row, line_hash, rows)) * per_line, of_words(same),
        _distinct(word_row, hashes, rows) * per_word, of_words(_UPPER[first]), of_words(ends - starts == 1),
        of_words(_SYMBOL[last]),
    ], axis=1)


def describe(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Add the statistics of each text as an array of doubles."""
    bounded_batches(docs.sparkSession)
    kept = own_names(docs, out)
    names = kept.columns
    place = names.index(text)

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            data, offsets = byte_view(batch.column(place))
            found = [np.zeros((0, len(FEATURES)))]
            for i, j in blocks(data, offsets):
                found.append(statistics(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], hasher))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(np.concatenate(found))], names=[*names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.array().cast("array<double>")).schema)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # raw scores and their probabilities
    levels: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.waves + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / DIMENSIONS), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.cuts, self.levels), 0.0, 1.0)


def isotonic(counts: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least-squares fit: neighbours that fall are pooled."""
    blocks_: list[list[float]] = []
    for n, m in zip(counts, means, strict=True):
        blocks_.append([n, m, 1])
        while len(blocks_) > 1 and blocks_[-2][1] >= blocks_[-1][1]:
            n2, m2, k2 = blocks_.pop()
            n1, m1, k1 = blocks_.pop()
            blocks_.append([n1 + n2, (n1 * m1 + n2 * m2) / (n1 + n2), k1 + k2])
    return np.concatenate([np.full(int(k), m) for _, m, k in blocks_])


def fit(training: DataFrame) -> Model | float:
    """A model from ``features, quality`` rows; a constant where there is nothing to learn from."""
    width = len(FEATURES)

    def moments(batches):
        total = np.zeros((2 * width + 2))
        for batch in batches:
            x, y = _matrix(batch.column("features")), batch.column("quality").to_numpy(zero_copy_only=False)
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x), y.sum()]])
        return total

    sums = partition_sum(training, moments)
    if sums is None or sums[-2] == 0:
        return 0.5
    n, ones = sums[-2], sums[-1]
    if ones in (0, n):
        return float(ones / n)
    mean = sums[:width] / n
    scale = np.sqrt(np.maximum(sums[width:2 * width] / n - mean ** 2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(size=(width, DIMENSIONS)) / np.sqrt(width),
                  rng.uniform(0, 2 * np.pi, DIMENSIONS), np.zeros(DIMENSIONS + 1), np.zeros(0), np.zeros(0))

    def normal(batches):
        total = np.zeros((DIMENSIONS + 1, DIMENSIONS + 2))
        for batch in batches:
            z, y = model.map(_matrix(batch.column("features"))), batch.column("quality").to_numpy(zero_copy_only=False)
            total += np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1)
        return total

    system = partition_sum(training, normal)
    left = system[:, :-1] + np.diag(np.append(np.full(DIMENSIONS, RIDGE * n / DIMENSIONS), 0.0))
    model.weights = np.linalg.solve(left + 1e-9 * n * np.eye(len(left)), system[:, -1])

    def binned(batches):
        total = np.zeros((3, BINS))
        for batch in batches:
            raw, y = model.raw(_matrix(batch.column("features"))), batch.column("quality").to_numpy(zero_copy_only=False)
            place = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total += np.stack([np.bincount(place, weights, BINS) for weights in (np.ones(len(raw)), y, raw)])
        return total

    counts, positive, raws = partition_sum(training, binned)
    held = np.flatnonzero(counts)
    model.cuts = raws[held] / counts[held]
    model.levels = isotonic(counts[held], positive[held] / counts[held])
    return model


def score(described: DataFrame, model: Model | float) -> DataFrame:
    """Add ``score`` to rows with ``features``."""
    kept = own_names(described, "score")
    if not isinstance(model, Model):
        return kept.withColumn("score", F.lit(float(model)))
    names = kept.columns

    def run(batches):
        for batch in batches:
            found = model.score(_matrix(batch.column(names.index("features"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*names, "score"])

    return kept.mapInArrow(run, kept.withColumn("score", F.lit(0.0)).schema)


def described_once(docs: DataFrame, text: str = "text") -> DataFrame:
    """The statistics of all texts, kept so that fitting and scoring read each text once."""
    return cut_lineage(describe(docs, text).drop(text))
