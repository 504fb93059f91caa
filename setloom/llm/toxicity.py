"""Toxic spans by a linear-chain conditional random field over words.

Tags are 0 and 1 for each word; sequences are lines. A word's features are itself and its prefixes of four and six bytes
(lower case, edge punctuation off), known by 64-bit hashes, as far as they were selected. Labels exist for documents only,
so tokens are labelled first: a feature is selected if it is far more frequent, by documents, in toxic than in other
documents and explains at least ``SHARE`` of the toxic documents that features selected before left unexplained (``LEAST``
of all toxic documents, three at least); a word of
a toxic document with a selected feature is a toxic token. Parameters start from the smoothed log-odds of the labelled
tokens and climb the conditional likelihood; each step adds expected and observed counts over partitions. For scores, the
forward and backward passes give the marginal of tag 1 for every word; the score of a document is its greatest marginal,
and runs of words whose marginal is at least one half are its spans (code point offsets into the text).

The model is fitted on at most about ``MAX_DOCS`` labelled documents of each class (distinct texts); every text is scored
whole. Null and empty texts have no words and score the model's floor (0). Without toxic labels every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .decontaminate import Terms
from .sums import partition_sum
from .text import LOWER, Hasher, blocks, bounded_batches, byte_view, own_names, word_bounds

MAX_DOCS = 4000
FIT_PARTITIONS = 8  # the sample is bounded, and so is the number of its partitions
TABLES = 3
STEPS = 8
ROUNDS = 5
SHARE = 0.08
LEAST = 0.01
BLOCK = 1 << 21
SPANS = "array<struct<start: long, end: long>>"

_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


@dataclass
class Model:
    terms: list[Terms]  # selected features of each table
    weights: list[np.ndarray]  # their score of tag 1 over tag 0
    bias: float
    moves: np.ndarray  # (2, 2): score of tag b after tag a
    def features(self, lines: Lines) -> list[np.ndarray]:
        return [t.find(h) for t, h in zip(self.terms, lines.hashes, strict=True)]


@dataclass
class Lines:
    """Words of a block: features, bounds in bytes, and the lines (sequences) and rows they belong to."""

    hashes: list[np.ndarray]  # of each word, for each table of features
    starts: np.ndarray
    ends: np.ndarray
    line_at: np.ndarray  # first word of each line, and the number of words
    row_at: np.ndarray  # first word of each row, and the number of words


def read_lines(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> Lines:
    starts, ends, row_at = word_bounds(data, offsets)
    data = LOWER[data]
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        a += (a < b) & _EDGE[data[np.minimum(a, len(data) - 1)]] if len(data) else 0
        b -= (a < b) & _EDGE[data[b - 1]] if len(data) else 0
    prefix = hasher.prefix(data)
    hashes = [hasher.ranges(prefix, a, np.minimum(b, a + size)) for size in (1 << 40, 4, 6)]
    breaks = np.searchsorted(starts, np.flatnonzero(data == 10))
    line_at = np.unique(np.concatenate([row_at, breaks, [0, len(starts)]]))
    return Lines(hashes, starts, ends, line_at, row_at)


def _log_ratio(moves: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of (mass into tag 1 / mass into tag 0) when the tag before has log-odds x."""
    return np.logaddexp(moves[0, 1], moves[1, 1] + x) - np.logaddexp(moves[0, 0], moves[1, 0] + x)


def log_odds(model: Model, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission scores, and log-odds of tag 1 from what comes before (with the word) and after (without it)."""
    n = len(lines.starts)
    emit = np.full(n, model.bias)
    for ids, weight in zip(model.features(lines), model.weights, strict=True):
        emit += np.append(weight, 0.0)[ids]  # -1: not selected
    sizes = np.diff(lines.line_at)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = lines.line_at[:-1][order], sizes[order]
    ahead, behind = emit.copy(), np.zeros(n)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # lines with more than t words
    for t in range(1, longest):
        at = first[:active[t]] + t
        ahead[at] = emit[at] + _log_ratio(model.moves, ahead[at - 1])
    for t in range(longest - 2, -1, -1):
        at = first[:active[t + 1]] + t
        behind[at] = _log_ratio(model.moves.T, emit[at + 1] + behind[at + 1])
    return emit, ahead, behind


def marginals(model: Model, lines: Lines) -> np.ndarray:
    _, ahead, behind = log_odds(model, lines)
    return 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))


def gradient(model: Model, lines: Lines, tags: np.ndarray) -> np.ndarray:
    """Observed minus expected counts: all weights, bias, the four moves, and the number of words."""
    emit, ahead, behind = log_odds(model, lines)
    p = 1 / (1 + np.exp(-np.clip(ahead + behind, -700, 700)))
    miss = tags - p
    out = [np.bincount(ids + 1, miss, len(w) + 1)[1:] for ids, w in zip(model.features(lines), model.weights, strict=True)]
    inner = np.ones(len(p), bool)
    inner[lines.line_at[:-1][np.diff(lines.line_at) > 0]] = False
    at = np.flatnonzero(inner)
    moves = np.zeros((2, 2))
    if len(at):
        right = emit[at] + behind[at]
        x = ahead[at - 1]
        joint = np.stack([model.moves[0, 0] + 0 * x, model.moves[0, 1] + right,
                          model.moves[1, 0] + x, model.moves[1, 1] + x + right])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        moves = np.bincount(2 * tags[at - 1].astype(int) + tags[at].astype(int), minlength=4).reshape(2, 2) - expected
    return np.concatenate([*out, [miss.sum()], moves.ravel(), [len(p)]])


def _blocks_of(batches, hasher: Hasher):
    for batch in batches:
        data, offsets = byte_view(batch.column("text"))
        for i, j in blocks(data, offsets, BLOCK):
            yield batch, i, j, data[offsets[i]:offsets[j]], read_lines(
                data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], hasher)


def _toxic_rows(batch: pa.RecordBatch, i: int, j: int) -> np.ndarray:
    return batch.column("toxic").to_numpy(zero_copy_only=False)[i:j] == 1


def _hits(lines: Lines, terms: list[Terms]) -> np.ndarray:
    """Words with a selected feature."""
    hit = np.zeros(len(lines.starts), bool)
    for t, h in zip(terms, lines.hashes, strict=True):
        hit |= t.find(h) >= 0
    return hit


def _rows_with(lines: Lines, hit: np.ndarray) -> np.ndarray:
    rows = len(lines.row_at) - 1
    return np.bincount(np.repeat(np.arange(rows), np.diff(lines.row_at)), hit, rows) > 0


def _by_documents(lines: Lines, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a table, and how many of the chosen rows have each."""
    row = np.repeat(np.arange(len(rows)), np.diff(lines.row_at))
    held = rows[row]
    pairs = np.unique(np.stack([lines.hashes[k][held], row[held].astype(np.uint64)]), axis=1)
    return np.unique(pairs[0], return_counts=True)


def _frequent(labelled: DataFrame, terms: list[Terms]) -> tuple[float, float, list[tuple[int, int, int]]]:
    """Toxic documents, those without a selected feature, and the features (table, hash, documents) frequent in these."""
    def totals(batches):
        hasher, total = Hasher(), np.zeros(2)
        for batch, i, j, _, lines in _blocks_of(batches, hasher):
            toxic = _toxic_rows(batch, i, j)
            total += [toxic.sum(), (toxic & ~_rows_with(lines, _hits(lines, terms))).sum()]
        return total

    def count(batches):
        hasher = Hasher()
        for batch, i, j, _, lines in _blocks_of(batches, hasher):
            rows = _toxic_rows(batch, i, j) & ~_rows_with(lines, _hits(lines, terms))
            for k in range(TABLES):
                hashes, n = _by_documents(lines, rows, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), k, np.int32)), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["k", "h", "n"])

    summed = partition_sum(labelled, totals)
    toxic, left = (0.0, 0.0) if summed is None else summed
    if not left:
        return toxic, left, []
    counted = labelled.mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    # Each explains a share of the documents, so their number is bounded by the features of a document over the share.
    return toxic, left, [tuple(r) for r in counted.where(F.col("n") >= max(3.0, SHARE * left, LEAST * toxic)).collect()]


def select_features(labelled: DataFrame) -> list[Terms] | None:
    """Features that tell toxic documents, table by table. None without toxic documents."""
    chosen: list[set[int]] = [set() for _ in range(TABLES)]
    for _ in range(ROUNDS):
        terms = _terms(chosen)
        toxic, left, frequent = _frequent(labelled, terms)
        if not toxic:
            return None
        if not frequent:
            break
        asked = _terms([{h for k, h, _ in frequent if k == table} for table in range(TABLES)])

        def others(batches, asked=asked):
            hasher, total = Hasher(), np.zeros(1 + sum(len(t.sorted) for t in asked))
            for batch, i, j, _, lines in _blocks_of(batches, hasher):
                rows, at = ~_toxic_rows(batch, i, j), 1
                total[0] += rows.sum()
                for k, t in enumerate(asked):
                    hashes, n = _by_documents(lines, rows, k)
                    ids = t.find(hashes)
                    total[at:at + len(t.sorted)] += np.bincount(ids + 1, n, len(t.sorted) + 1)[1:]
                    at += len(t.sorted)
            return total

        clean = partition_sum(labelled, others)
        held, at = {}, 1
        for k, t in enumerate(asked):
            held |= {(k, h): clean[at + m] for m, h in enumerate(t.sorted.view(np.int64).tolist())}
            at += len(t.sorted)
        found = False
        for k, h, n in frequent:
            odds = np.log((n + 0.5) / (left + 1)) - np.log((held[k, h] + 0.5) / (clean[0] + 1))
            if odds >= 3:
                chosen[k].add(h)
                found = True
        if not found:
            break
    return _terms(chosen)


def _terms(chosen: list[set[int]]) -> list[Terms]:
    return [Terms(np.array(sorted(x), np.int64).view(np.uint64)) for x in chosen]


def fit(labelled: DataFrame) -> Model | None:
    """A model from ``text, toxic`` rows, already bounded by the caller. None where no feature tells toxic rows."""
    terms = select_features(labelled)
    if terms is None or not any(len(t.sorted) for t in terms):
        return None
    sizes = [len(t.sorted) for t in terms]

    def tags_of(lines: Lines, toxic: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(toxic)), np.diff(lines.row_at))
        return (_hits(lines, terms) & toxic[row]).astype(np.float64)

    def tokens(batches):
        """Tokens of either tag, in all and by feature."""
        hasher, total = Hasher(), np.zeros((2, 1 + sum(sizes)))
        for batch, i, j, _, lines in _blocks_of(batches, hasher):
            tags = tags_of(lines, _toxic_rows(batch, i, j))
            for y, weight in ((0, 1 - tags), (1, tags)):
                total[y] += np.concatenate([[weight.sum()], *(
                    np.bincount(t.find(h) + 1, weight, n + 1)[1:] for t, h, n in zip(terms, lines.hashes, sizes, strict=True))])
        return total

    seen = partition_sum(labelled, tokens)
    zeros, ones = seen[:, 0]
    share = ones / (ones + zeros)
    prior = np.log((ones + 1) / (zeros + 1))
    start = (np.log((seen[1, 1:] + share) / (seen[0, 1:] + 1 - share)) - prior) / TABLES * 2
    cuts = np.cumsum(sizes)[:-1]
    model = Model(terms, np.split(start, cuts), float(prior), np.zeros((2, 2)))
    for _ in range(STEPS):
        def climb(batches, now=model):
            hasher, total = Hasher(), np.zeros(sum(sizes) + 6)
            for batch, i, j, _, lines in _blocks_of(batches, hasher):
                total += gradient(now, lines, tags_of(lines, _toxic_rows(batch, i, j)))
            return total

        slope = partition_sum(labelled, climb)
        # Each weight moves by its own count: a step of at most two, however frequent the feature.
        move = 2 * slope[:-6] / (seen[:, 1:].sum(axis=0) + 5)
        model = Model(terms, np.split(np.concatenate(model.weights) + move, cuts), model.bias + float(slope[-6] / slope[-1]),
                      model.moves + slope[-5:-1].reshape(2, 2) / slope[-1])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``score`` and ``spans`` to each row."""
    bounded_batches(docs.sparkSession)
    kept = own_names(docs, "score", "spans")
    names = kept.columns
    place = names.index(text)

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            data, offsets = byte_view(batch.column(place))
            best, spans, counts = [np.zeros(0)], [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
            for i, j in blocks(data, offsets, BLOCK):
                part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                if model is None:
                    best.append(np.zeros(j - i))
                    counts.append(np.zeros(j - i, np.int64))
                    continue
                lines = read_lines(part, at, hasher)
                p = marginals(model, lines)
                top, filled = np.zeros(j - i), np.flatnonzero(np.diff(lines.row_at))
                if len(filled):
                    top[filled] = np.maximum.reduceat(p, lines.row_at[filled])
                best.append(top)
                found, per_row = _spans(lines, p >= 0.5, part, at)
                spans.append(found)
                counts.append(per_row)
            bounds = np.concatenate(spans)
            structs = pa.StructArray.from_arrays([pa.array(bounds[:, 0]), pa.array(bounds[:, 1])], names=["start", "end"])
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(best)), pa.ListArray.from_arrays(pa.array(ends), structs)],
                names=[*names, "score", "spans"])

    out = kept.withColumns({"score": F.lit(0.0), "spans": F.array().cast(SPANS)}).schema
    return kept.mapInArrow(run, out)


def _spans(lines: Lines, hot: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point bounds of the runs of marked words inside a line, and their number per row."""
    new_line = np.zeros(len(hot) + 1, bool)
    new_line[lines.line_at] = True
    before = np.concatenate([[False], hot[:-1]]) if len(hot) else hot
    after = np.concatenate([hot[1:], [False]]) if len(hot) else hot
    first = np.flatnonzero(hot & (~before | new_line[:-1]))
    last = np.flatnonzero(hot & (~after | new_line[1:]))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.searchsorted(lines.row_at, first, "right") - 1
    base = points[offsets[row]]
    bounds = np.stack([points[lines.starts[first]] - base, points[lines.ends[last]] - base], axis=1)
    return bounds, np.bincount(row, minlength=len(offsets) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The distinct texts of at most about ``max_docs`` labelled documents of each class, chosen by the hash of the id.

    Labels are chosen first, so what is broadcast has about ``2 * max_docs`` short rows and no text moves before that.
    """
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull())
    keep = F.lit(False)
    for value, n in known.groupBy("toxic").count().collect():
        limit = int(min(1.0, max_docs / n) * (1 << 30))
        keep = keep | ((F.col("toxic") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit))
    both = docs.select("doc_id", "text").join(F.broadcast(known.where(keep)), "doc_id")
    chosen = both.groupBy(F.xxhash64("text"), "toxic").agg(F.first("text").alias("text"))
    return cut_lineage(chosen.select("text", "toxic").repartition(FIT_PARTITIONS))
