"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words that overlap by half; for items under ``SHORT`` words, whose own words would drown
in these, windows of the item's length at every word, in passes of their own that other benchmarks do not need. Their TF-IDF vectors live on the benchmark's words; other
words count in the length of a vector only, with the weight of the benchmark's median word. Three passes read the texts:

1. document frequencies of the benchmark's words over the passages of all documents;
2. passages with enough weight on benchmark words to reach the cosine at all (an upper bound, so nothing is lost by it)
   become sparse rows; each distinct one of them and the benchmark's own windows give a
   randomised SVD: a random start, then products with the matrix and its transpose summed over partitions, an
   orthonormal basis on the driver, and once more;
3. every such passage of every text is projected and compared with the projected benchmark windows; where the latent
   cosine and then the full one reach ``cosine``, the words around the passage are aligned with the item by their
   longest common subsequence.

A text leaks an item if the subsequence has at least ``sure`` of the item's words, or at least ``lcs`` of them and
``sure`` of its answer (its last sentence): paraphrases must still give the answer away. Every text is searched whole.

The benchmark is searched in blocks of at most ``MAX_ITEMS`` items of at most ``MAX_WORDS`` words (longer items in
pieces), so what is sent to tasks is bounded: some 30 000 words times ``RANK`` numbers. Null or empty texts and items
under ``MIN_WORDS`` words match nothing. Repeated rows are all marked; an item id on several rows is searched for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sums import partition_sum
from .text import Hasher, blocks, bounded_batches, byte_view, own_names, word_hashes

WINDOW = 16
RANK = 64
SPARE = 16
MAX_ITEMS = 500
MAX_WORDS = 400
MIN_WORDS = 5
SHORT = 10  # items of fewer words are searched in windows of their own length
LEAKS = "array<struct<item_id: long, cosine: double, lcs: double, answer: double>>"


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]
    width: int = WINDOW  # words of the windows it is searched in


class Terms:
    """Index of the benchmark's words by hash: a coarse filter, then a sorted lookup."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self._may = np.zeros(1 << 16, bool)
        self._may[self.sorted >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self._may[hashes >> np.uint64(48)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        out[at[hit]] = place[hit]
        return out


def read_items(benchmark: DataFrame, item_id: str, text: str) -> list[Item]:
    hasher, items = Hasher(), []
    for number, body in benchmark.select(F.col(item_id).cast("long"), text).collect():
        raw = (body or "").encode()
        sentences = [s for s in (body or "").replace("?", ".").replace("!", ".").split(".") if len(s.split()) >= 3]
        words, answer = (_hash_words(x, hasher) for x in (raw, (sentences[-1] if sentences else "").encode()))
        width = len(words) if len(words) < SHORT else WINDOW
        for at in range(0, max(len(words), 1), MAX_WORDS):
            piece = words[at:at + MAX_WORDS]
            if len(piece) >= MIN_WORDS:
                last = at + MAX_WORDS >= len(words)
                items.append(Item(number, piece, answer if last and answer else piece[-len(piece) // 4:], width))
    return items


def _hash_words(raw: bytes, hasher: Hasher) -> list[int]:
    data = np.frombuffer(raw, np.uint8)
    return word_hashes(data, np.array([0, len(data)]), hasher)[0].tolist()


def windows(upto: np.ndarray, stride: int = WINDOW // 2, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the windows of each row; the last window may be short, never empty."""
    sizes = np.diff(upto)
    count = np.where(sizes > 0, np.maximum(-(-(sizes - (width - stride)) // stride), 1), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = upto[row] + number * stride
    return row, first, np.minimum(first + width, upto[row + 1])


def grid(ids: np.ndarray, first: np.ndarray, end: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Word ids of the windows as rows of a matrix; -1 where there is none."""
    at = first[:, None] + np.arange(width)
    return np.where(at < end[:, None], ids[np.minimum(at, len(ids) - 1)], -1)


def _word_class(ids: np.ndarray) -> np.ndarray:
    """One of 64 classes of each word id."""
    return ids.astype(np.uint64) & np.uint64(63)


class Own:
    """The benchmark's windows: word ids, lengths, the classes of their words, and how often the most frequent word occurs."""

    def __init__(self, rows: np.ndarray, space: Space):
        self.rows, self.length = rows, space.length(rows)
        bits = np.where(rows >= 0, np.uint64(1) << _word_class(rows), np.uint64(0))
        self.holds = np.bitwise_or.reduce(bits, axis=1)
        self.most = np.zeros(len(rows), np.int64)
        for k in range(rows.shape[1]):
            self.most = np.maximum(self.most, (rows == rows[:, k:k + 1]).sum(axis=1) * (rows[:, k] >= 0))


@dataclass
class Space:
    terms: Terms
    weights: np.ndarray  # of each benchmark word
    other: float  # of any other word
    width: int = WINDOW  # words of a window

    def cut(self, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of texts: half-overlapping, short ones one at each word."""
        return windows(upto, WINDOW // 2 if self.width == WINDOW else 1, self.width)

    def heavy(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, cosine: float) -> np.ndarray:
        """Windows whose share of weight on benchmark words does not rule the cosine out."""
        known = ids >= 0
        square = np.where(known, self.weights[np.maximum(ids, 0)] ** 2, 0.0)
        inside = np.concatenate([[0.0], np.cumsum(square)])
        unknown = np.concatenate([[0], np.cumsum(~known)])
        a = inside[end] - inside[first]
        b = (unknown[end] - unknown[first]) * self.other ** 2
        return np.flatnonzero((a > 0) & (a >= cosine ** 2 * (a + b)))

    def project(self, rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Weighted sums of basis rows for windows given as word ids."""
        held = np.maximum(rows, 0)
        weight = np.where(rows >= 0, self.weights[held], 0.0).astype(np.float32)
        return np.einsum("nw,nwk->nk", weight, basis[held], optimize=False)

    def near(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, own: Own,
             cosine: float) -> np.ndarray:
        """Pairs of a window ``a`` and a benchmark window ``b`` that reach the cosine in the full space.

        A bit for each of 64 classes of words tells what a benchmark window may hold; words that it may hold, each as often
        as its most frequent one, bound the product from above. Only pairs that the bound lets pass are compared by word.
        """
        rows = grid(ids, first, end, self.width)
        known = rows >= 0
        square = np.where(known, self.weights[np.maximum(rows, 0)], 0.0) ** 2
        norm = np.sqrt(square.sum(axis=1) + (end - first - known.sum(axis=1)) * self.other ** 2) + 1e-12
        out = []
        for k in range(0, len(a), 4000):
            left, right = a[k:k + 4000], b[k:k + 4000]
            need = cosine * norm[left] * own.length[right]
            may = (own.holds[right][:, None] >> _word_class(rows[left])) & np.uint64(1)
            bound = np.einsum("nw,nw->n", may.astype(np.float64), square[left]) * own.most[right]
            at = np.flatnonzero(bound >= need * (1 - 1e-9))
            left, right = left[at], right[at]
            same = (rows[left][:, :, None] == own.rows[right][:, None, :]).sum(axis=2)
            out.append(k + at[(same * square[left]).sum(axis=1) / (norm[left] * own.length[right]) >= cosine])
        return np.concatenate([np.zeros(0, np.int64), *out])

    def length(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt((np.where(rows >= 0, self.weights[np.maximum(rows, 0)], 0.0) ** 2).sum(axis=1)) + 1e-12


def word_places(item: list[int]) -> dict[int, int]:
    """The places of each word as bits."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    return places


def lcs(item: list[int], words: list[int], places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit vectors; ``places`` if the item's are known."""
    places = word_places(item) if places is None else places
    full = (1 << len(item)) - 1
    row = full
    for met in filter(None, map(places.get, words)):
        kept = row & met
        row = ((row + kept) | (row - kept)) & full
    return len(item) - row.bit_count()


def _text_blocks(batches, place: int, hasher: Hasher, limit: int = 1 << 20):
    for batch in batches:
        data, offsets = byte_view(batch.column(place))
        for i, j in blocks(data, offsets, limit):
            yield batch, i, j, *word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], hasher)


def weigh(texts: DataFrame, terms: Terms, width: int = WINDOW) -> Space:
    """Inverse document frequencies over the half-overlapping passages of all texts."""
    def count(batches):
        hasher, total = Hasher(), np.zeros(len(terms.sorted) + 1)
        for _, _, _, hashes, upto in _text_blocks(batches, 0, hasher):
            ids = terms.find(hashes)
            row = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
            # Each word falls into one tumbling passage; two neighbours of those make a window.
            passage = np.cumsum((np.arange(len(ids)) - upto[row]) % (WINDOW // 2) == 0)
            held = np.flatnonzero(ids >= 0)
            pairs = np.unique((passage[held] << 32) | ids[held])
            total[:-1] += np.bincount(pairs & 0xFFFFFFFF, minlength=len(terms.sorted))
            total[-1] += passage[-1] if len(passage) else 0
        return total

    counts = partition_sum(texts, count)
    counts = np.zeros(len(terms.sorted) + 1) if counts is None else counts
    weights = np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1
    return Space(terms, weights, float(np.median(weights)), width)


def basis_of(passages: DataFrame, own: np.ndarray, space: Space) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages: ``RANK`` columns over the benchmark's words."""
    n = len(space.weights)

    def product(rows: np.ndarray, q: np.ndarray, total: np.ndarray) -> None:
        for k in range(0, len(rows), 200):  # what is gathered at once stays near the core
            part = rows[k:k + 200]
            unit = 1 / space.length(part)
            y = space.project(part, q) * (unit ** 2)[:, None]
            held = part >= 0
            window, _ = np.nonzero(held)
            ids = part[held]
            order = np.argsort(ids, kind="stable")
            at = np.flatnonzero(np.diff(ids[order], prepend=-1))
            if len(at):
                total[ids[order][at]] += np.add.reduceat(
                    y[window[order]] * space.weights[ids[order]][:, None], at, axis=0)

    def gram(q: np.ndarray) -> np.ndarray:
        def partial(batches):
            total = np.zeros((n, q.shape[1]))
            for batch in batches:
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, space.width)
                product(rows, q, total)
            return total

        total = partition_sum(passages, partial)
        total = np.zeros((n, q.shape[1])) if total is None else total
        product(own, q, total)
        return total

    width = min(RANK + SPARE, n)
    q = np.random.default_rng(11).normal(size=(n, width)).astype(np.float32)
    q = np.linalg.qr(gram(q))[0].astype(np.float32)
    z = gram(q)
    small = q.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def heavy_passages(texts: DataFrame, space: Space, cosine: float) -> DataFrame:
    """All distinct passages that may reach the cosine, as word ids."""
    def run(batches):
        hasher = Hasher()
        for _, _, _, hashes, upto in _text_blocks(batches, 0, hasher):
            ids = space.terms.find(hashes)
            _, first, end = space.cut(upto)
            at = space.heavy(ids, first, end, cosine)
            rows = grid(ids, first[at], end[at], space.width) if len(at) else np.zeros((0, space.width), np.int32)
            if len(rows):
                rows = np.unique(rows, axis=0)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                    pa.array(np.arange(len(rows) + 1, dtype=np.int32) * space.width), pa.array(rows.ravel().astype(np.int32)))],
                    names=["ids"])

    return texts.mapInArrow(run, "ids array<int>").distinct()


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         cosine: float = 0.6, lcs_share: float = 0.6, sure: float = 0.8, out: str = "leaks") -> DataFrame:
    """All rows, with the items that each text leaks in ``out``."""
    kept = own_names(docs, out)
    n = benchmark.count()
    found = kept.withColumn(out, F.array().cast(LEAKS))
    cuts = -(-n // MAX_ITEMS)
    for k in range(cuts):
        part = benchmark if cuts == 1 else benchmark.where(
            F.pmod(F.xxhash64(item_id, item_text), F.lit(cuts)) == k)
        items = read_items(part, item_id, item_text)
        for width in sorted({x.width for x in items}, reverse=True):
            found = _mark_block(found, kept.select(text), [x for x in items if x.width == width], width, text, cosine, lcs_share, sure, out)
    return found


def _mark_block(docs: DataFrame, texts: DataFrame, items: list[Item], width: int, text: str, cosine: float, share: float,
                sure: float, out: str) -> DataFrame:
    """``docs`` with the leaks of these items added. ``texts``: the same texts before any marking, which passes need not repeat."""
    bounded_batches(docs.sparkSession)
    space = weigh(texts, Terms(np.concatenate([np.array(x.words, np.uint64) for x in items])), width)
    ids = space.terms.find(np.concatenate([np.array(x.words, np.uint64) for x in items]))
    upto = np.concatenate([[0], np.cumsum([len(x.words) for x in items])])
    owner, first, end = windows(upto, 4, width)
    own = grid(ids, first, end, width)
    basis = basis_of(cut_lineage(heavy_passages(texts, space, cosine)), own, space)
    known_own, known_places = Own(own, space), [word_places(x.words) for x in items]
    target = space.project(own, basis)
    target = (target / (np.linalg.norm(target, axis=1, keepdims=True) + 1e-12)).T.astype(np.float32)
    names = docs.columns
    place, before = names.index(text), names.index(out)

    def candidates(hashes: np.ndarray, upto: np.ndarray):
        """Row, item, cosine and first word of the passages near an item; the nearest first."""
        ids = space.terms.find(hashes)
        row, first, end = space.cut(upto)
        heavy = space.heavy(ids, first, end, cosine)
        for k in range(0, len(heavy), 2000):
            at = heavy[k:k + 2000]
            vectors = space.project(grid(ids, first[at], end[at], width), basis)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12
            near = vectors @ target
            a, b = np.nonzero(near >= cosine)
            held = space.near(ids, first[at], end[at], a, b, known_own, cosine)
            a, b = a[held], b[held]
            yield from zip(row[at[a]].tolist(), owner[b].tolist(), near[a, b].tolist(), first[at[a]].tolist(), strict=True)

    def leaks_of(hashes: np.ndarray, upto: np.ndarray) -> dict[int, dict[int, tuple]]:
        found: dict[int, dict[int, tuple]] = {}
        tried: set[tuple[int, int, int]] = set()
        for row, number, near, at in sorted(candidates(hashes, upto), key=lambda x: -x[2]):
            known = found.setdefault(row, {})
            if number in known or (row, number, at) in tried:
                continue
            tried.add((row, number, at))
            item = items[number]
            size = len(item.words)
            around = hashes[max(int(upto[row]), at - size):min(int(upto[row + 1]), at + width + size)].tolist()
            held = lcs(item.words, around, known_places[number]) / size
            if held >= share:
                answer = lcs(item.answer, around) / len(item.answer)
                if held >= sure or answer >= sure:
                    known[number] = (item.item_id, near, held, answer)
        return found

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            data, offsets = byte_view(batch.column(place))
            leaks = [list(x or ()) for x in batch.column(before).to_pylist()]
            for i, j in blocks(data, offsets):
                part = word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], hasher)
                for row, known in leaks_of(*part).items():
                    leaks[i + row] += [dict(zip(("item_id", "cosine", "lcs", "answer"), x, strict=True))
                                       for x in known.values()]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), *((x, pa.float64()) for x in ("cosine", "lcs", "answer"))]))
            columns = list(batch.columns)
            columns[before] = pa.array(leaks, kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each leak: the columns of ``docs`` without the text, and ``item_id, cosine, lcs, answer``."""
    marked = mark(docs, benchmark, **options)
    text = options.get("text", "text")
    names = [F.col(f"`{c}`") for c in own_names(docs, text, "item_id", "cosine", "lcs", "answer", "leaks").columns]
    return marked.select(*names, F.explode("leaks").alias("_leak")).select(
        *names, "_leak.item_id", "_leak.cosine", "_leak.lcs", "_leak.answer")
