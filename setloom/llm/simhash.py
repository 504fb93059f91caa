"""SimHash near-duplicates through vantage-point trees.

Fingerprints of 64 bits link when they differ in ``radius`` (2) bits or fewer. If two differ by at most two bits, they
differ by at most one in one half, so one tree is grown over each half, with radius one there. Each inner node of a tree
has a vantage point and a distance: fingerprints nearer than it go inside, the others outside. By the triangle bound only
those just outside can link to something inside, so they are also sent there, as guests; guests descend into every branch
that the bound leaves open. A shard (leaf) therefore sees all links of its own fingerprints, and compares them exactly
on all 64 bits; large shards grow the tree further inside their task.

Trees are grown on the driver over a bounded sample (``SAMPLE`` fingerprints); all fingerprints are routed and compared.
Shards that hold far more than their share (a cluster too dense for any vantage point) are linked by an exact way
without pairs: two fingerprints within two bits have a one-bit change in common, so each is keyed by itself and its 64
one-bit changes, and the holders of a key (65 at most) link to the least of them.

Equal fingerprints are one vertex, however many documents have them. Texts without words (empty, null) have fingerprint
zero, linked like any other. Rows with the same id count as one document. Rows without an id get a fingerprint, and the
component of their fingerprint if some row with an id has it, else null. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .text import LOWER, blocks, bounded_batches, byte_view, own_names, word_bounds

SEED = 42
SAMPLE = 20_000
SHARD = 600
DENSE = 6
HALVES = (np.uint64(0x00000000FFFFFFFF), np.uint64(0xFFFFFFFF00000000))
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Fingerprint of each row of a byte buffer: the majority bits of the XXH64 of its word shingles."""
    data = LOWER[data]
    starts, ends, upto = word_bounds(data, offsets)
    n_words = np.diff(upto)
    out = np.zeros(len(n_words), np.uint64)
    if not len(starts):
        return out
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    joined = np.full(int(sizes.sum()), 32, np.uint8)  # every word and one space
    joined[np.repeat(at - starts, sizes - 1) + _ranges(starts, sizes - 1)] = data[_ranges(starts, sizes - 1)]
    per_row = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    ends_of = np.cumsum(per_row)
    first = _ranges(upto[:-1], per_row)
    last = np.minimum(first + shingle - 1, np.repeat(upto[1:] - 1, per_row))
    raw = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at + sizes - 1)[last].tolist(), strict=True)),
        np.uint64, len(first))
    # Eight one-byte counters in a word: sums of up to 255 hashes at once, then wide sums per row.
    pieces = -(-per_row // 255)
    piece_row = np.repeat(np.arange(len(per_row)), pieces)
    piece_no = np.arange(len(piece_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    piece_at = (ends_of - per_row)[piece_row] + 255 * piece_no
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], piece_at, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.flatnonzero(piece_no == 0), axis=0)
    filled = np.flatnonzero(per_row)
    bits = counts * 2 > per_row[filled][:, None]
    out[filled] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def fingerprint(df: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """Add the fingerprint of each text as a long."""
    bounded_batches(df.sparkSession)
    kept = own_names(df, out)
    names = kept.columns
    place = names.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(place))
            found = [np.zeros(0, np.uint64)]
            for i, j in blocks(data, offsets):
                found.append(fingerprints_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shingle))
            values = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.lit(0).cast("long")).schema)


@dataclass
class Split:
    vantage: np.uint64
    distance: int
    inside: object
    outside: object


def _distance(x: np.ndarray, y: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ y) & mask).astype(np.int16)


def choose(points: np.ndarray, mask: np.uint64, radius: int, seed: int = 0) -> tuple[np.uint64, int] | None:
    """Vantage point and distance with the fewest points near the border; None where most points would be on both sides."""
    tries = np.random.default_rng(seed).choice(points, min(12, len(points)), replace=False)
    best = None
    for v in tries:
        upto = np.cumsum(np.bincount(_distance(points, v, mask), minlength=66)) / len(points)
        for d in np.flatnonzero((upto >= 0.3) & (upto <= 0.7)):
            border = upto[min(d + radius, 65)] - (upto[d - radius] if d >= radius else 0.0)
            if best is None or border < best[0]:
                best = (border, v, int(d))
    return None if best is None or best[0] > 0.6 else best[1:]


def grow(sample: np.ndarray, mask: np.uint64, radius: int, weight: float, leaf: list[int]) -> object:
    """A tree of splits over a sample; leaves are numbers. ``weight``: fingerprints that a sampled one stands for."""
    split = choose(sample, mask, radius, len(leaf)) if len(sample) * weight > SHARD and len(sample) >= 16 else None
    if split is None:
        leaf.append(len(sample))
        return len(leaf) - 1
    inner = _distance(sample, split[0], mask) <= split[1]
    return Split(*split, grow(sample[inner], mask, radius, weight, leaf), grow(sample[~inner], mask, radius, weight, leaf))


def branches(d: np.ndarray, split_at: int, native: np.ndarray, radius: int):
    """For each side: which rows go there, and whether they are at home there."""
    inner = d <= split_at
    go_in = np.where(native, d <= split_at + radius, d <= split_at + radius)
    go_out = np.where(native, ~inner, d > split_at - radius)
    return (go_in, native & inner), (go_out, native & ~inner)


def route(tree: object, points: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers and rows, each row at home once and a guest where the triangle bound cannot exclude a link."""
    leaves, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, native = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, Split):
            leaves.append(np.full(len(at), node, np.int32))
            rows.append(at)
            continue
        sides = branches(_distance(points[at], node.vantage, mask), node.distance, native, radius)
        for child, (go, home) in zip((node.inside, node.outside), sides, strict=True):
            todo.append((child, at[go], home[go]))
    return np.concatenate(leaves), np.concatenate(rows)


class Union:
    """Labels of a few thousand vertices; the label is the least index."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = self.label[self.label]
                if (jumped == self.label).all():
                    break
                self.label = jumped


def link_shard(points: np.ndarray, radius: int) -> np.ndarray:
    """Label of each fingerprint of a shard: the least index it is linked to."""
    union, everything = Union(len(points)), np.uint64(0xFFFFFFFFFFFFFFFF)
    todo = [(np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, native = todo.pop()
        home = at[native]
        if not len(home):
            continue
        split = choose(points[home], everything, radius, len(at)) if len(at) > 1500 else None
        if split is not None:
            sides = branches(_distance(points[at], split[0], everything), split[1], native, radius)
            todo += [(at[go], stays[go]) for go, stays in sides]
        elif len(at) > 4000 and radius <= 2:
            keys = np.concatenate([points[at], *(points[at] ^ np.uint64(1 << k) for k in range(64))])
            order = np.argsort(keys, kind="stable")
            same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
            union.link(at[order[same] % len(at)], at[order[same + 1] % len(at)])
        else:
            for k in range(0, len(home), 256):
                a, b = np.nonzero(np.bitwise_count(points[home[k:k + 256], None] ^ points[at]) <= radius)
                union.link(home[k + a], at[b])
    return union.label


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v``: links between the ids of ``id, fp`` rows with distinct fingerprints, enough for the components."""
    spark = nodes.sparkSession
    bounded_batches(spark, 10_000)
    total = nodes.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sampled = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp")
    sample = np.array(sorted(r[0] for r in sampled.collect()), np.int64).view(np.uint64)
    part = radius // len(HALVES)
    trees, base = [], 0
    for mask in HALVES:
        leaf: list[int] = []
        trees.append((grow(sample, mask, part, 1 / share, leaf), mask, base))
        base += len(leaf)

    def send(batches):
        for batch in batches:
            ids = batch.column(0)
            points = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree, mask, first in trees:
                shard, rows = route(tree, points, mask, part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard + first, pa.int32()), ids.take(pa.array(rows)), batch.column(1).take(pa.array(rows))],
                    names=["shard", "id", "fp"])

    routed = nodes.select("id", "fp").mapInArrow(send, "shard int, id long, fp long")
    sizes = routed.groupBy("shard").count().collect()  # a number for each leaf of two trees over a bounded sample
    typical = max(SHARD, sum(r[1] for r in sizes) / max(len(sizes), 1))
    dense = [r[0] for r in sizes if r[1] > DENSE * typical]

    def compare(key, shard):
        ids, points = shard["id"].to_numpy(), shard["fp"].to_numpy().view(np.uint64)
        order = np.argsort(ids)
        ids, points = ids[order], points[order]
        label = link_shard(points, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": ids[linked], "v": ids[label[linked]]})

    found = routed.where(~F.col("shard").isin(dense)) if dense else routed
    edges = found.groupBy("shard").applyInArrow(compare, "u long, v long")
    if dense:
        crowded = routed.where(F.col("shard").isin(dense)).select("id", "fp").distinct()
        keyed = crowded.select("id", F.explode(F.array(
            "fp", *[F.col("fp").bitwiseXOR(F.lit(1).cast("long") * F.lit((1 << k) - (1 << 64 if k == 63 else 0)))
                    for k in range(64)])).alias("key"))
        least = keyed.groupBy("key").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
        edges = edges.unionAll(keyed.join(least, "key").where("id <> v").select(F.col("id").alias("u"), "v"))
    return edges


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """``id_column, fp, component_id``: for each row its fingerprint and the least id it is linked to, itself included."""
    marked = cut_lineage(fingerprint(docs.select(id_column, text), text, shingle).select(id_column, "fp"))
    nodes = cut_lineage(marked.where(F.col(id_column).isNotNull()).groupBy("fp").agg(F.min(id_column).alias("id")))
    roots = components(links(nodes, radius))
    named = nodes.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "fp", F.coalesce("root", "id").alias("component_id"))
    return marked.join(named, "fp", "left").select(id_column, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3,
                         radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, one for each id; rows without an id all stay."""
    found = near_duplicates(docs, id_column, text, shingle, radius)
    least = found.where(F.col(id_column) == F.col("component_id")).select(id_column).distinct()
    one = Window.partitionBy(id_column).orderBy(F.xxhash64(text))
    stay = docs.join(least, id_column, "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return stay.select(*docs.columns).unionAll(docs.where(F.col(id_column).isNull()))
