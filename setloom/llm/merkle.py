"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, and an inclusion proof of every row.

A node is the lowercase hex SHA-256 of its children's digests, joined as text; of two consecutive nodes each, the last one
alone if their number is odd, until one is left. A lone leaf is its own root. Rows of a group are leaves in ascending order
(nulls first, equal ones by digest); groups follow each other by name, null first, bytewise.

Leaves are ranked by a range sort over all groups, so that a group may be any share of the table. A leaf partition is an
aligned run of ``1 << BITS`` leaves. It computes the least union of node coordinates that its proofs lack (``octopus``:
level by level the siblings that are neither held nor derivable), which are joined to the stored nodes once; the nodes
inside follow from its leaves, are shared, and each row's proof is read off locally. Upper levels are built from the tops of
the partitions in the same runs, so there are few rounds at any size; only nodes above the partitions are ever stored.

Repeated rows are leaves of their own; null ids come first; an empty table gives no rows. Input columns named like the
added ones are replaced, others pass through whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .text import own_names

BITS = 12
ADDED = ("leaf_index", "subroot", "root", "proof")
ALONE, LEFT, RIGHT = 0, 1, 2  # where the sibling of a proof step stands

_STEP = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("digest", T.StringType())])
_NODES = "tree string, n long, chunk long, wanted boolean, level int, index long, digest string"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: F.sha2(
        F.when(step["side"] == LEFT, F.concat(step["digest"], at)).when(
            step["side"] == RIGHT, F.concat(at, step["digest"])).otherwise(at), 256))


def octopus(known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) of the fewest nodes from which, with the known leaves of ``n``, all proofs follow."""
    missing, level = [], 0
    known = np.unique(known)
    while n > 1:
        beside = known ^ 1
        lacking = np.setdiff1d(beside[beside < n], known, assume_unique=True)
        missing += [(level, int(i)) for i in lacking]
        known, n, level = np.unique(known >> 1), (n + 1) >> 1, level + 1
    return missing


def _parent(left: str, right: str | None = None) -> str:
    return hashlib.sha256((left + (right or "")).encode()).hexdigest()


def _nodes_at(level: int) -> Column:
    """How many nodes a tree of ``n`` leaves has on a level."""
    return F.shiftright(F.col("n") + F.lit((1 << level) - 1), level)


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``index`` (from 0, inside ``tree``) and ``n`` (leaves of the tree). One range sort; no group in one task."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = ["tree", *order, "_tie"]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    # Kept, as range bounds come from a sample: places must not change when a task runs again.
    ranged = cut_lineage(ranged.select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("tree")
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select("tree", "_part", F.sum("_n").over(whole).alias("n"),
                       (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"))
    placed = ranged.join(runs, ["tree", "_part"])
    return placed.withColumn("index", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _raise(base: int):
    """Groups of ``1 << BITS`` nodes of level ``base`` to their top, with the nodes below it (levels from ``base`` on, where
    these are above the leaves), and for leaves the coordinates that their proofs lack."""

    def run(table: pa.Table) -> pa.Table:
        index = table.column("index").to_numpy()
        order = np.argsort(index)
        first = int(index[order[0]])
        digests = [table.column("digest")[i].as_py() for i in order.tolist()]
        tree, n, chunk = (table.column(c)[0].as_py() for c in ("tree", "n", "chunk"))
        level, size = base, -(-n // (1 << base))
        rows = []
        while size > 1 and level < base + BITS:
            if base:
                rows += [(False, level, first + k, d) for k, d in enumerate(digests)]
            digests = [_parent(*digests[k:k + 2]) for k in range(0, len(digests), 2)]
            level, size, first = level + 1, (size + 1) >> 1, first >> 1
        rows.append((False, level, first, digests[0]))
        if not base:
            rows += [(True, at, i, None) for at, i in octopus(index, n)]
        wanted, levels, places, values = zip(*rows, strict=True)
        m = len(rows)
        return pa.table({"tree": [tree] * m, "n": pa.array([n] * m, pa.int64()), "chunk": pa.array([chunk] * m, pa.int64()),
                         "wanted": list(wanted), "level": pa.array(levels, pa.int32()),
                         "index": pa.array(places, pa.int64()), "digest": pa.array(values, pa.string())})

    return run


def forest(placed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``tree, n, index, digest`` leaves: the partitions' tops and wanted coordinates, all nodes above the partitions,
    and ``tree, digest`` of the roots."""

    def chunks(nodes: DataFrame) -> DataFrame:
        return nodes.select("tree", "n", F.shiftright("index", BITS).alias("chunk"), "index", "digest").groupBy("tree", "chunk")

    lowest = cut_lineage(chunks(placed).applyInArrow(_raise(0), _NODES))
    stored = lowest.where(~F.col("wanted"))
    largest = stored.agg(F.max("n")).first()[0] or 0
    tops, base = stored, BITS
    while largest > 1 << base:
        rising = tops.where((F.col("level") == base) & (_nodes_at(base) > 1))
        made = cut_lineage(chunks(rising).applyInArrow(_raise(base), _NODES))
        # The nodes of a finished round come again as the base of this one.
        stored = stored.where(~((F.col("level") == base) & (_nodes_at(base) > 1))).unionAll(made)
        tops, base = made, base + BITS
    at_top = F.expr("shiftright(n + shiftleft(1L, level) - 1, level)") == 1
    return lowest, stored, stored.where(at_top).select("tree", "digest")


def expand(placed: DataFrame, lowest: DataFrame, stored: DataFrame, trunks: DataFrame) -> DataFrame:
    """Per leaf ``row, leaf_index, subroot, root, proof``. ``trunks``: ``tree, subroot, root, trunk`` of every tree."""
    wanted = lowest.where("wanted").select("tree", "chunk", "level", "index")
    nothing = F.lit(None)
    fetched = wanted.join(stored.select("tree", "level", "index", "digest"), ["tree", "level", "index"]).select(
        "tree", "chunk", "level", "index", "digest", nothing.cast("string").alias("root"),
        nothing.cast(T.ArrayType(_STEP)).alias("trunk"))
    upward = lowest.where(~F.col("wanted")).select("tree", "chunk").join(trunks, "tree").select(
        "tree", "chunk", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("index"),
        F.col("subroot").alias("digest"), "root", "trunk")
    nodes = fetched.unionAll(upward)
    leaves = placed.select("tree", F.shiftright("index", BITS).alias("chunk"), "n", "index", "digest", "row")
    step = pa.struct([("side", pa.int32()), ("digest", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.array(np.argsort(left.column("index").to_numpy())))
        index = left.column("index").to_pylist()
        size = left.column("n")[0].as_py()
        held: list[dict[int, str]] = [{} for _ in range(65)]
        for level, i, digest, root, trunk in zip(*(right.column(c).to_pylist() for c in (
                "level", "index", "digest", "root", "trunk")), strict=True):
            if level >= 0:
                held[level][i] = digest
            else:
                subroot, top, upper = digest, root, trunk
        held[0].update(zip(index, left.column("digest").to_pylist(), strict=True))
        steps, own, level = [], sorted(set(index)), 0
        while size > 1:
            nodes = held[level]
            steps.append({i: (ALONE, "") if (i ^ 1) >= size else (LEFT if i & 1 else RIGHT, nodes[i ^ 1]) for i in own})
            level, size = level + 1, (size + 1) >> 1
            own = sorted({i >> 1 for i in own})
            held[level].update((i, _parent(nodes[2 * i], nodes.get(2 * i + 1))) for i in own)
        upper = [(s["side"], s["digest"]) for s in upper]
        proofs = [pair for i in index for pair in (*(at[i >> k] for k, at in enumerate(steps)), *upper)]
        sides, digests = ([], []) if not proofs else zip(*proofs, strict=True)
        ends = np.arange(len(index) + 1) * (len(steps) + len(upper))
        values = pa.StructArray.from_arrays([pa.array(sides, pa.int32()), pa.array(digests, pa.string())], fields=list(step))
        return pa.table({
            "row": left.column("row"), "leaf_index": pa.array(index, pa.int64()),
            "subroot": pa.array([subroot] * len(index), pa.string()), "root": pa.array([top] * len(index), pa.string()),
            "proof": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)})

    out = T.StructType([placed.schema["row"], T.StructField("leaf_index", T.LongType()), T.StructField("subroot", T.StringType()),
                        T.StructField("root", T.StringType()), T.StructField("proof", T.ArrayType(_STEP))])
    return leaves.groupBy("tree", "chunk").cogroup(nodes.groupBy("tree", "chunk")).applyInArrow(run, out)


def manifest(df: DataFrame, leaf: str = "leaf", group: str = "lang", order: str = "doc_id") -> DataFrame:
    """Add ``leaf_index``, ``subroot``, ``root`` and ``proof`` (steps from the leaf to the root: side and digest of the
    sibling, ``ALONE`` where there is none) to rows that hold their leaf digest."""
    kept = own_names(df, *ADDED)
    whole = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    # An absent name sorts before every present one.
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = cut_lineage(kept.select(name.alias("tree"), F.col(f"`{order}`").alias("ord"),
                                     F.col(f"`{leaf}`").alias("digest"), whole.alias("row")))
    placed = positions(leaves, ["ord", "digest"])
    lowest, stored, roots = forest(placed)
    names = positions(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    names = names.withColumn("row", F.struct("name"))
    low, upper, root = forest(names)
    nothing = F.array().cast(T.ArrayType(_STEP))
    top = root.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), nothing.alias("trunk"))
    trunks = expand(names, low, upper, top).select(F.col("row.name").alias("tree"), "root", F.col("proof").alias("trunk"))
    trunks = cut_lineage(trunks.join(roots.withColumnRenamed("digest", "subroot"), "tree"))
    return expand(placed, lowest, stored, trunks).select("row.*", *ADDED)
