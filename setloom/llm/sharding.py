"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

A group is all rows with equal text; its size is the sum over its rows of the UTF-8 bytes plus one. Groups are placed
from the largest to the smallest, each into the shard with the least remaining capacity that still holds it.

Groups of one size class follow each other in that order, so the shard chosen for the first takes more of the class
until it cannot hold another: the plan needs the number of groups per class only, not the groups. Classes are exact
sizes up to ``EXACT`` and steps of less than 0.05 % above (sizes count as the upper end of their step), so that there are
fewer than 100 000 classes whatever the data. The driver packs classes through a balanced search tree of remaining
capacities; Spark numbers the groups inside a class and looks up the shard of each.

Capacity starts at the mean and rises by small steps until ``shards`` shards hold everything. A group larger than the
mean takes a shard of its own, and the others share what is left. Null texts count as empty (size one, CRC zero). Rows
that repeat are all placed. An empty table gives no rows. Slots run from 0 without gaps inside a shard, in no given order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import own_names

EXACT = 1 << 12
GROUPS_A_PART = 20_000


def size_class(size: Column) -> Column:
    """The size itself up to ``EXACT``; above, rounded up to a multiple of 2 ** k that keeps twelve binary digits."""
    digits = F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") - 11)
    step = F.pow(F.lit(2.0), digits).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step).cast("long") * step)


class Treap:
    """Balanced search tree of (remaining, bin) pairs; priorities come from the bin number, so shapes do not vary."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _node(key, left=None, right=None):
        return (key, (key[1] * 0x9E3779B1 + 12345) * 0x85EBCA6B & 0xFFFFFFFF, left, right)

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            return (t[0], t[1], t[2], a), b
        a, b = self._split(t[2], key)
        return a, (t[0], t[1], b, t[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], self._join(a[3], b))
        return (b[0], b[1], self._join(a, b[2]), b[3])

    def add(self, remaining: int, number: int) -> None:
        key = (remaining, number)
        a, b = self._split(self.root, key)
        self.root = self._join(self._join(a, self._node(key)), b)

    def take_tightest(self, size: int):
        """Remove and return the pair with the least remaining that is at least ``size``; None if there is none."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        least = b
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(b, (least[0][0], least[0][1] + 1))
        self.root = self._join(a, rest)
        return least[0]


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best-fit-decreasing over ``(size, number of groups)``: ``(size, bin, number)`` rows, in order of filling.

    Bins are opened as needed; None if more than ``most`` would be. A size above the capacity is an error.
    """
    tree, bins, plan = Treap(), 0, []
    for size, number in sorted(classes, reverse=True):
        if size > capacity:
            raise ValueError("a group is larger than the capacity")
        while number:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            fits = min(number, found[0] // size)
            plan.append((size, found[1], fits))
            number -= fits
            tree.add(found[0] - fits * size, found[1])
    return plan


def pack_into(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """A plan for exactly ``shards`` bins: groups above the mean of what is left go alone, the rest by ``pack``."""
    left = [[size, n] for size, n in sorted(classes, reverse=True)]
    total, plan, used = sum(s * n for s, n in left), [], 0
    while left and used < shards - 1 and left[0][0] * (shards - used) > total:
        plan.append((left[0][0], used, 1))
        total -= left[0][0]
        used += 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    if not left:
        return plan
    rest = [(s, n) for s, n in left]
    mean = -(-total // (shards - used))
    slack = 1e-5
    found = pack(rest, max(mean, left[0][0]), shards - used)
    while found is None:
        found = pack(rest, max(int(mean * (1 + slack)) + 1, left[0][0]), shards - used)
        slack *= 2
    return plan + [(size, number + used, n) for size, number, n in found]


def shard(df: DataFrame, shards: int | None = None, capacity: int | None = None, text: str = "text") -> DataFrame:
    """All rows with ``size``, ``text_crc32``, ``shard`` and ``slot``; the text itself does not move.

    Give either the number of shards, or a capacity in bytes (then as few shards as the packing needs are used).
    """
    spark = df.sparkSession
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = own_names(df, text, "size", "text_crc32", "shard", "slot", "_group")
    rows = df.select(*[F.col(f"`{c}`") for c in kept.columns], (F.octet_length(value) + 1).cast("long").alias("size"),
                     F.crc32(value).cast("long").alias("text_crc32"), F.unhex(F.sha2(value.cast("binary"), 256)).alias("_group"))
    rows = cut_lineage(rows)
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes")).withColumn("_class", size_class(F.col("_bytes")))
    counted = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"))
    classes = [(r[0], r[1]) for r in counted.collect()]
    plan = pack_into(classes, shards) if shards else pack(classes, capacity)
    parts = max(1, sum(n for _, n in classes) // GROUPS_A_PART)
    steps, taken = [], {}
    for size, number, n in plan or []:
        steps.append((size, number, taken.get(size, 0), taken.get(size, 0) + n))
        taken[size] = taken.get(size, 0) + n
    lookup = spark.createDataFrame(steps, "_class long, shard int, _from long, _to long")

    # Number the groups of a class without gathering it: count in parts, then number inside each part.
    part = F.pmod(F.xxhash64("_group"), F.lit(parts))
    numbered = _numbered(groups.withColumn("_part", part), ["_class"], "_group", "_rank")
    placed = numbered.join(lookup, (numbered["_class"] == lookup["_class"]) & (F.col("_rank") >= F.col("_from"))
                           & (F.col("_rank") < F.col("_to"))).select("_group", "shard")
    found = rows.join(placed, "_group")
    row_parts = F.pmod(F.xxhash64("_group", F.monotonically_increasing_id()), F.lit(max(16, parts)))
    return _numbered(cut_lineage(found.withColumn("_part", row_parts)), ["shard"], "_part", "slot").drop("_group")


def _numbered(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Number rows from 0 within ``keys``, part by part: ``_part`` is dropped."""
    sizes = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1)
    return local.join(before, [*keys, "_part"]).withColumn(
        out, (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("long")).drop("_before", "_local", "_part")
