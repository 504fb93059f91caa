"""The manifest against trees built node by node."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.llm import merkle, workloads


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[k:k + 2]) for k in range(0, len(below), 2)])
    return levels


def siblings(levels, i):
    found = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            found.append(level[i ^ 1])
        i >>= 1
    return found


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda row: sha(*map(field, row))
    trees = {}
    for row in rows:
        trees.setdefault("" if row[2] is None else "+" + row[2], []).append(row)
    for tree in trees.values():
        tree.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(trees, key=str.encode)
    levels = {name: levels_of(map(leaf, trees[name])) for name in names}
    top = levels_of([levels[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            proof = siblings(levels[name], i) + siblings(top, k)
            out.append((row[0], leaf(row), levels[name][-1][0], top[-1][0], sha(*proof)))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    random.seed(seed)
    rows = [(random.randrange(n), random.choice(["a", None]), random.choice(langs), random.choice([None, k]),
             random.choice([None, "", "é" * 3, f"text {k}"])) for k in range(n)]
    return rows + rows[:3] + [(None, None, None, None, None)] * 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


def proved(spark, rows):
    docs = frame(spark, rows)
    leaf = merkle.leaf_digest(*[F.col(c) for c in workloads.MANIFEST_FIELDS])
    return merkle.manifest(docs.withColumn("leaf", leaf)).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof")))


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_equals_trees_built_node_by_node(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = rows_of(70, ["en", "de", None, "ü", "zz"])
    got = proved(spark, rows).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof.digest", ""), 256).alias("p"), "folded").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert all(r.folded == r.root for r in got)


def test_one_leaf_and_none(spark):
    (row,) = proved(spark, [(5, None, "en", 1, "x")]).collect()
    assert row.leaf == row.subroot == row.root == row.folded and row.proof == [] and row.leaf_index == 0
    assert proved(spark, []).count() == 0


def test_every_change_of_a_row_shows(spark):
    rows = rows_of(20, ["en", "de"])
    docs = proved(spark, rows)
    altered = docs.withColumn("altered", merkle.leaf_digest(
        F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    for r in altered.withColumn("back", merkle.fold(F.col("altered"), F.col("proof"))).collect():
        assert (r.back == r.root) == (r.n_chars is None)


def test_octopus_asks_for_the_least():
    for n in (1, 2, 3, 7, 8, 13):
        for seed in range(20):
            random.seed(seed)
            known = sorted(random.sample(range(n), random.randint(1, n)))
            asked = merkle.octopus(np.array(known), n)
            held, size, level, needed = set(known), n, 0, []
            while size > 1:
                needed += [(level, i) for i in sorted({k ^ 1 for k in held} - held) if i < size]
                held, size, level = {k >> 1 for k in held}, (size + 1) // 2, level + 1
            assert asked == needed
    assert merkle.octopus(np.arange(9), 9) == []


def test_other_columns_pass_and_clashes_are_replaced(spark):
    docs = frame(spark, rows_of(9, ["en"])).withColumn("Proof", F.lit(1)).withColumn("tree", F.lit("mine")).withColumn(
        "index", F.lit(7)).withColumn("leaf", F.sha2(F.lit("x"), 256))
    out = merkle.manifest(docs)
    assert {(r.tree, r["index"]) for r in out.collect()} == {("mine", 7)} and "Proof" not in out.columns


def test_query(spark, tmp_path):
    rows = rows_of(40, ["en", "de", None])
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib
    got = workloads.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=str) == brute(rows)
    chars = {r[1]: row[3] for row in rows for r in brute([row])}
    for r in got:
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and chars[r.leaf] is not None
        assert r.verified == (not bad) == (r.folded_root == r.root)
