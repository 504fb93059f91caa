"""Fingerprints and components against brute force."""
import random

import numpy as np
import pytest
import xxhash

from setloom.llm import simhash
from setloom.llm.components import components


def fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes(simhash.LOWER)).split(None) if w]
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        value |= (2 * ones > len(shingles)) << bit
    return value - (1 << 64) if value >> 63 else value


def brute(points, ids, radius=2):
    union = simhash.Union(len(points))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= radius)
    union.link(a, b)
    least = {}
    for label, i in zip(union.label, ids, strict=True):
        least[label] = min(i, least.get(label, i))
    return [least[x] for x in union.label]


def test_fingerprints(spark, documents):
    random.seed(1)
    texts = [" ".join(random.choice(["Ab", "cd", "é", "x1", "yy"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 700)]
    texts += [None, "", " \t\n", "a b c d e"]
    rows = simhash.fingerprint(documents(texts)).orderBy("doc_id").collect()
    assert [r.fp for r in rows] == [fingerprint(t) for t in texts]


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)
    points = np.concatenate([centres, rng.choice(centres, n - len(centres))])
    for _ in range(2):
        points ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(points)


@pytest.mark.parametrize("dense", [False, True])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "SHARD", 60)
    points = clusters(3000, 5)
    if dense:  # a ball that no vantage point can cut
        ball = np.uint64(12345) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
        points = np.unique(np.concatenate([points, ball, *(ball ^ np.uint64(1 << k) for k in range(0, 64, 3))]))
        monkeypatch.setattr(simhash, "DENSE", 1)
    ids = np.arange(100, 100 + len(points))
    nodes = spark.createDataFrame(list(zip(ids.tolist(), points.view(np.int64).tolist(), strict=True)), "id long, fp long")
    root = {r.u: r.v for r in components(simhash.links(nodes)).collect()}
    assert [root.get(i, i) for i in ids.tolist()] == brute(points, ids.tolist())


def test_a_shard_grows_its_own_tree():
    points = clusters(6000, 9)
    assert brute(points, range(len(points))) == simhash.link_shard(points, 2).tolist()
    ball = np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    crowd = np.unique(np.concatenate([ball ^ (np.uint64(1) << np.uint64(k)) ^ np.uint64(j) for k in range(64)
                                      for j in (0, 3)]))
    assert brute(crowd, range(len(crowd))) == simhash.link_shard(crowd, 2).tolist()


def test_long_chains(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 100), (300, 200), (300, 100)], "u long, v long")
    found = {r.u: r.v for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, 200: 100, 300: 100}
    assert components(edges.limit(0)).count() == 0


def test_documents(spark, documents):
    a = " ".join(f"w{k}" for k in range(300))
    texts = [a, None, a + " ", "", a.upper(), "other words here entirely", "  "]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(texts)).collect()}
    assert rows == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 5, 6: 1}
    stay = simhash.drop_near_duplicates(documents(texts).unionAll(documents([a])))
    assert sorted(r.doc_id for r in stay.collect()) == [0, 1, 5]
    nobody = documents([a, "b"]).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")
    assert simhash.drop_near_duplicates(documents([a]).unionAll(nobody)).count() == 3
    assert simhash.near_duplicates(documents([])).count() == 0
