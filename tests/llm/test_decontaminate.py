"""Leaks against exact search, paraphrases, and corner cases."""
import random

import numpy as np
from setloom.llm import decontaminate, workloads

SF = "/root/testdata/sf0.01"


def normal(text):
    return " " + " ".join(w.strip(".,").lower() for w in (text or "").split()) + " "


def test_finds_every_verbatim_item(spark):
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: normal(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    found = workloads.op2_decontamination(spark, SF).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert want and want <= got and len(got - want) <= 0.1 * len(got) + 2
    assert all(r.lcs >= 0.6 for r in found)


def test_paraphrases_and_decoys(spark, documents):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprstvw" for b in ("ano", "eri", "ulo", "ima", "oke", "ust")]
    common = "the of and to in is it for on with".split()
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) + str(rng.randrange(40))
                      for _ in range(n)]
    items = [text(40) for _ in range(20)]
    near = items[3].copy()
    for k in (4, 9, 17, 22, 26):
        near[k] = "changed"
    texts = [" ".join(text(200) + items[k] + text(150)) for k in range(3)]
    texts += [" ".join(text(100) + near + text(100)), " ".join(text(60) + items[5][:9] + text(60)), " ".join(text(300)),
              None, "", "the of and to in is it for on with " * 40, " ".join(items[7])]
    bench = spark.createDataFrame([(k, " ".join(x) + ".") for k, x in enumerate(items)] + [(99, None), (98, ""), (97, "two words")],
                                  "item_id long, text string")
    docs = documents(texts).withColumnRenamed("lang", "Leaks")
    rows = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert rows == {(0, 0), (1, 1), (2, 2), (3, 3), (9, 7)}
    assert decontaminate.find_leaks(documents([]), bench).count() == 0
    assert decontaminate.mark(docs, bench.limit(0)).count() == len(texts)


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 90)).tolist() for _ in range(2))
        assert decontaminate.lcs(a, b) == plain(a, b)


def test_the_fit_takes_every_passage(spark, documents):
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(60)])
    texts = [" ".join(words[rng.integers(0, 60, 20_000)]) for _ in range(100)]
    hashes = np.array(decontaminate._hash_words(" ".join(words).encode(), decontaminate.Hasher()), np.uint64)
    docs = documents(texts).select("text")
    space = decontaminate.weigh(docs, decontaminate.Terms(hashes))
    _, first, _ = decontaminate.windows(np.array([0, 20_000]))
    # No two windows of these texts are equal.
    assert decontaminate.heavy_passages(docs, space, 0.6).count() == len(first) * len(texts) > 200_000


def test_bounded_pairs_reach_the_cosine():
    rng = np.random.default_rng(4)
    space = decontaminate.Space(decontaminate.Terms(np.arange(200, dtype=np.uint64)), rng.random(200) + 0.1, 0.4)
    ids = np.where(rng.random(4000) < 0.2, -1, rng.integers(0, 40, 4000)).astype(np.int32)
    _, first, end = decontaminate.windows(np.array([0, 1500, 1505, 4000]))
    rows = np.where(rng.random((60, 16)) < 0.1, -1, rng.integers(0, 200, (60, 16)))
    rows[:30] %= 40
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(first)), np.arange(60), indexing="ij"))
    want = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        words = ids[first[i]:end[i]].tolist()
        dot = sum(space.weights[w] ** 2 * rows[j].tolist().count(w) for w in words if w >= 0)
        norm = sum(space.weights[w] ** 2 if w >= 0 else 0.16 for w in words) ** 0.5
        if dot >= 0.3 * norm * sum(space.weights[w] ** 2 for w in rows[j].tolist() if w >= 0) ** 0.5:
            want.append(k)
    got = space.near(ids, first, end, a, b, decontaminate.Own(rows, space), 0.3)
    assert want and len(want) < len(a) / 2 and got.tolist() == want


def test_short_items_are_found_between_other_words(spark):
    """Items of five to nine words, verbatim amid long texts of other words; an item of the usual length beside them."""
    random.seed(8)
    pool = [f"w{k}" for k in range(3000)]
    bench = [(n * 10 + k, " ".join(random.sample(pool, n))) for n in (5, 6, 7, 9, 20) for k in range(6)]
    texts = []
    for item, text in bench:
        around = [random.choice(pool) for _ in range(60)]
        texts.append((item, " ".join(around[:25]) + " " + text + " " + " ".join(around[25:])))
    texts += [(1000 + k, " ".join(random.choice(pool) for _ in range(60))) for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {(item, item) for item, _ in bench}
