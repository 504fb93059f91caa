"""Best-fit-decreasing against a plain version, and the laws of shards."""
import random

import pytest

from setloom.llm import sharding


def plain(items, capacity):
    bins = []
    for size in sorted(items, reverse=True):
        fit = [k for k, left in enumerate(bins) if left >= size]
        k = min(fit, key=lambda b: (bins[b], b)) if fit else len(bins)
        if not fit:
            bins.append(capacity)
        bins[k] -= size
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_packing_by_classes_is_packing_by_items(seed):
    rng = random.Random(seed)
    items = [rng.choice([1, 2, 3, 7, 11, 19, 30, 44]) for _ in range(200)]
    classes = [(s, items.count(s)) for s in set(items)]
    left = {}
    for size, number, n in sharding.pack(classes, 50):
        left[number] = left.get(number, 50) - size * n
    assert sorted(left.values()) == plain(items, 50)
    assert all(v >= 0 for v in left.values())


def test_sizes_above_the_capacity_are_an_error():
    with pytest.raises(ValueError):
        sharding.pack([(9, 1)], 8)


def test_large_groups_stand_alone():
    plan = sharding.pack_into([(100, 1), (5, 40)], 4)
    load = {}
    for size, number, n in plan:
        load[number] = load.get(number, 0) + size * n
    assert sorted(load.values()) == [60, 70, 70, 100] and sum(n for *_, n in plan) == 41


def test_size_classes(spark):
    sizes = [1, 4096, 4097, 100_003, 123_456_789, (1 << 40) + 5]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    import pyspark.sql.functions as F
    for s, c in df.select("s", sharding.size_class(F.col("s"))).collect():
        assert s <= c <= s * 1.0005 and (c == s or s > 4096)


def test_documents(spark, documents):
    rng = random.Random(2)
    texts = ["a" * rng.randrange(400) for _ in range(300)] + ["copy of this"] * 150 + [None, "", "ü" * 9]
    docs = documents(texts).withColumnRenamed("lang", "SIZE")
    rows = sharding.shard(docs, shards=4).toPandas()
    assert len(rows) == len(texts) and set(rows["shard"]) == {0, 1, 2, 3}
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    load = rows.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.02 * load.max()
    by_text = rows.assign(text=[texts[i] or "" for i in rows["doc_id"]])
    assert (by_text.groupby("text")["shard"].nunique() == 1).all()
    assert (by_text["size"] == by_text["text"].map(lambda t: len(t.encode()) + 1)).all()
    assert sharding.shard(documents([]), shards=4).count() == 0
    fixed = sharding.shard(docs, capacity=4000).toPandas()
    assert fixed.groupby("shard")["size"].sum().max() <= 4000
