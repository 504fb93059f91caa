"""Quality and toxicity models: held-out accuracy, and their parts against plain versions."""
import itertools

import numpy as np
import pytest

from setloom.llm import quality_model, toxicity, workloads
from setloom.llm.text import Hasher

SF = "/root/testdata/sf0.01"


def test_isotonic():
    assert quality_model.isotonic(np.array([1, 1, 2]), np.array([0.5, 0.1, 0.9])).tolist() == [0.3, 0.3, 0.9]
    assert quality_model.isotonic(np.ones(3), np.array([3.0, 2.0, 1.0])).tolist() == [2, 2, 2]


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    data = np.frombuffer(b"a b c d\n\nb a\nc", np.uint8)
    lines = toxicity.read_lines(data, np.array([0, len(data)]), Hasher())
    assert np.diff(lines.line_at).tolist() == [4, 2, 1]
    terms = [toxicity.Terms(h[:2]) for h in lines.hashes]
    model = toxicity.Model(terms, [rng.normal(size=len(t.sorted)) for t in terms], 0.3, rng.normal(size=(2, 2)))
    emit = model.bias + sum(np.where(i >= 0, w[i], 0) for i, w in zip(model.features(lines), model.weights, strict=True))
    assert (emit != model.bias).any() and (emit == model.bias).any()
    got = toxicity.marginals(model, lines)
    for a, b in itertools.pairwise(lines.line_at):
        weight = {path: np.exp(sum(emit[a + t] for t, y in enumerate(path) if y)
                               + sum(model.moves[x, y] for x, y in itertools.pairwise(path)))
                  for path in itertools.product((0, 1), repeat=b - a)}
        for t in range(b - a):
            want = sum(w for p, w in weight.items() if p[t]) / sum(weight.values())
            assert got[a + t] == pytest.approx(want)
    tags = (rng.random(len(emit)) < 0.5).astype(float)
    slope = toxicity.gradient(model, lines, tags)

    def likelihood(moves):
        out = 0.0
        for a, b in itertools.pairwise(lines.line_at):
            def value(path, a=a):
                return sum(emit[a + t] for t, y in enumerate(path) if y) + sum(
                    moves[int(x), int(y)] for x, y in itertools.pairwise(path))
            out += value(tags[a:b]) - np.log(sum(np.exp(value(p)) for p in itertools.product((0, 1), repeat=b - a)))
        return out

    for i in range(2):
        for j in range(2):
            step = np.zeros((2, 2))
            step[i, j] = 1e-5
            want = (likelihood(model.moves + step) - likelihood(model.moves - step)) / 2e-5
            assert slope[-5 + 2 * i + j] == pytest.approx(want, abs=1e-4)


def test_toxic_spans(spark, documents):
    clean = [f"a quiet line about thing{k} and other{k % 7} matters" for k in range(60)]
    toxic = [f"a quiet line about thing{k} you vile{k % 5}, vilest of all" for k in range(30)]
    labelled = spark.createDataFrame([(t, 0) for t in clean] + [(t, 1) for t in toxic], "text string, toxic int")
    model = toxicity.fit(labelled)
    docs = documents(["ü and vile3, then\npeace", clean[0], None, "", "vile2"]).withColumnRenamed("lang", "Score")
    rows = toxicity.score(docs, model).orderBy("doc_id").collect()
    assert [r.score >= 0.5 for r in rows] == [True, False, False, False, True]
    assert [(s.start, s.end) for s in rows[0].spans] == [(6, 12)] and rows[4].spans[0].end == 5
    assert toxicity.fit(labelled.where("toxic = 0")) is None and toxicity.fit(labelled.limit(0)) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * 5


@pytest.mark.parametrize("query, label, floor", [("op4_quality_model", "quality", 0.95), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, query, label, floor):
    rows = workloads.QUERIES[query](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (held.predicted == held[label]).mean() >= floor


def test_quality_corner_cases(spark, documents):
    docs = documents([None, "", "A word.", "x" * 30_000])
    described = quality_model.describe(docs)
    assert {r.score for r in quality_model.score(described, 0.5).collect()} == {0.5}
    rows = described.selectExpr("features", "cast(doc_id % 2 as double) as quality")
    model = quality_model.fit(rows)
    scores = [r.score for r in quality_model.score(described, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1]
    assert quality_model.fit(rows.limit(0)) == 0.5 and quality_model.fit(rows.where("quality = 1")) == 1.0
