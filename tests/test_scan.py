import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.operators import scan


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and many ties."""
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 10 else f"g{i % 7}", i, float(np.round(rng.normal(), 1))) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, id long, v double").cache()


def as_dict(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_sliced_scan_equals_plain_window(skewed):
    order = [-F.col("v"), F.col("id")]
    sums = {"run": F.lit(2) * F.col("id")}
    plain = scan.ordered_scan(skewed, ["k"], order, "r", sums, None)
    sliced = scan.ordered_scan(skewed, ["k"], order, "r", sums, 100)
    assert scan.has_hot_group(skewed, ["k"], 100) and not scan.has_hot_group(skewed, ["k"], 5000)
    assert as_dict(plain, "r", "run") == as_dict(sliced, "r", "run")


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "hochberg"])
def test_adjustment_is_the_same_for_hot_groups(skewed, method):
    p = skewed.withColumn("p", F.when(F.col("v") > 2.5, None).otherwise(F.round(F.abs(F.col("v")) / 6 + 0.0005, 4)))
    cold = as_dict(scan.adjust_p(p, ["k"], "p", "q", method), "q")
    hot = as_dict(scan.adjust_p(p, ["k"], "p", "q", method, hot_rows=10), "q")
    assert cold.keys() == hot.keys()
    for i in cold:
        assert (cold[i][0] is None and hot[i][0] is None) or cold[i][0] == pytest.approx(hot[i][0], rel=1e-12)


def test_adjustment_on_known_values(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.05, None, float("nan")]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(p)], "k string, id long, p double")
    want = {
        "BH": [0.05] * 5, "bonferroni": [0.05, 0.1, 0.15, 0.2, 0.25], "holm": [0.05, 0.08, 0.09, 0.09, 0.09],
        "hochberg": [0.05] * 5, "hommel": [0.05] * 5, "BY": [0.05 * 137 / 60] * 5,
    }
    for method, expected in want.items():
        got = as_dict(scan.adjust_p(df, ["k"], "p", "q", method), "q")
        assert [got[i][0] for i in range(5)] == pytest.approx(expected), method
        assert got[5][0] is None and got[6][0] is None
    assert scan.adjust_p(df, ["k"], "p", "q", "none").where("q = p").count() >= 5
    with pytest.raises(ValueError):
        scan.adjust_p(df, ["k"], "p", "q", "magic")


def test_average_rank_and_quantile(skewed):
    import pandas as pd

    pdf = skewed.toPandas()
    want = pdf.groupby("k")["v"].rank(method="average")
    for hot in (None, 100):
        got = as_dict(scan.average_rank(skewed, ["k"], "v", "r", hot), "r")
        assert all(got[i][0] == w for i, w in zip(pdf["id"], want))
        q = {r["k"]: r["q"] for r in scan.group_quantile(skewed, ["k"], "v", 0.3, "q", hot_rows=hot).collect()}
        for k, g in pdf.groupby("k"):
            assert q[k] == pytest.approx(np.quantile(g["v"], 0.3))


def test_quantile_with_implicit_zeros(spark):
    rows = [("a", 1.0, 3), ("a", 4.0, 3), ("b", 2.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, z long")
    q = {r["k"]: r["q"] for r in scan.group_quantile(df, ["k"], "v", 0.75, "q", zeros="z").collect()}
    assert q == {"a": pytest.approx(np.quantile([0, 0, 0, 1, 4], 0.75)), "b": 2.0}


def test_hommel_equals_the_quadratic_rule():
    import numpy as np

    from setloom.operators.scan import hommel_values

    def quadratic(v):
        n = len(v)
        best = np.full(n, (n * v / np.arange(1, n + 1)).min())
        for m in range(n - 1, 1, -1):
            head, tail = v[:n - m + 1], v[n - m + 1:]
            low = np.minimum(m * head, (m * tail / np.arange(2, m + 1)).min())
            best = np.maximum(best, np.concatenate([low, np.full(m - 1, low[-1])]))
        return np.maximum(best, v)

    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        for v in (rng.random(n) ** 3, np.round(rng.random(n), 1), rng.random(n) * 0.01):
            assert np.allclose(hommel_values(np.sort(v)), quadratic(np.sort(v)), atol=1e-12)


def test_range_scan_runs_over_partitions(spark):
    from pyspark.sql import functions as F

    from setloom.operators.scan import range_scan

    x = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).alias("x"), (F.col("id") % 5).alias("v"))
    got = {(r.g, r.x): r.v for r in range_scan(x, ["g"], ["x"], ["v"]).collect()}
    rows, run = sorted((r.g, r.x, r.v) for r in x.collect()), {}
    for g, k, v in rows:
        run[g] = run.get(g, 0) + v
        assert got[g, k] == run[g]


def test_p_values_of_a_large_group_are_merged_before_they_are_ordered(spark, monkeypatch):
    from setloom.operators import scan as sc

    def whole_rows(*_):
        raise AssertionError("a window over all rows of a large group")

    monkeypatch.setattr(sc, "_adjust_in_windows", whole_rows)
    df = spark.range(600_000).selectExpr("'S' study_id", "(id % 1000 + 1) / 1000 p")
    q = {r[0]: r[1] for r in sc.adjust_p(df, ["study_id"], "p", "q").distinct().select("p", "q").collect()}
    assert len(q) == 1000 and all(abs(v - 1.0) < 1e-9 for v in q.values())


def test_quantiles_of_hot_groups_do_not_order_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("a" if i % 9 else "b", float(x), None) for i, x in enumerate(rng.normal(size=20_000))]
    rows += [("a", 0.25, None)] * 500 + [("b", None, None)] * 3 + [("c", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, z long")
    wanted = {"q05": 0.05, "mid": 0.5, "top": 1.0, "low": 0.0}
    plain = sorted(scan.group_quantiles(df, ["k"], "v", wanted, hot_rows=None).collect(), key=str)
    with monkeypatch.context() as m:
        m.setattr(scan, "_sliced", None)
        df_ = df.where("v is not null")
        some = sorted(scan.group_quantiles(df_, ["k"], "v", wanted, hot_rows=1000).collect(), key=str)
        assert some == sorted(scan.group_quantiles(df_, ["k"], "v", wanted, hot_rows=None).collect(), key=str)
    assert sorted(scan.group_quantiles(df, ["k"], "v", wanted, hot_rows=1000).collect(), key=str) == plain
    monkeypatch.setattr(scan, "BRACKET", -0.01)  # every bracket misses
    assert sorted(scan.group_quantiles(df, ["k"], "v", wanted, hot_rows=1000).collect(), key=str) == plain
