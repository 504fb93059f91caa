"""Dispersions, trend, prior and filter against planted values and plain formulas."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.functions.stats import trigamma
from setloom.operators import dispersion
from setloom.params import Contrast


def planted(features=1500, per_group=6, seed=3):
    rng = np.random.default_rng(seed)
    mean = np.exp(rng.uniform(math.log(5), math.log(3000), features))
    true = (0.08 + 4.0 / mean) * np.exp(rng.normal(0, 0.5, features))
    change = np.where(np.arange(features) % 10 == 0, 2.0 ** rng.choice([-2, 2], features), 1.0)
    size = rng.uniform(0.6, 1.6, 2 * per_group)
    mu = mean[:, None] * np.where(np.arange(2 * per_group) < per_group, change[:, None], 1.0) * size
    y = rng.poisson(rng.gamma(1 / true[:, None], mu * true[:, None]))
    return mean, true, change, y


@pytest.fixture(scope="module")
def tested(spark):
    mean, true, change, y = planted()
    n = y.shape[1]
    cells = [("s", f"f{i:04d}", f"x{j:02d}", float(y[i, j])) for i in range(len(y)) for j in range(n) if y[i, j]]
    counts = spark.createDataFrame(cells, "study_id string, feature_id string, sample_id string, value double")
    samples = spark.createDataFrame([("s", f"x{j:02d}", "a" if j < n // 2 else "b") for j in range(n)],
                                    "study_id string, sample_id string, grp string")
    got = dispersion.differential_test(counts.repartition(5), samples, Contrast("grp", "a", "b")).toPandas().sort_values("feature_id")
    place = got["feature_id"].str[1:].astype(int).to_numpy()
    return got, mean[place], true[place], change[place], (counts, samples)


def test_planted_dispersions_come_back(tested):
    got, mean, true, _, _ = tested
    trend = 0.08 + 4.0 / mean
    assert np.median(np.abs(np.log(got["trend_dispersion"] / trend))) < 0.25
    raw = np.abs(np.log(got["gene_dispersion"].to_numpy() / true))
    final = np.abs(np.log(got["dispersion"].to_numpy() / true))
    assert np.median(final) < 0.4 and np.mean(np.minimum(final, 5)) < 0.8 * np.mean(np.minimum(raw, 5))
    assert 0 <= got["outlier"].mean() < 0.1


def test_changes_are_found_and_others_are_not(tested):
    got, _, _, change, _ = tested
    found = (got["padj"] < 0.1).to_numpy()
    real = change != 1
    assert found[real].mean() > 0.75 and found[~real].sum() < 0.2 * found.sum()
    away = found & real
    assert (np.sign(got["lfc"].to_numpy()[away]) == np.sign(np.log2(change[away]))).all()
    null = got["pvalue"].to_numpy()[~real]
    assert abs((null < 0.05).mean() - 0.05) < 0.03


def test_partitions_do_not_matter(tested):
    got, _, _, _, (counts, samples) = tested
    again = dispersion.differential_test(counts.repartition(2), samples, Contrast("grp", "a", "b")).toPandas().sort_values("feature_id")
    assert np.allclose(again["stat"], got["stat"], atol=1e-6) and np.allclose(again["padj"].fillna(-1), got["padj"].fillna(-1), atol=1e-6)


def test_search_equals_a_fine_grid():
    rng = np.random.default_rng(1)
    y = rng.poisson(rng.gamma(4, 30 / 4, (40, 8))).astype(float)
    groups = np.kron(np.eye(2), np.ones((4, 1)))
    mu = np.maximum((y @ groups / 4) @ groups.T, 0.5)
    grid = np.linspace(math.log(1e-8), math.log(10), 20_001)
    fine = np.exp(grid[dispersion.adjusted_profile(y, mu, groups, np.tile(grid, (40, 1))).argmax(axis=1)])
    got = dispersion.best_dispersion(y, mu, groups)
    far = fine > 1e-4
    assert np.allclose(np.log(got[far]), np.log(fine[far]), atol=2e-3) and (got[~far] < 1e-3).all()


def test_likelihood_forms_agree():
    y, mu = np.arange(0, 60.0)[None, :], np.full((1, 60), 17.0)
    for alpha in (1e-6, 1e-4, 0.99e-3, 1.01e-3, 0.1, 5.0):
        exact = [math.lgamma(k + 1 / alpha) - math.lgamma(1 / alpha) + k * math.log(alpha) - (k + 1 / alpha) * math.log1p(17 * alpha)
                 for k in range(60)]
        assert np.allclose(dispersion._likelihood(y, mu, np.array([[alpha]]))[0], exact, atol=1e-7)


def test_group_means_solve_their_equation():
    rng = np.random.default_rng(2)
    size = rng.uniform(0.5, 2, 8)
    y = rng.poisson(20 * size, (30, 8)).astype(float)
    y[0, :4] = 0
    groups = np.kron(np.eye(2), np.ones((4, 1)))
    alpha = rng.uniform(0.01, 1, 30)
    mean, _ = dispersion.group_means(y, size, groups, alpha)
    mu = (mean @ groups.T) * size
    rest = ((y - mu) / (1 + alpha[:, None] * mu)) @ groups
    assert np.abs(rest[1:]).max() < 1e-6 and mean[0, 0] == 0.125


def test_lowess():
    x = np.linspace(0, 1, 50)
    assert np.allclose(dispersion.lowess(x, 3 + 2 * x), 3 + 2 * x)
    bumped = 3 + 2 * x + 0.01 * np.random.default_rng(1).normal(size=50)
    bumped[20] += 50
    off = [np.abs(dispersion.lowess(x, bumped, robust=k) - (3 + 2 * x))[np.arange(50) != 20].max() for k in (0, 3)]
    assert off[0] > 1 and off[1] < 0.05 * off[0]


def test_trigamma(spark):
    for x, exact in ((0.5, math.pi ** 2 / 2), (1.0, math.pi ** 2 / 6), (6.0, math.pi ** 2 / 6 - sum(1 / k ** 2 for k in range(1, 6)))):
        assert abs(spark.range(1).select(trigamma(F.lit(x)).alias("v")).first().v - exact) < 1e-10


def test_filter_picks_the_first_good_step(spark):
    rows = [("s", k, k / 49, float(k), 5) for k in range(50)]
    frame = spark.createDataFrame(rows, "study_id string, step int, theta double, cutoff double, rejected long")
    assert dispersion.threshold(frame).first().cutoff == 0.0
    rising = spark.createDataFrame([("s", k, k / 49, float(k), 100 + min(k, 20) * 10) for k in range(50)], frame.schema)
    assert 10 <= dispersion.threshold(rising).first().cutoff <= 20


def test_rejections_rank_features_by_range(spark, monkeypatch):
    """Neither the features of a study nor the p values of a step meet in one window of the whole group."""
    from setloom.operators import dispersion

    seen = []
    scan = dispersion.range_scan

    def watched(df, keys, *rest):
        seen.append(keys)
        return scan(df, keys, *rest)

    monkeypatch.setattr(dispersion, "range_scan", watched)
    rows = [("S", i, float(i + 1), (i * 37 % 200 + 1) / 2000) for i in range(200)]
    got = dispersion.rejections(spark.createDataFrame(rows, "study_id string, feature_id long, base_mean double, pvalue double")).collect()
    assert seen == [["study_id"], ["study_id", "step"]] and len(got) == 50
    for r in got:
        p = sorted(x[3] for x in rows if x[2] >= r["cutoff"] - 1e-12)
        assert r["rejected"] == max([i + 1 for i, v in enumerate(p) if v < 0.1 and v * len(p) / (i + 1) < 0.1], default=0)


def test_count_terms_are_shared_by_features_with_one_grid(monkeypatch):
    """Cells of one count and one grid of candidates are evaluated once; the fit stays that of each feature by itself."""
    seen = []
    terms = dispersion._count_terms
    monkeypatch.setattr(dispersion, "_count_terms", lambda y, alpha: seen.append(np.size(y)) or terms(y, alpha))
    rng = np.random.default_rng(5)
    y = rng.poisson(6, (300, 8)).astype(float)
    groups = np.kron(np.eye(2), np.ones((4, 1)))
    mu = np.maximum((y @ groups / 4) @ groups.T, 0.5)
    got = dispersion.best_dispersion(y, mu, groups)
    assert max(seen[:dispersion.GRID]) == len(np.unique(y)) < y.size
    alone = [dispersion.best_dispersion(y[i:i + 1], mu[i:i + 1], groups)[0] for i in range(0, 300, 30)]
    assert np.allclose(got[::30], alone, rtol=1e-12)


def test_fits_are_dealt_over_all_tasks(spark, monkeypatch):
    """Few bytes a feature: adaptive merging would fit all of them in one task."""
    dealt = []
    last = dispersion.shrunken
    monkeypatch.setattr(dispersion, "shrunken", lambda genes, *rest: dealt.append(
        [r["count"] for r in genes.groupBy(F.spark_partition_id()).count().collect()]) or last(genes, *rest))
    rng = np.random.default_rng(6)
    rows = [("s", f"g{i}", f"x{j}", float(v)) for i in range(200) for j, v in enumerate(rng.poisson(30, 6))]
    counts = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")
    samples = spark.createDataFrame([("s", f"x{j}", "ab"[j % 2]) for j in range(6)], "study_id string, sample_id string, grp string")
    assert dispersion.differential_test(counts, samples, dispersion.Contrast("grp", "a", "b")).count() == 200
    assert len(dealt[0]) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(dealt[0]) == 200
