import numpy as np
import pytest
from pyspark.sql import functions as F

from setloom.operators import matrix as mx


def long_form(spark, m, study="S"):
    rows = [(study, f"f{i}", f"s{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")


def sample_frame(spark, n, study="S"):
    return spark.createDataFrame([(study, f"s{j}", "a" if j < n // 2 else "b") for j in range(n)], "study_id string, sample_id string, grp string")


@pytest.mark.parametrize("trim", [0.0, 0.1, 0.3, 0.5])
@pytest.mark.parametrize("hot", [None, 3])
def test_trimmed_mean_with_zeros_and_negatives(spark, trim, hot):
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 5, size=(40, 3)) * (rng.random((40, 3)) < 0.6)
    owner = ["a" if i < 29 else "b" if i < 39 else "c" for i in range(40)]
    counts = long_form(spark, m).withColumnRenamed("feature_id", "locus_id")
    mapping = spark.createDataFrame([("S", f"f{i}", g) for i, g in enumerate(owner)], "study_id string, locus_id string, feature_id string")
    got = {(r["feature_id"], r["sample_id"]): r["value"] for r in mx.group_loci(counts, mapping, "trimmed_mean", trim, hot_rows=hot).collect()}
    for g in "abc":
        block = m[[i for i, o in enumerate(owner) if o == g]]
        for j in range(3):
            v = np.sort(block[:, j])
            k = (len(v) - 1) // 2 if trim >= 0.5 else int(np.floor(trim * len(v)))
            assert got.get((g, f"s{j}"), 0.0) == pytest.approx(v[k:len(v) - k].mean(), abs=1e-12)


def test_row_variance_counts_implicit_zeros(spark):
    m = np.array([[1000.0, 0, 1001, 0], [3, 3, 3, 3], [0, 0, 0, 7]])
    got = {r["feature_id"]: (r["mean"], r["variance"]) for r in mx.row_variance(long_form(spark, m), sample_frame(spark, 4)).collect()}
    for i, row in enumerate(m):
        assert got[f"f{i}"] == (pytest.approx(row.mean()), pytest.approx(row.var(ddof=1)))


def test_missing_samples_fail_the_alignment(spark):
    counts = long_form(spark, [[1, 2], [3, 0]])
    assert mx.align_samples(counts, sample_frame(spark, 2)).count() == 3
    with pytest.raises(Exception, match="missing samples"):
        mx.align_samples(counts, sample_frame(spark, 3)).collect()
    assert mx.align_samples(counts, sample_frame(spark, 3), strict=False).count() == 3


def test_duplicate_targets_are_refused(spark):
    counts = long_form(spark, [[1, 2], [3, 0]]).withColumnRenamed("feature_id", "locus_id")
    mapping = spark.createDataFrame([("S", "f0", "x"), ("S", "f1", "x")], "study_id string, locus_id string, feature_id string")
    assert mx.duplicated_targets(mapping).collect()[0]["loci"] == 2
    with pytest.raises(Exception, match="duplicated ids"):
        mx.rename_loci(counts, mapping).collect()
    assert mx.rename_loci(counts, mapping.where("locus_id = 'f0'")).count() == 2


def test_tmm_of_scaled_samples_is_one(spark):
    base = np.arange(1, 60)
    m = np.stack([base, base * 3, base * 5], axis=1)
    f = [r["norm_factor"] for r in mx.tmm_factors(long_form(spark, m)).collect()]
    assert f == pytest.approx([1.0, 1.0, 1.0])


def test_large_group_rule_of_the_expression_filter(spark):
    n = 40
    m = np.zeros((2, n))
    m[0, :17] = 100
    m[1, :16] = 100
    big = np.vstack([m, np.full((1, n), 1000.0)])
    kept = {r["feature_id"] for r in mx.expression_filter(long_form(spark, big), sample_frame(spark, n)).collect()}
    assert kept == {"f0", "f2"}  # 10 + (20 - 10) * 0.7 = 17 samples are needed


def test_half_to_even(spark):
    got = [r[0] for r in mx.round_counts(long_form(spark, [[0.5, 1.5, 2.5, -0.5]])).select("value").collect()]
    assert sorted(got) == [0.0, 0.0, 2.0, 2.0] or sorted(got) == [-0.0, 0.0, 2.0, 2.0]


def test_sparse_samples_take_the_reference_with_most_signal(spark):
    """Upper quartiles that are mostly zero: the sample with the largest sum of square roots is the reference (factor ratios
    then follow from the features it shares with the others)."""
    m = np.zeros((40, 3))
    m[:6, 0], m[:8, 1], m[:7, 2] = 5, 50, 9
    f = {r["sample_id"]: r["norm_factor"] for r in mx.tmm_factors(long_form(spark, m)).collect()}
    share = m / m.sum(axis=0)
    ratio = np.log2(share[0] / share[0, 1])  # constant over shared features
    assert [f[k] for k in sorted(f)] == pytest.approx(2 ** (ratio - ratio.mean()))


def test_malformed_row_names_fail(spark):
    from pyspark.sql import functions as F

    from setloom.functions.text import require_locus

    rows = spark.createDataFrame([("chr1:5-9",), (None,)], "n string").select(require_locus(F.col("n")).alias("l")).collect()
    assert tuple(rows[0].l) == ("chr1", 5, 9) and rows[1].l is None
    with pytest.raises(Exception, match="chr1:x-9"):
        spark.createDataFrame([("chr1:x-9",)], "n string").select(require_locus(F.col("n"))).collect()


def test_cells_are_not_dealt_by_study(spark):
    cells = spark.createDataFrame([("s", f"f{i % 5}", f"x{i % 3}", float(i)) for i in range(40)],
                                  "study_id string, feature_id string, sample_id string, value double").groupBy(*mx.CELL).agg(F.sum("value").alias("value"))
    samples = spark.createDataFrame([("s", f"x{i}", f"g{i % 2}") for i in range(3)], "study_id string, sample_id string, grp string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mx.expression_filter(cells, samples)._jdf.queryExecution().executedPlan().toString()
        dense = mx.fill_zeros(cells, samples)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin [study_id" in plan and "SortMergeJoin" not in dense
    top = plan[:plan.index("BroadcastHashJoin [study_id")]
    assert "SortMergeJoin" not in top
