import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from setloom.functions import stats as st
from setloom.operators.verify import short_number, signed_text


def column(spark, values, f, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_log_factorial(spark):
    n = [0, 1, 2, 9, 15, 16, 17, 100, 12345, 10**7]
    for got, k in zip(column(spark, n, st.log_factorial, "long"), n):
        assert got == pytest.approx(math.lgamma(k + 1), rel=1e-13, abs=1e-13)


def test_hypergeometric_tail(spark):
    cases = [(n, m, k, x) for n in (1, 5, 20, 60) for m in range(0, n + 1, 3) for k in range(0, n + 1, 4) for x in range(-1, n + 2, 2)]
    df = spark.createDataFrame(cases, "N long, M long, K long, x long")
    rows = df.select("*", st.hypergeom_tail(*[F.col(c) for c in ("N", "M", "K", "x")]).alias("p")).collect()
    for n, m, k, x, p in rows:
        want = sum(math.comb(m, j) * math.comb(n - m, k - j) for j in range(max(x, 0), min(m, k) + 1)) / math.comb(n, k)
        assert p == pytest.approx(want, rel=1e-9, abs=1e-14), (n, m, k, x)


def test_hypergeometric_tail_far_out(spark):
    df = spark.createDataFrame([(20000, 500, 900, 1), (20000, 500, 900, 120), (100000, 40000, 50000, 100)], "N long, M long, K long, x long")
    p = [r[0] for r in df.select(st.hypergeom_tail(*[F.col(c) for c in ("N", "M", "K", "x")])).collect()]
    want = sum(math.comb(500, j) * math.comb(19500, 900 - j) for j in range(120, 501)) / math.comb(20000, 900)
    assert p[0] == pytest.approx(1.0, abs=1e-9) and p[1] == pytest.approx(want, rel=1e-7) and p[2] == 1.0


def test_inverse_normal(spark):
    p = [1e-12, 1e-6, 0.01, 0.0749, 0.08, 0.3, 0.5, 0.77, 0.95, 0.999999]
    for got, v in zip(column(spark, p, st.inverse_normal), p):
        assert got == pytest.approx(NormalDist().inv_cdf(v), rel=1e-12, abs=1e-14)


def test_two_sided_normal(spark):
    z = [0.0, 0.5, -1.0, 1.96, 5.0, -12.0, 30.0]
    for got, v in zip(column(spark, z, st.two_sided_normal), z):
        assert got == pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=2e-7)


def test_harmonic_number(spark):
    m = [1, 2, 16, 17, 500, 100000]
    for got, v in zip(column(spark, m, st.harmonic_number, "long"), m):
        assert got == pytest.approx(math.fsum(1 / i for i in range(1, v + 1)), rel=1e-12)


def test_weights_handle_missing_values(spark):
    df = spark.createDataFrame([(2.0, 0.01), (-1.0, 0.1), (None, 0.5), (1.0, None), (float("nan"), 0.2), (-3.0, 0.0)], "s double, p double")
    w = [r[0] for r in df.select(st.de_weight(F.col("s"), F.col("p"))).collect()]
    assert w[:5] == pytest.approx([2.0, -1.0, 0.0, 0.0, 0.0])
    assert w[5] == pytest.approx(-307.6526555685888)


def test_short_number_is_three_significant_digits(spark):
    v = [0.0, 0.05, 0.123456, 0.99996, 1.0, 9.999, 12.345, 100.0, 0.0001234, 0.00001234, 1234.5, 1e-12]
    assert column(spark, v, short_number) == [f"{x:.3g}" for x in v]


def test_signed_text_rounds_the_exact_binary_value(spark):
    """0.285 and 0.435 lie below their halves as doubles, 0.125 is one: none of them goes up."""
    v = [0.285, -0.435, 0.125, 0.375, -0.625, 0.995, 999999.995, 0.005, -0.001, -0.0, 0.0, 1e14 + 0.5, 12.0, 3e-20]
    v += [(2 * k + 1) / 200 for k in range(400)] + [math.nextafter((2 * k + 1) / 200, 9) for k in range(400)]
    assert column(spark, v, signed_text) == [f"{x:+.2f}" for x in v]
    assert column(spark, [None, 1e300], signed_text) == ["NA", "+1" + "0" * 300 + ".00"]
