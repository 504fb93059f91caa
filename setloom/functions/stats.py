"""Statistical column expressions (no Python in the row path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DOUBLE_MIN


def _poly(x: Column, coefs: list[float]) -> Column:
    """Horner form of a polynomial, lowest coefficient first."""
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def log_factorial(n: Column) -> Column:
    """ln(n!) for n >= 0: a short table, then Stirling's series (error below 1e-13)."""
    table = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(16)])
    x = n.cast("double") + 1.0
    inv = 1.0 / x
    series = inv * _poly(inv * inv, [1 / 12, -1 / 360, 1 / 1260, -1 / 1680])
    stirling = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(n < 16, F.element_at(table, n.cast("int") + 1)).otherwise(stirling)


def harmonic_number(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up to 16, by its asymptotic series beyond (error below 1e-11)."""
    table = F.array(*[F.lit(sum(1.0 / j for j in range(1, i + 1))) for i in range(17)])
    x = m.cast("double")
    inv2 = 1.0 / (x * x)
    far = F.ln(x) + 0.5772156649015329 + 0.5 / x - inv2 * _poly(inv2, [1 / 12, -1 / 120, 1 / 252, -1 / 240])
    return F.when(m <= 16, F.element_at(table, m.cast("int") + 1)).otherwise(far)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeom_tail(N: Column, M: Column, K: Column, x: Column) -> Column:
    """P(X >= x) for X ~ Hypergeometric(universe N, marked M, drawn K).

    The sum always runs away from the mode, so its terms only shrink: the upper tail is
    added up directly above the mode, and taken as one minus the lower tail below it.
    Terms further than 12 standard deviations out cannot change a double and are skipped.
    """
    N, M, K, x = (c.cast("long") for c in (N, M, K, x))
    lo = F.greatest(F.lit(0).cast("long"), K - (N - M))
    hi = F.least(M, K)
    mode = F.floor((K + 1) * (M + 1) / (N + 2))
    share = M / N
    reach = F.ceil(12 * F.sqrt(K * share * (1 - share))) + 60

    def log_term(j: Column) -> Column:
        return log_choose(M, j) + log_choose(N - M, K - j) - log_choose(N, K)

    def series(js: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

        def step(acc, j):
            t = acc["t"] * ratio(j.cast("double"))
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        return F.aggregate(js, start, step, lambda a: a["s"])

    empty = F.array().cast("array<bigint>")
    up_end = F.least(hi - 1, x + reach)
    up = series(
        F.when(up_end >= x, F.sequence(x, up_end)).otherwise(empty),
        lambda j: (M - j) * (K - j) / ((j + 1) * (N - M - K + j + 1)),
    )
    down_end = F.greatest(lo + 1, x - 1 - reach)
    down = series(
        F.when(down_end <= x - 1, F.sequence(x - 1, down_end, F.lit(-1).cast("long"))).otherwise(empty),
        lambda j: j * (N - M - K + j) / ((M - j + 1) * (K - j + 1)),
    )
    inside = F.when(x > mode, F.least(F.lit(1.0), F.exp(log_term(x)) * up)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.exp(log_term(x - 1)) * down)
    )
    known = N.isNotNull() & M.isNotNull() & K.isNotNull() & x.isNotNull()
    return F.when(known & (x <= lo), 1.0).when(known & (x > hi), 0.0).when(known, inside)


def trigamma(x: Column) -> Column:
    """Second derivative of ln Gamma for x > 0 (error below 1e-10): six steps up, then the asymptotic series."""
    z = x + 6.0
    inv = 1.0 / z
    series = inv + 0.5 * inv * inv + inv * inv * inv * _poly(inv * inv, [1 / 6, -1 / 30, 1 / 42, -1 / 30])
    for i in range(6):
        series = series + 1.0 / ((x + float(i)) * (x + float(i)))
    return series


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0, relative error below 1.2e-7."""
    t = 1.0 / (1.0 + 0.5 * z)
    # Published rational Chebyshev fit, lowest order first.
    coefs = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    return t * F.exp(-z * z + _poly(t, coefs))


def two_sided_normal(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2.0)))


# Coefficients of algorithm AS 241 (numerator, denominator), lowest order first: centre, near tail, far tail.
AS_241 = (
    ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
      1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
      3.3430575583588128105e4, 2.5090809287301226727e3],
     [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
      5.2264952788528545610e3]),
    ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
      3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
      2.27238449892691845833e-2, 7.74545014278341407640e-4],
     [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
      1.05075007164441684324e-9]),
    ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
      2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
      2.71155556874348757815e-5, 2.01033439929228813265e-7],
     [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
      2.04426310338993978564e-15]),
)


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile (Wichura's AS 241, full double precision)."""
    (a, b), (c, d), (e, f) = AS_241
    q = p - 0.5
    r0 = 0.180625 - q * q
    centre = q * _poly(r0, a) / _poly(r0, b)
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    near = _poly(r - 1.6, c) / _poly(r - 1.6, d)
    far = _poly(r - 5.0, e) / _poly(r - 5.0, f)
    tail = F.signum(q) * F.when(r <= 5.0, near).otherwise(far)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(tail)


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def de_weight(stat: Column, pvalue: Column) -> Column:
    """sign(stat) * -log10(max(p, smallest double)); a missing input gives 0."""
    stat, pvalue = stat.cast("double"), pvalue.cast("double")
    w = F.signum(stat) * -F.log10(F.greatest(pvalue, F.lit(DOUBLE_MIN)))
    return F.when(_known(stat) & _known(pvalue), w).otherwise(0.0)


def signed_q(nes: Column, q: Column) -> Column:
    """sign(NES) * -log10(q); q = 0 counts as the smallest normal double."""
    return F.signum(nes) * neg_log10(q)


def neg_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(DOUBLE_MIN)))


def unit_scale(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max position of x inside [lo, hi]; a flat range gives 0."""
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)


def range_scale(x: Column, lo: Column, hi: Column, to: tuple[float, float]) -> Column:
    """Rescale to ``to``; a flat or missing range gives the midpoint."""
    mid = (to[0] + to[1]) / 2.0
    moved = (x - lo) / (hi - lo) * (to[1] - to[0]) + to[0]
    return F.when(hi > lo, moved).otherwise(mid)
