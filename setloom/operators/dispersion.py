"""Differential tests with shrunken dispersions: gene-wise fits, trend over the mean, maximum a posteriori, Wald test.

The steps follow the published procedure for count data (Love, Huber and Anders 2014) on group designs:

1. Each feature's dispersion maximises the negative-binomial likelihood with the Cox-Reid adjustment, at group means.
2. The trend ``a0 + a1 / mean`` is a gamma regression with identity link: every step is one weighted sum per study.
3. The spread of the log dispersions around the trend, less their sampling variance, is the prior's variance; each feature
   takes its posterior mode, but outliers above the trend keep their own estimate.
4. Group means maximise the likelihood at that dispersion, and their log ratio gets a Wald test.
5. Features below a mean threshold leave the adjustment; the threshold is the least that gives most rejections.

A feature is one row with its cells, so fits are array operations over batches of rows in any partition. Not done:
replacement of outlying counts. Trend coefficients are floored at ``LEAST``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import trigamma, two_sided_normal
from ..params import Contrast
from ..session import cut_lineage
from .de import size_factors
from .matrix import low_count_filter, round_counts
from .scan import HOT_ROWS, adjust_p, group_quantile, range_scan

LEAST = 1e-8  # least dispersion
FITTED = 1e-6  # dispersions from here on shape the trend and the prior
GRID = 21  # points of a search round; each next round looks between the neighbours of the best point
ROUNDS = 4
STEPS = 30  # steps of the trend at most
THETAS = 50


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 (error below 1e-13): Stirling's series seven steps up."""
    z = x + 7.0
    up = np.ones_like(z)
    for i in range(7):
        up *= x + i
    inv = 1.0 / z
    tail = inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv / 1680)))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - np.log(up)


def _count_terms(y: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The part of each cell's log likelihood that holds its count and ``alpha``, but not its mean."""
    r = 1.0 / alpha
    out = np.empty(np.broadcast(y, alpha).shape)
    far = np.broadcast_to(r > 1e3, out.shape)
    y, alpha, r = (np.broadcast_to(v, out.shape) for v in (y, alpha, r))
    v, a, k = y[~far], alpha[~far], r[~far]
    out[~far] = _log_gamma(v + k) - _log_gamma(k) + v * np.log(np.maximum(a, 1e-3))
    # Beyond r = 1000 the gamma functions cancel; their difference follows from Stirling's series.
    v, a, k = y[far], alpha[far], r[far]
    out[far] = (k + v - 0.5) * np.log1p(v * a) - v + (1.0 / (k + v) - a) / 12.0
    return out


def _likelihood(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray, terms: np.ndarray | None = None) -> np.ndarray:
    """Negative-binomial log likelihood of each cell without the terms that do not hold ``alpha``."""
    return (_count_terms(y, alpha) if terms is None else terms) - (y + 1.0 / alpha) * np.log1p(mu * alpha)


def adjusted_profile(y: np.ndarray, mu: np.ndarray, groups: np.ndarray, log_alpha: np.ndarray,
                     grid: np.ndarray | None = None) -> np.ndarray:
    """Cox-Reid adjusted log likelihood: features x cells ``y`` and ``mu``, features x candidates ``log_alpha``.

    Features of one number in ``grid`` have the same candidates; cells of one count and grid share their count terms.
    """
    out = np.empty_like(log_alpha)
    grid = np.arange(len(y)) if grid is None else np.unique(grid, return_inverse=True)[1].reshape(-1)
    counts, number = np.unique(y, return_inverse=True)
    pairs, place = np.unique(grid[:, None] * len(counts) + number.reshape(y.shape), return_inverse=True)
    place, of_pair = place.reshape(y.shape), counts[pairs % len(counts)]
    one = np.empty(grid.max() + 1 if len(grid) else 0, int)
    one[grid] = np.arange(len(grid))
    feature, inverse = one[pairs // len(counts)], 1.0 / mu
    for c in range(log_alpha.shape[1]):
        alpha = np.exp(log_alpha[:, c:c + 1])
        terms = _count_terms(of_pair, alpha[feature, 0])[place]
        out[:, c] = _likelihood(y, mu, alpha, terms).sum(axis=1) - 0.5 * np.log((1.0 / (inverse + alpha)) @ groups).sum(axis=1)
    return out


def best_dispersion(y, mu, groups, prior_mean=None, prior_var=None) -> np.ndarray:
    """Dispersion of each feature with the largest adjusted likelihood, or posterior where a log-normal prior is given."""
    n, top = len(y), math.log(max(10.0, y.shape[1]))
    low, step = np.full(n, math.log(LEAST)), np.full(n, (top - math.log(LEAST)) / (GRID - 1))
    grid = np.zeros(n, int)  # number of the candidates: features that went the same way have the same ones
    for _ in range(ROUNDS):
        at = low[:, None] + step[:, None] * np.arange(GRID)
        value = adjusted_profile(y, mu, groups, at, grid)
        if prior_mean is not None:
            value = value - (at - np.log(prior_mean)[:, None]) ** 2 / (2 * prior_var[:, None])
        place = value.argmax(axis=1)
        best, width = at[np.arange(n), place], step
        low = np.maximum(best - step, math.log(LEAST))
        step = (np.minimum(best + step, top) - low) / (GRID - 1)
        grid = grid * GRID + place
    # The top of the parabola through the best point of the last round and its neighbours.
    inner = np.clip(place, 1, GRID - 2)
    before, here, after = (value[np.arange(n), inner + k] for k in (-1, 0, 1))
    bend = before - 2 * here + after
    shift = np.where((place == inner) & (bend < 0), 0.5 * (before - after) / np.where(bend < 0, bend, -1.0), 0.0)
    return np.exp(best + shift * width)


def group_means(y, size, groups, alpha) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each group (at unit size factor) that maximises the likelihood, and the information on its logarithm.

    A group without counts stands at half a count.
    """
    n_in = groups.sum(axis=0)
    floor = 0.5 / n_in
    mean = np.maximum((y / size) @ groups / n_in, floor)
    for _ in range(15):
        mu = (mean @ groups.T) * size
        down = 1.0 + alpha[:, None] * mu
        step = (((y - mu) / down) @ groups) / ((mu / down) @ groups)
        mean = np.maximum(mean * np.exp(np.clip(step, -3, 3)), floor)
    mu = (mean @ groups.T) * size
    return mean, (mu / (1.0 + alpha[:, None] * mu)) @ groups


def _batches(frames: Iterator[pd.DataFrame]):
    """Rows of one study at a time: frame, dense counts, size factors, indicator of the groups."""
    for frame in frames:
        for _, part in frame.groupby("study_id", sort=False):
            size = np.asarray(part["sizes"].iloc[0], float)
            number = np.asarray(part["groups"].iloc[0], int)
            y = np.zeros((len(part), len(size)))
            for i, (places, values) in enumerate(zip(part["places"], part["values"], strict=True)):
                y[i, np.asarray(places, int)] = values
            yield part, y, size, (number[:, None] == np.arange(number.max() + 1)).astype(float)


def feature_rows(counts: DataFrame, samples: DataFrame, contrast: Contrast, round_values: bool = True,
                 min_total: float = 10.0, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row a feature: its cells by place, with the study's size factors and groups (numerator 0, denominator 1)."""
    used = counts.join(samples.select("study_id", "sample_id"), ["study_id", "sample_id"], "left_semi")
    used = round_counts(used) if round_values else used
    used = low_count_filter(used.where(F.col("value") != 0), min_total)
    meta = samples.join(size_factors(used, samples, hot_rows), ["study_id", "sample_id"])
    order = F.when(F.col("grp") == contrast.numerator, 0).when(F.col("grp") == contrast.denominator, 1).otherwise(2)
    # Samples and groups of a study are its design: a few hundred rows at most.
    design = meta.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct(
        order.alias("o"), "grp", "sample_id", "size_factor"))).alias("_d"))
    names = F.array_distinct("_d.grp")
    design = design.select(
        "study_id", F.col("_d.sample_id").alias("_ids"), F.col("_d.size_factor").alias("sizes"),
        F.transform("_d.grp", lambda g: F.array_position(names, g) - 1).alias("groups"))
    places = design.select("study_id", F.posexplode("_ids").alias("place", "sample_id"))
    cells = used.join(places, ["study_id", "sample_id"]).groupBy("study_id", "feature_id").agg(
        F.collect_list("place").alias("places"), F.collect_list("value").alias("values"))
    return cells.join(design.drop("_ids"), "study_id")


def gene_wise(rows: DataFrame) -> DataFrame:
    """Add ``base_mean`` and ``gene_dispersion``."""
    out = rows.select("*", F.lit(0.0).alias("base_mean"), F.lit(0.0).alias("gene_dispersion")).schema

    def run(frames):
        for part, y, size, groups in _batches(frames):
            mean = (y / size) @ groups / groups.sum(axis=0)
            mu = np.maximum((mean @ groups.T) * size, 0.5)
            yield part.assign(base_mean=(y / size).mean(axis=1), gene_dispersion=best_dispersion(y, mu, groups))

    return rows.mapInPandas(run, out)


def fit_trend(genes: DataFrame) -> DataFrame:
    """``study_id, a0, a1`` of the trend a0 + a1 / base_mean through the gene-wise dispersions.

    Each step weighs by the squared fit, as a gamma regression does, and leaves out dispersions below a ten-thousandth or
    above fifteen times the fit. Steps end when no coefficient of any study moves by a hundred-millionth.
    """
    used = genes.where(F.col("gene_dispersion") >= FITTED).select(
        "study_id", (1.0 / F.col("base_mean")).alias("x"), F.col("gene_dispersion").alias("d"))
    state = genes.select("study_id").distinct().select("study_id", F.lit(0.1).alias("a0"), F.lit(1.0).alias("a1"))
    for _ in range(STEPS):
        at = used.join(state, "study_id").withColumn("f", F.col("a0") + F.col("a1") * F.col("x"))
        at = at.where((F.col("d") > 1e-4 * F.col("f")) & (F.col("d") < 15 * F.col("f"))).withColumn("w", 1.0 / (F.col("f") * F.col("f")))
        sums = at.groupBy("study_id").agg(
            F.sum("w").alias("s0"), F.sum(F.expr("w * x")).alias("s1"), F.sum(F.expr("w * x * x")).alias("s2"),
            F.sum(F.expr("w * d")).alias("t0"), F.sum(F.expr("w * x * d")).alias("t1"))
        sums = sums.withColumn("det", F.expr("s0 * s2 - s1 * s1"))
        slope = F.greatest(F.lit(LEAST), F.when(F.col("det") > 1e-12 * F.col("s0") * F.col("s2"), F.expr("(s0 * t1 - s1 * t0) / det")).otherwise(0.0))
        moved = sums.withColumn("b1", slope).withColumn("b0", F.greatest(F.lit(LEAST), F.expr("(t0 - b1 * s1) / s0")))
        new = state.join(moved.select("study_id", "b0", "b1"), "study_id", "left").select(
            "study_id", F.coalesce("b0", "a0").alias("a0"), F.coalesce("b1", "a1").alias("a1"),
            F.coalesce(F.greatest(F.abs(F.log(F.col("b0") / F.col("a0"))), F.abs(F.log(F.col("b1") / F.col("a1")))), F.lit(0.0)).alias("move"))
        state = cut_lineage(new)  # one row a study
        if (state.agg(F.max("move")).first()[0] or 0.0) < 1e-8:
            break
        state = state.drop("move")
    return state.select("study_id", "a0", "a1")


def prior_of(genes: DataFrame, trend: DataFrame, design: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``study_id, spread, prior_var``: variance of the log dispersions around the trend, by the median absolute deviation,
    and what is left of it after their sampling variance (a quarter at least). ``design``: study_id, freedom."""
    gap = genes.where(F.col("gene_dispersion") >= FITTED).join(trend, "study_id").select(
        "study_id", F.round(F.log("gene_dispersion") - F.log(F.col("a0") + F.col("a1") / F.col("base_mean")), 9).alias("_g"))
    gap = cut_lineage(gap)
    mid = group_quantile(gap, ["study_id"], "_g", 0.5, "_mid", hot_rows=hot_rows)
    off = gap.join(mid, "study_id").select("study_id", F.abs(F.col("_g") - F.col("_mid")).alias("_o"))
    mad = group_quantile(off, ["study_id"], "_o", 0.5, "_mad", hot_rows=hot_rows)
    spread = F.pow(F.coalesce("_mad", F.lit(0.0)) * 1.4826, F.lit(2.0))
    return design.join(mad, "study_id", "left").select(
        "study_id", spread.alias("spread"), F.greatest(F.lit(0.25), spread - trigamma(F.col("freedom") / 2)).alias("prior_var"))


def shrunken(genes: DataFrame, trend: DataFrame, prior: DataFrame) -> DataFrame:
    """Dispersions (gene-wise, trend, final), group means and information of each feature. Features stay where they are."""
    given = genes.join(F.broadcast(trend.join(prior, "study_id")), "study_id")  # one row a study
    given = given.withColumn("trend_dispersion", F.col("a0") + F.col("a1") / F.col("base_mean")).drop("a0", "a1")
    names = ["study_id", "feature_id", "base_mean", "gene_dispersion", "trend_dispersion"]
    out = given.select(*names, F.lit(0.0).alias("dispersion"), F.lit(True).alias("outlier"), *[
        F.lit(0.0).alias(c) for c in ("mean_num", "mean_den", "info_num", "info_den")]).schema

    def run(frames):
        for part, y, size, groups in _batches(frames):
            mean = (y / size) @ groups / groups.sum(axis=0)
            mu = np.maximum((mean @ groups.T) * size, 0.5)
            gene, trend_, var = (part[c].to_numpy(float) for c in ("gene_dispersion", "trend_dispersion", "prior_var"))
            mode = best_dispersion(y, mu, groups, trend_, var)
            beyond = np.log(gene) > np.log(trend_) + 2 * np.sqrt(part["spread"].to_numpy(float))
            final = np.where(beyond, gene, mode)
            means, info = group_means(y, size, groups, final)
            yield part[names].assign(dispersion=final, outlier=beyond, mean_num=means[:, 0], mean_den=means[:, 1],
                                     info_num=info[:, 0], info_den=info[:, 1])

    return given.mapInPandas(run, out)


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.2, robust: int = 3) -> np.ndarray:
    """Locally weighted lines (Cleveland 1979): tricube weights over the nearest points, bisquare weights of residuals."""
    n = len(x)
    near = max(min(int(share * n + 1e-7), n), 2)
    trust, fit = np.ones(n), np.zeros(n)
    for turn in range(robust + 1):
        for i in range(n):
            away = np.abs(x - x[i])
            reach = np.sort(away)[near - 1]
            w = np.where(away <= 0.999 * reach, (1 - (away / max(reach, 1e-300)) ** 3) ** 3, 0.0) * trust
            w = np.where(away <= 0.001 * reach, trust, w)
            if w.sum() <= 0:
                fit[i] = y[i]
                continue
            w = w / w.sum()
            mean = (w * x).sum()
            var = (w * (x - mean) ** 2).sum()
            if math.sqrt(var) > 0.001 * (x[-1] - x[0]):
                w = w * (1 + (x[i] - mean) * (x - mean) / var)
            fit[i] = (w * y).sum()
        rest = np.abs(y - fit)
        scale = 6 * np.median(rest)
        if turn == robust or scale < 1e-7 * rest.mean() or scale == 0:
            break
        trust = np.where(rest <= 0.001 * scale, 1.0, np.where(rest <= 0.999 * scale, (1 - (rest / scale) ** 2) ** 2, 0.0))
    return fit


def rejections(tested: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``study_id, step, theta, cutoff, rejected``: features whose adjusted p is below ``alpha`` if those under the theta
    quantile of the base mean leave. Only p values below ``alpha`` can be rejected, so only these are ranked."""
    # Range sorts: a study is any share of the features, and a step holds most of its study.
    ranked = range_scan(tested.select("study_id", "feature_id", "base_mean", "pvalue", F.lit(1).cast("long").alias("_r")),
                        ["study_id"], ["base_mean", "feature_id"], ["_r"])
    ranked = cut_lineage(ranked)
    n = ranked.groupBy("study_id").agg(F.count(F.lit(1)).alias("_n"), F.avg((F.col("base_mean") == 0).cast("double")).alias("_z"))
    top = F.when(F.col("_z") < 0.95, 0.95).otherwise(1.0)
    steps = n.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(THETAS - 1)))).withColumn(
        "theta", F.col("_z") + (top - F.col("_z")) * F.col("step") / (THETAS - 1)).withColumn("_h", (F.col("_n") - 1) * F.col("theta"))
    ends = ranked.select("study_id", F.col("_r").alias("_at"), "base_mean")
    low = steps.withColumn("_at", F.floor("_h") + 1).join(ends, ["study_id", "_at"]).withColumnRenamed("base_mean", "_lo").drop("_at")
    both = low.withColumn("_at", F.ceil("_h") + 1).join(ends, ["study_id", "_at"])
    cuts = cut_lineage(both.select(
        "study_id", "step", "theta", (F.col("_lo") + (F.col("base_mean") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("cutoff")))
    per_study = cuts.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("step", "cutoff"))).alias("_cuts"))
    passed = F.explode(F.filter("_cuts", lambda c: c["cutoff"] <= F.col("base_mean") + 1e-12)["step"]).alias("step")
    held = ranked.where(F.col("pvalue").isNotNull()).join(per_study, "study_id").select("study_id", "feature_id", "pvalue", passed)
    total = held.groupBy("study_id", "step").agg(F.count(F.lit(1)).alias("_m"))
    small = range_scan(held.where(F.col("pvalue") < alpha).withColumn("_i", F.lit(1).cast("long")),
                       ["study_id", "step"], ["pvalue", "feature_id"], ["_i"])
    hit = small.join(total, ["study_id", "step"]).where(F.col("pvalue") * F.col("_m") / F.col("_i") < alpha).groupBy(
        "study_id", "step").agg(F.max("_i").alias("rejected"))
    return cuts.join(hit, ["study_id", "step"], "left").select(
        "study_id", "step", "theta", "cutoff", F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


def threshold(steps: DataFrame) -> DataFrame:
    """``study_id, cutoff``: the first step whose rejections come within one root mean square residual of the smooth
    curve's top; no filter where no step rejects more than ten. A group is the fifty steps of a study."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        hits = pdf["rejected"].to_numpy(float)
        at = 0
        if hits.max() > 10:
            smooth = lowess(pdf["theta"].to_numpy(), hits)
            least = smooth.max() - math.sqrt(((hits - smooth)[hits > 0] ** 2).mean())
            above = np.flatnonzero(hits > least)
            at = int(above[0]) if len(above) else 0
        return pdf.iloc[[at]][["study_id", "cutoff"]]

    return steps.groupBy("study_id").applyInPandas(pick, steps.select("study_id", "cutoff").schema)


def differential_test(counts: DataFrame, samples: DataFrame, contrast: Contrast, round_values: bool = True,
                      min_total: float = 10.0, alpha: float = 0.1, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Fold change, Wald statistic, p and adjusted p of numerator over denominator, with all three dispersions.

    ``samples``: study_id, sample_id, grp. ``padj`` is NULL for features below the mean threshold of their study.
    """
    rows = feature_rows(counts, samples, contrast, round_values, min_total, hot_rows)
    # Fits take long for their bytes, by which adaptive merging goes: features are dealt over all tasks once, and stay there.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = cut_lineage(gene_wise(rows.repartition(tasks, F.xxhash64("study_id", "feature_id"))))
    design = fits.groupBy("study_id").agg(F.first("groups").alias("_g")).select(
        "study_id", (F.size("_g") - F.array_max("_g") - 1).alias("freedom"))
    genes = cut_lineage(fits.select("study_id", "feature_id", "base_mean", "gene_dispersion"))  # read by every step of the trend
    trend = fit_trend(genes)
    prior = cut_lineage(prior_of(genes, trend, design, hot_rows))
    fitted = shrunken(fits, trend, prior)
    error = F.sqrt(1.0 / F.col("info_num") + 1.0 / F.col("info_den")) / math.log(2.0)
    tested = fitted.withColumn("lfc", F.log2(F.col("mean_num") / F.col("mean_den"))).withColumn("lfc_se", error)
    tested = tested.withColumn("stat", F.col("lfc") / F.col("lfc_se")).withColumn("pvalue", two_sided_normal(F.col("stat")))
    tested = cut_lineage(tested.drop("mean_num", "mean_den", "info_num", "info_den"))
    cutoff = threshold(rejections(tested, alpha))
    kept = tested.join(cutoff, "study_id").withColumn("_p", F.when(F.col("base_mean") >= F.col("cutoff") - 1e-12, F.col("pvalue")))
    return adjust_p(kept, ["study_id"], "_p", "padj", hot_rows=hot_rows).drop("_p", "cutoff")
