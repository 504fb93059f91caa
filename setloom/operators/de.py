"""Differential tests on counts: negative-binomial Wald test with moment dispersion.

Size factors, group means and ranking weights follow the published definitions. The
dispersion is the pooled within-group moment estimate, without trend or shrinkage, so the
p values are not those of packages that shrink it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import de_weight, two_sided_normal
from ..params import Contrast
from ..session import cut_lineage
from .matrix import low_count_filter, n_samples, round_counts
from .scan import HOT_ROWS, adjust_p, group_quantile


def size_factors(counts: DataFrame, samples: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Median of ratios to the geometric mean, over features without a zero."""
    row = Window.partitionBy("study_id", "feature_id")
    cells = counts.where(F.col("value") > 0).withColumn("_ln", F.ln("value")).withColumn(
        "_k", F.count(F.lit(1)).over(row)).withColumn("_lg", F.avg("_ln").over(row))
    ratio = cells.join(n_samples(samples), "study_id").where(F.col("_k") == F.col("n_samples")).select(
        "study_id", "sample_id", (F.col("_ln") - F.col("_lg")).alias("_r"))
    ratio = cut_lineage(ratio)
    mid = group_quantile(ratio, ["study_id", "sample_id"], "_r", 0.5, "_mid", hot_rows=hot_rows)
    # One row per sample: kept, because every later step reads it again.
    return cut_lineage(mid.select("study_id", "sample_id", F.exp("_mid").alias("size_factor")))


def nb_wald(
    counts: DataFrame,
    samples: DataFrame,
    contrast: Contrast,
    round_values: bool = True,
    min_total: float = 10.0,
    min_base_mean: float = 0.0,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """log2 fold change of numerator over denominator with Wald statistic, p and BH-adjusted p.

    ``samples``: study_id, sample_id, grp. A group mean of zero is floored at half a count
    per group, so that the fold change stays finite.
    """
    used = counts.join(samples.select("study_id", "sample_id"), ["study_id", "sample_id"], "left_semi")
    used = round_counts(used) if round_values else used
    used = low_count_filter(used.where(F.col("value") != 0), min_total)
    sf = size_factors(used, samples, hot_rows)
    meta = samples.join(sf, ["study_id", "sample_id"])
    groups = meta.groupBy("study_id", "grp").agg(
        F.count(F.lit(1)).alias("_ng"), F.sort_array(F.collect_list("size_factor")).alias("_sf"))
    design = groups.groupBy("study_id").agg(
        F.sum("_ng").alias("_n"), F.count(F.lit(1)).alias("_g"),
        F.map_from_entries(F.collect_list(F.struct("grp", "_ng"))).alias("_sizes"),
        F.map_from_entries(F.collect_list(F.struct("grp", "_sf"))).alias("_factors"))
    xim = meta.groupBy("study_id").agg(F.avg(1.0 / F.col("size_factor")).alias("_xim"))

    cells = used.join(meta, ["study_id", "sample_id"]).withColumn("_y", F.col("value") / F.col("size_factor"))
    per_group = cells.groupBy("study_id", "feature_id", "grp").agg(
        F.count(F.lit(1)).alias("_k"), F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v"))
    g = per_group.join(design, "study_id")
    ng = F.element_at("_sizes", F.col("grp"))
    spread = F.col("_k") * F.col("_v") + F.col("_m") * F.col("_m") * F.col("_k") * (ng - F.col("_k")) / ng
    total = F.col("_k") * F.col("_m")
    folded = g.groupBy("study_id", "feature_id").agg(
        F.sum(total).alias("_sum"), F.sum(spread).alias("_ss"),
        F.sum(F.when(F.col("grp") == contrast.numerator, total)).alias("_num"),
        F.sum(F.when(F.col("grp") == contrast.denominator, total)).alias("_den"),
    ).join(design, "study_id").join(xim, "study_id")
    n_num = F.element_at("_sizes", F.lit(contrast.numerator))
    n_den = F.element_at("_sizes", F.lit(contrast.denominator))
    base = F.col("_sum") / F.col("_n")
    var = F.col("_ss") / (F.col("_n") - F.col("_g"))
    alpha = F.greatest(F.lit(1e-8), (var - F.col("_xim") * base) / (base * base))
    mu_num = F.greatest(F.coalesce("_num", F.lit(0.0)), F.lit(0.5)) / n_num
    mu_den = F.greatest(F.coalesce("_den", F.lit(0.0)), F.lit(0.5)) / n_den
    core = folded.select(
        "study_id", "feature_id", base.alias("base_mean"), alpha.alias("dispersion"),
        mu_num.alias("_mu1"), mu_den.alias("_mu0"), "_factors")

    def information(mu, name):
        return F.aggregate(
            F.element_at("_factors", F.lit(name)), F.lit(0.0),
            lambda acc, s: acc + (s * mu) / (1.0 + F.col("dispersion") * s * mu))

    i1 = information(F.col("_mu1"), contrast.numerator)
    i0 = information(F.col("_mu0"), contrast.denominator)
    wald = core.select(
        "study_id", "feature_id", "base_mean", "dispersion",
        F.log2(F.col("_mu1") / F.col("_mu0")).alias("lfc"),
        (F.sqrt(1.0 / i1 + 1.0 / i0) / math.log(2.0)).alias("lfc_se"))
    wald = wald.withColumn("stat", F.col("lfc") / F.col("lfc_se")).withColumn(
        "pvalue", two_sided_normal(F.col("stat")))
    # One row per feature from here on.
    tested = cut_lineage(wald).withColumn("_p", F.when(F.col("base_mean") >= min_base_mean, F.col("pvalue")))
    return adjust_p(tested, ["study_id"], "_p", "padj", hot_rows=hot_rows).drop("_p")



def order_results(result: DataFrame) -> DataFrame:
    return result.orderBy("study_id", F.col("padj").asc_nulls_last(), "feature_id")


def ranking_weights(result: DataFrame) -> DataFrame:
    """Signed -log10 p of each feature; missing statistics give 0."""
    return result.select("study_id", "feature_id", de_weight(F.col("stat"), F.col("pvalue")).alias("weight"))
