"""Two-sided network between enhancer-set results and gene-set results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import neg_log10, range_scale

# Column positions of the two sides.
LEFT_X, RIGHT_X = 0.25, 0.75


def top_sets(result: DataFrame, n: int | None = 10, signed_q_cut: float | None = None) -> DataFrame:
    """First n sets of a study by (q, larger |signed q|); ``ord`` breaks the remaining ties."""
    kept = result.where(F.col("set_name").isNotNull())
    if signed_q_cut is not None:
        kept = kept.where(F.abs("signed_q_value") >= signed_q_cut)
    w = Window.partitionBy("study_id").orderBy(
        F.col("q_value").asc_nulls_last(), F.abs("signed_q_value").desc_nulls_last(), "ord")
    ranked = kept.withColumn("_r", F.row_number().over(w))
    return (ranked if n is None else ranked.where(F.col("_r") <= n)).drop("_r")


def top_pathways(result: DataFrame, n: int | None = 15) -> DataFrame:
    """First n gene sets of a study by |NES|."""
    kept = result.where(F.col("set_name").isNotNull())
    w = Window.partitionBy("study_id").orderBy(F.abs("nes").desc_nulls_last(), "ord")
    ranked = kept.withColumn("_r", F.row_number().over(w))
    return (ranked if n is None else ranked.where(F.col("_r") <= n)).drop("_r")


def link_results(
    esea: DataFrame,
    gsea: DataFrame,
    fisher: DataFrame,
    n_sets: int | None = 10,
    n_pathways: int | None = 15,
    signed_q_cut: float | None = None,
    fisher_cut: float = 0.1,
    fdr_cut: float = 1e-3,
    left_sizes: tuple[float, float] = (4.0, 12.0),
    right_size: float = 6.0,
) -> dict[str, DataFrame]:
    """Scores, edges, nodes and the selected rows of both sides.

    ``esea``/``gsea``: study_id, ord, set_name, nes, q_value, signed_q_value; ``fisher``:
    study_id, enh_set, gene_set, p_adj. Only non-zero scores are stored (``scores``).
    """
    import math

    pick_e = top_sets(esea, n_sets, signed_q_cut)
    pick_g = top_pathways(gsea, n_pathways)
    p = F.col("p_adj")
    passed = fisher.where(p.isNotNull() & ~F.isnan(p) & (p <= fisher_cut))
    # A side is the set of names that pass on the Fisher table, whatever their partner is.
    names_e = pick_e.select("study_id", F.col("set_name").alias("enh_set")).distinct()
    names_g = pick_g.select("study_id", F.col("set_name").alias("gene_set")).distinct()
    right = passed.select("study_id", "enh_set").distinct().join(names_e, ["study_id", "enh_set"], "left_semi")
    left = passed.select("study_id", "gene_set").distinct().join(names_g, ["study_id", "gene_set"], "left_semi")
    scores = passed.join(right, ["study_id", "enh_set"], "left_semi").join(
        left, ["study_id", "gene_set"], "left_semi").groupBy("study_id", "enh_set", "gene_set").agg(
        F.max(neg_log10(p)).alias("weight")).where(F.col("weight") > 0)

    nes = pick_g.groupBy("study_id", F.col("set_name").alias("gene_set")).agg(F.min_by("nes", "ord").alias("nes"))
    l = left.join(nes, ["study_id", "gene_set"]).withColumn("_a", F.abs("nes"))
    span = l.groupBy("study_id").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    wl = Window.partitionBy("study_id").orderBy(F.col("_a").desc_nulls_last(), "gene_set")
    left_nodes = l.join(span, "study_id").select(
        "study_id", F.col("gene_set").alias("name"), F.lit("GSEA").alias("side"), "nes",
        F.when(F.col("nes").isNull() | (F.col("nes") < 0), "neg").otherwise("pos").alias("nes_sign"),
        range_scale(F.col("_a"), F.col("_lo"), F.col("_hi"), left_sizes).alias("size"),
        F.lit(LEFT_X).alias("x"), (F.col("_n") - F.row_number().over(wl) + 1).cast("double").alias("y"))

    strength = right.join(
        scores.groupBy("study_id", "enh_set").agg(F.sum("weight").alias("strength")), ["study_id", "enh_set"], "left"
    ).withColumn("strength", F.round(F.coalesce("strength", F.lit(0.0)), 12))
    n_right = right.groupBy("study_id").agg(F.count(F.lit(1)).alias("_n"))
    wr = Window.partitionBy("study_id").orderBy(F.col("strength").desc(), "enh_set")
    right_nodes = strength.join(n_right, "study_id").select(
        "study_id", F.col("enh_set").alias("name"), F.lit("ESEA").alias("side"),
        F.lit(None).cast("double").alias("nes"), F.lit(None).cast("string").alias("nes_sign"),
        F.lit(float(right_size)).alias("size"), F.lit(RIGHT_X).alias("x"),
        (F.col("_n") - F.row_number().over(wr) + 1).cast("double").alias("y"))

    edges = scores.where(F.col("weight") >= -math.log10(fdr_cut)).select(
        "study_id", F.col("gene_set").alias("from"), F.col("enh_set").alias("to"), "weight",
        F.pow(F.lit(10.0), -F.col("weight")).alias("fdr"))
    return {
        "scores": scores,
        "edges": edges,
        "nodes": left_nodes.unionByName(right_nodes),
        "selected_sets": pick_e.join(right.withColumnRenamed("enh_set", "set_name"), ["study_id", "set_name"], "left_semi"),
        "selected_pathways": pick_g.join(
            left.withColumnRenamed("gene_set", "set_name"), ["study_id", "set_name"], "left_semi"),
    }
