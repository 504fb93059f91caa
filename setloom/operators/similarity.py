"""Similarity of sets by leading edge, and the helper selection built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import neg_log10, unit_scale
from ..session import cut_lineage
from .scan import group_quantile, ordered_scan
from .sets import KEY, pair_counts


def edge_members(result: DataFrame, column: str = "leading_edge") -> DataFrame:
    """Leading edges unfolded to distinct (study_id, set_name, member)."""
    return result.select(*KEY, F.explode(column).alias("member")).where(F.col("member") != "").distinct()


def cosine_pairs(members: DataFrame) -> DataFrame:
    """Cosine of the binary member vectors of every pair of sets that share a member. Repeated rows count once.

    The size of a set travels behind its name (a zero sign between them, which leaves the order of names as it is), so that
    the pairs, of which there are many more than members, need not be joined with it.
    """
    sign = "\0"
    of_set = members.select(*KEY, "member").repartition(*KEY).distinct()
    size = F.count(F.lit(1)).over(Window.partitionBy(*KEY)).cast("string")
    sized = of_set.select("study_id", F.concat("set_name", F.lit(sign), size).alias("id"), "member")
    name, n = (lambda c: F.substring_index(c, sign, 1)), (lambda c: F.substring_index(c, sign, -1).cast("long"))
    return pair_counts(sized).select(
        "study_id", name("a").alias("from"), name("b").alias("to"), (F.col("n") / F.sqrt(n("a") * n("b"))).alias("similarity"))


def similarity_network(
    result: DataFrame, threshold: float = 0.1, node_size: float = 20.0
) -> tuple[DataFrame, DataFrame]:
    """Edges with similarity strictly above the threshold, and all sets as nodes."""
    edges = cosine_pairs(edge_members(result)).where(F.col("similarity") > threshold)
    nodes = result.select(
        "study_id", F.col("set_name").alias("id"), (F.lit(node_size) * F.abs("nes")).alias("size"),
        F.when(F.col("nes") > 0, "Up").otherwise("Down").alias("type"))
    return nodes, edges


def elbow_cut(result: DataFrame, q: str = "q_value") -> DataFrame:
    """q at the elbow of the -log10 q curve of each study: (study_id, q_elbow).

    Equal q give equal heights, so the first of them has the largest gap: it is enough to
    keep each distinct q with its first rank.
    """
    per_q = result.groupBy("study_id", F.col(q).alias("_q")).agg(F.count(F.lit(1)).alias("_c"))
    height = neg_log10(F.col("_q"))
    ends = per_q.groupBy("study_id").agg(F.sum("_c").alias("_n"), F.max(height).alias("_hi"), F.min(height).alias("_lo"))
    curve = ordered_scan(per_q, ["study_id"], [F.col("_q")], None, {"_upto": F.col("_c")}).join(ends, "study_id").select(
        "study_id", "_q", (F.col("_upto") - F.col("_c")).alias("_before"), "_n", height.alias("_y"), "_hi", "_lo")
    x = F.when(F.col("_n") > 1, F.col("_before") / (F.col("_n") - 1)).otherwise(0.0)
    gap = F.round((1.0 - unit_scale(F.col("_y"), F.col("_lo"), F.col("_hi"))) - x, 12)
    return curve.groupBy("study_id").agg(
        F.max_by("_q", F.struct(gap.alias("g"), (-F.col("_before")).alias("r"))).alias("q_elbow"))


def connectivity(result: DataFrame) -> DataFrame:
    """Sum of cosine similarities of each set to all others: (study_id, set_name, connectivity).

    NULL for a study in which no set has a leading edge.
    """
    members = edge_members(result)
    pairs = cosine_pairs(members)
    both = pairs.select("study_id", F.explode(F.array("from", "to")).alias("set_name"), "similarity")
    total = both.groupBy(*KEY).agg(F.sum("similarity").alias("_c"))
    any_member = members.select("study_id").distinct().withColumn("_any", F.lit(True))
    return result.select(*KEY).join(total, KEY, "left").join(any_member, "study_id", "left").select(
        *KEY, F.when(F.col("_any"), F.coalesce("_c", F.lit(0.0))).alias("connectivity"))


def select_helpers(
    result: DataFrame,
    q_cut: float = 0.05,
    use_elbow: bool = True,
    use_connectivity: bool = True,
    k_mad: float = 0.0,
) -> DataFrame:
    """q filter (finite, strictly below), elbow cut, then connectivity >= median + k * MAD."""
    q = F.col("q_value")
    kept = result.where(q.isNotNull() & ~F.isnan(q) & (q < q_cut) & (F.abs(q) < float("inf")))
    if use_elbow:
        kept = kept.join(elbow_cut(kept), "study_id").where(q <= F.col("q_elbow")).drop("q_elbow")
    # One row per set from here on, read by several steps.
    kept = cut_lineage(kept)
    if not use_connectivity:
        return kept.withColumn("connectivity", F.lit(None).cast("double"))
    scored = cut_lineage(kept.join(connectivity(kept), KEY).withColumn("_c", F.round("connectivity", 12)))
    known = scored.where(F.col("_c").isNotNull()).select("study_id", "_c")
    med = group_quantile(known, ["study_id"], "_c", 0.5, "_med")
    dev = known.join(med, "study_id").select("study_id", F.abs(F.col("_c") - F.col("_med")).alias("_d"))
    mad = group_quantile(dev, ["study_id"], "_d", 0.5, "_mad")
    j = scored.join(med, "study_id", "left").join(mad, "study_id", "left")
    cut = F.col("_med") + F.lit(float(k_mad)) * F.col("_mad")
    return j.where(F.col("_c").isNull() | (F.col("_c") >= cut - 1e-12)).drop("_c", "_med", "_mad")


def order_helpers(selected: DataFrame) -> DataFrame:
    return selected.orderBy("study_id", "q_value", F.col("connectivity").desc_nulls_last(), "set_name")
