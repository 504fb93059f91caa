"""Over-representation: counts, hypergeometric tail, permutation test, top annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hypergeom_tail
from ..session import cut_lineage
from .scan import adjust_p
from .sets import KEY, clean_sets, pair_counts


def ora_counts(sets: DataFrame, query: DataFrame) -> DataFrame:
    """N (universe), M (set), K (query in universe) and x (query in set) per set.

    ``sets``: study_id, set_name, member (cleaned); ``query``: study_id, member. One
    shuffle on (study, member) serves both the overlap and the universe.
    """
    q = query.select("study_id", F.col("member").cast("string").alias("member")).distinct()
    marked = sets.join(q.withColumn("_hit", F.lit(1)), ["study_id", "member"], "left")
    per_member = marked.groupBy("study_id", "member").agg(F.max("_hit").alias("_hit"))
    totals = per_member.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("N"), F.count("_hit").alias("K"))
    per_set = marked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("M"), F.count("_hit").alias("x"))
    return per_set.join(totals, "study_id").select(*KEY, "N", "M", "K", "x")


def with_hypergeometric(counts: DataFrame) -> DataFrame:
    """p_hyper = P(X >= x); NULL for a study whose query misses the universe."""
    p = hypergeom_tail(F.col("N"), F.col("M"), F.col("K"), F.col("x"))
    return counts.withColumn("p_hyper", F.when(F.col("K") > 0, p))


def empirical_p(counts: DataFrame, draws: int = 10_000, seed: int = 123) -> DataFrame:
    """(1 + #draws with overlap >= x) / (1 + draws) for random K-subsets of the universe.

    The overlap of a set with a random K-subset is hypergeometric, so each set draws its overlaps from that law, whatever
    the sizes: one row per set goes in, and no membership moves.
    """
    def run(batches):
        import pandas as pd

        from .sampling import overlaps_at_least, seeded

        for pdf in batches:
            ge = [overlaps_at_least(seeded(seed, r.study_id, r.set_name), r.N, r.M, r.K, r.x, draws)
                  for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"study_id": pdf["study_id"], "set_name": pdf["set_name"], "ge": ge})

    live = counts.where(F.col("K") > 0).select(*KEY, "N", "M", "K", "x").repartition(*KEY)
    counted = live.mapInPandas(run, "study_id string, set_name string, ge long")
    return counted.select(*KEY, ((F.col("ge") + 1) / F.lit(draws + 1.0)).alias("p_empirical"))


def run_ora(
    sets: DataFrame,
    query: DataFrame,
    draws: int = 10_000,
    seed: int = 123,
    alpha: float = 0.05,
    p_adjust_method: str | None = "BH",
) -> DataFrame:
    """Complete over-representation table of every study."""
    clean = clean_sets(sets)
    # One row per set, read by several steps below.
    counts = cut_lineage(with_hypergeometric(ora_counts(clean, query)))
    emp = empirical_p(counts, draws, seed)
    # One row per set: kept, so that the draws are never made twice.
    out = cut_lineage(counts.join(emp, KEY, "left"))
    if p_adjust_method is None:
        out = out.withColumn("p_empirical_adj", F.lit(None).cast("double"))
        judged = F.col("p_empirical")
    else:
        out = adjust_p(out, ["study_id"], "p_empirical", "p_empirical_adj", p_adjust_method)
        judged = F.col("p_empirical_adj")
    return out.select(
        *KEY, "N", "M", "K", "x", "p_hyper", "p_empirical", "p_empirical_adj",
        F.coalesce(judged <= alpha, F.lit(False)).alias("significant"))


def order_ora(result: DataFrame) -> DataFrame:
    """Report order: adjusted p, empirical p, hypergeometric p, larger overlap first; NULL last."""
    lead = F.coalesce("p_empirical_adj", "p_empirical")
    return result.orderBy(
        "study_id", lead.asc_nulls_last(), F.col("p_empirical").asc_nulls_last(),
        F.col("p_hyper").asc_nulls_last(), F.col("x").desc(), "set_name")


# Rows of members and genes that one task makes distinct.
GENE_ROWS = 500_000


def members_to_genes(edges: DataFrame, association: DataFrame, rows_per_task: int = GENE_ROWS) -> DataFrame:
    """Genes associated with the members of each helper: distinct (study, helper, gene).

    A few bytes of members unfold into many genes, so the number of tasks goes by the rows that the join makes, which are
    counted beforehand, and rows are told apart only after they are dealt by helper.
    """
    a = association.select(F.col("GHid").cast("string").alias("member"), F.col("symbol").cast("string").alias("gene"))
    a = cut_lineage(a.where(F.coalesce("gene", F.lit("")) != "").distinct())
    edges = cut_lineage(edges)
    mine, theirs = (df.groupBy("member").agg(F.count(F.lit(1)).alias(n)) for df, n in ((edges, "_m"), (a, "_t")))
    rows = mine.join(theirs, "member").agg(F.sum(F.col("_m") * F.col("_t"))).first()[0] or 0
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
    met = edges.repartition(tasks, "member").join(a.repartition(tasks, "member"), "member")
    dealt = met.select("study_id", "helper", "gene").repartition(tasks, "study_id", "helper")
    return dealt.distinct()


def annotate_top1(
    helpers: DataFrame,
    edges: DataFrame,
    association: DataFrame,
    gene_sets: DataFrame,
    min_size: int = 10,
    max_size: int = 500,
    alpha: float = 0.1,
    default_label: str = "no significant HALLMARK annotation",
) -> DataFrame:
    """Best gene set of each helper by hypergeometric test, BH over all sets of the helper.

    ``helpers``: study_id, helper; ``edges``: study_id, helper, member (leading edge);
    ``gene_sets``: set_ord, set_name, member. Sets without overlap take part in the
    adjustment, but their p depends on their size only, so they enter as one weighted row
    per set size (at most max_size - min_size + 1 rows per helper) instead of one row per
    set. An overlap of 0 is tested like an overlap of 1, as in the original procedure.
    """
    genes = cut_lineage(members_to_genes(edges.distinct(), association))
    pool = association.select(F.col("symbol").cast("string").alias("member")).where(
        F.coalesce("member", F.lit("")) != "").distinct()
    n_pool = pool.agg(F.count(F.lit(1))).scalar()
    named = gene_sets.select("set_ord", "set_name", F.col("member").cast("string").alias("member")).distinct()
    inside = named.join(pool, "member", "left_semi")
    sized = inside.groupBy("set_ord", "set_name").agg(F.count(F.lit(1)).alias("a")).where(
        F.col("a").between(min_size, max_size))
    # Sets of one size are numbered in input order; the size classes are bounded by the parameters.
    ordered = sized.withColumn(
        "_pos", F.row_number().over(Window.partitionBy("a").orderBy("set_ord", "set_name")))
    classes = ordered.groupBy("a").agg(F.count(F.lit(1)).alias("_sets"), F.min("set_ord").alias("_first"))
    class_list = classes.agg(F.array_sort(F.collect_list(F.struct("a", "_sets")))).scalar()

    b = genes.groupBy("study_id", "helper").agg(F.count(F.lit(1)).alias("b"))
    tested = inside.join(ordered.select("set_ord", "set_name"), ["set_ord", "set_name"], "left_semi")
    # The length of the study tells the two apart again; genes of no tested set share nothing.
    both = F.concat(F.length("study_id").cast("string"), F.lit(":"), "study_id", "helper")
    left = genes.join(tested.select(F.col("member").alias("gene")).distinct(), "gene", "left_semi").select(
        F.lit("x").alias("study_id"), both.alias("id"), F.col("gene").alias("member"))
    right = tested.select(F.lit("x").alias("study_id"), F.col("set_ord").cast("string").alias("id"), "member")
    digits = F.substring_index("a", ":", 1)
    start, long = F.length(digits) + 2, digits.cast("int")
    shared = pair_counts(left, right).select(
        F.substr("a", start, long).alias("study_id"), F.substr("a", start + long, F.length("a")).alias("helper"),
        F.col("b").cast("long").alias("set_ord"), F.col("n").alias("k"))
    # Overlapping (helper, set) pairs, read twice below.
    met = cut_lineage(shared.join(ordered, "set_ord").join(b, ["study_id", "helper"]))

    used = met.groupBy("study_id", "helper", "a").agg(
        F.array_sort(F.collect_list("_pos")).alias("_taken"))
    # First free number of a size class: the smallest i with taken[i] <> i.
    gap = F.array_position(F.transform("_taken", lambda v, i: v == i + 1), False).cast("int")
    free = F.when(F.col("_taken").isNull(), 1).when(gap > 0, gap).otherwise(F.size("_taken") + 1)
    spread = b.withColumn("_cls", class_list).select(
        "study_id", "helper", "b", F.explode("_cls").alias("_c")).select("study_id", "helper", "b", "_c.a", "_c._sets")
    idle = spread.join(used, ["study_id", "helper", "a"], "left").select(
        "study_id", "helper", "b", "a",
        (F.col("_sets") - F.coalesce(F.size("_taken"), F.lit(0))).alias("w"), free.alias("_pos"), F.lit(0).cast("long").alias("k"),
    ).where(F.col("w") > 0)
    rows = met.select("study_id", "helper", "b", "a", F.lit(1).cast("long").alias("w"), "_pos", "k").unionByName(
        idle.select("study_id", "helper", "b", "a", F.col("w").cast("long").alias("w"), "_pos", "k"))
    rows = rows.withColumn("_N", n_pool).withColumn(
        "p", hypergeom_tail(F.col("_N"), F.col("a"), F.col("b"), F.greatest(F.lit(1).cast("long"), F.col("k"))))
    named_rows = rows.join(ordered.select("a", "_pos", "set_ord", "set_name"), ["a", "_pos"])
    per_p = named_rows.groupBy("study_id", "helper", "p").agg(
        F.sum("w").alias("_w"), F.min(F.struct("set_ord", "set_name")).alias("_best"))
    w = Window.partitionBy("study_id", "helper").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("study_id", "helper")
    q = per_p.withColumn("_cum", F.sum("_w").over(w)).withColumn("_m", F.sum("_w").over(whole))
    top = q.groupBy("study_id", "helper").agg(
        F.min(F.least(F.lit(1.0), F.col("p") * F.col("_m") / F.col("_cum"))).alias("top_q"),
        F.min_by("_best", "p").alias("_best"))
    label = F.when(F.col("top_q") < alpha, F.col("_best.set_name")).otherwise(F.lit(default_label))
    return helpers.join(top, ["study_id", "helper"], "left").select(
        *helpers.columns, "top_q", label.alias("top_hallmark"))
