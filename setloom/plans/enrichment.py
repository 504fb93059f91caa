"""Counts to enrichment table, variants to over-representation, alignments to matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kept_chrom, normal_chrom, parse_locus
from ..operators import de, gsea, intervals as iv, matrix as mx
from ..operators.ora import run_ora
from ..operators.sets import retain_specific
from ..params import Contrast


def differential_enrichment(
    counts: DataFrame,
    samples: DataFrame,
    sets: DataFrame,
    contrast: Contrast,
    annotation: DataFrame | None = None,
    exons: DataFrame | None = None,
    max_share: float | None = 0.1,
    min_specific: int = 50,
    min_size: int = 100,
    permutations: int = 10_000,
    seed: int = 1,
) -> dict[str, DataFrame]:
    """Filter, test and rank the features of every study, then score the set collection.

    Without ``annotation`` this is the gene-level run; ``max_share=None`` leaves the sets as
    they are.
    """
    if annotation is not None:
        kept = mx.preprocess(counts, annotation, samples, exons, filter_low=True)["counts"]
    else:
        kept = mx.expression_filter(counts, samples)
    tested = de.nb_wald(kept, samples, contrast)
    weights = de.ranking_weights(tested)
    used = sets if max_share is None else retain_specific(sets, max_share, min_specific)
    return {
        "counts": kept, "differential": tested, "weights": weights,
        "enrichment": gsea.run_enrichment(weights, used, min_size, permutations, seed),
    }


def locate_variants(
    inputs: DataFrame, variants: DataFrame | None = None, mode: str = "auto", sex_chromosomes: bool = False,
    style: str = "chr",
) -> DataFrame:
    """Positions of variant inputs: (id, chrom, start, end), chromosomes normalised and filtered.

    ``inputs`` has a text column ``input`` (rsIDs and locus strings), or columns chrom + pos,
    or chrom + start + end (any letter case). ``variants`` resolves rsIDs.
    """
    lower = {c.lower(): c for c in inputs.columns}
    chrom = lower.get("chr") or lower.get("chrom")
    if mode == "dataframe" or "input" not in lower:
        if not chrom or not ("pos" in lower or {"start", "end"} <= set(lower)):
            raise ValueError("inputs need chrom + pos or chrom + start + end columns")
        c = F.col(chrom).cast("string")
        if "pos" in lower:
            p = F.col(lower["pos"])
            found = inputs.select(F.concat(c, F.lit(":"), p.cast("string")).alias("id"), c.alias("chrom"),
                                  p.try_cast("long").alias("start"), p.try_cast("long").alias("end"))
        else:
            s, e = F.col(lower["start"]), F.col(lower["end"])
            found = inputs.select(
                F.concat(c, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string")).alias("id"), c.alias("chrom"),
                s.try_cast("long").alias("start"), e.try_cast("long").alias("end"))
    else:
        text = inputs.select(F.col("input").cast("string").alias("input")).where(F.coalesce("input", F.lit("")) != "").distinct()
        is_rs = F.col("input").rlike(r"(?i)^rs\d+$")
        loci = text if mode == "loc_string" else text.where(~is_rs)
        parsed = loci.select("input", parse_locus(F.col("input")).alias("l")).where(F.col("l").isNotNull())
        found = parsed.select(F.col("input").alias("id"), "l.chrom", "l.start", "l.end")
        if mode == "rsid":
            found = found.limit(0)
        if mode in ("rsid", "auto") and variants is not None:
            ids = (text if mode == "rsid" else text.where(is_rs)).select(F.col("input").alias("rsid"))
            found = found.unionByName(iv.lookup_variants(ids, variants).select("id", "chrom", "start", "end"))
    ok = kept_chrom(F.col("chrom"), sex_chromosomes) & F.col("start").isNotNull() & F.col("end").isNotNull()
    return found.where(ok).withColumn("chrom", normal_chrom(F.col("chrom"), style))


def variants_to_regions(
    inputs: DataFrame, regions: DataFrame, variants: DataFrame | None = None, mode: str = "auto",
    sex_chromosomes: bool = False, style: str = "chr",
) -> DataFrame:
    """Distinct (input_id, annotation_id) pairs of variant inputs and annotation regions."""
    located = locate_variants(inputs, variants, mode, sex_chromosomes, style)
    named = regions.withColumn("chrom", normal_chrom(F.col("chrom"), style))
    return iv.map_points(located, named)


def variant_over_representation(
    inputs: DataFrame, regions: DataFrame, sets: DataFrame, variants: DataFrame | None = None, study_id: str = "S",
    draws: int = 10_000, seed: int = 123, alpha: float = 0.05, p_adjust_method: str | None = "BH", **locate,
) -> DataFrame:
    """Variants to regions to sets: the complete over-representation table of one query."""
    hit = variants_to_regions(inputs, regions, variants, **locate)
    query = hit.select(F.lit(study_id).alias("study_id"), F.col("annotation_id").cast("string").alias("member")).distinct()
    return run_ora(sets, query, draws, seed, alpha, p_adjust_method)


def quantify(reads: DataFrame, features: DataFrame, stranded: int = 0, study_id: str = "S") -> dict[str, DataFrame]:
    """Counts, CPM, TPM and RPKM of features from aligned reads given as intervals."""
    counts, status = iv.count_reads(reads, features, stranded)
    counts = counts.select(F.lit(study_id).alias("study_id"), "feature_id", "sample_id", "value")
    lengths = iv.union_length(features, ["feature_id"])
    return {
        "featureCounts": counts, "unlog.cpm": mx.cpm(counts), "unlog.tpm": mx.tpm(counts, lengths),
        "unlog.rpkm": mx.rpkm(counts, lengths), "status": status,
    }
