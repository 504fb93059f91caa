"""Feature x sample tables in long form: (study_id, feature_id, sample_id, value).

Zero cells are not stored. Anything that averages over samples takes the number of samples
from the sample table (study_id, sample_id, grp), never from the rows present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import HOT_ROWS, group_quantile, group_quantiles, has_hot_group, ordered_scan

CELL = ["study_id", "feature_id", "sample_id"]


def _row():
    return Window.partitionBy("study_id", "feature_id")


def keep_annotated(counts: DataFrame, annotation: DataFrame, id_col: str = "id") -> DataFrame:
    return counts.join(annotation.select(F.col(id_col).alias("feature_id")), "feature_id", "left_semi")


def align_samples(counts: DataFrame, samples: DataFrame, strict: bool = True) -> DataFrame:
    """Restrict the counts to the samples of the metadata.

    With ``strict`` a metadata sample without any count row fails the job.
    """
    kept = counts.join(samples.select("study_id", "sample_id"), ["study_id", "sample_id"], "left_semi")
    if not strict:
        return kept
    missing = missing_samples(counts, samples).agg(
        F.assert_true(F.count(F.lit(1)) == 0, F.concat(
            F.lit("counts are missing samples: "),
            F.array_join(F.slice(F.array_sort(F.collect_list("sample_id")), 1, 3), ", ")))
    ).scalar()
    return kept.withColumn("_ok", missing).where(F.col("_ok").isNull()).drop("_ok")


def missing_samples(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Metadata samples that have no row in the counts."""
    return samples.join(counts.select("study_id", "sample_id").distinct(), ["study_id", "sample_id"], "left_anti")


def filter_samples(samples: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Metadata rows of the wanted sources; a missing group is the source with ``_`` for blanks."""
    out = samples.where(F.col("source_name").isin(sources)) if sources else samples
    derived = F.translate("source_name", " ", "_")
    grp = F.coalesce("grp", derived) if "grp" in samples.columns else derived
    return out.withColumn("grp", grp)


def group_loci(
    counts: DataFrame,
    mapping: DataFrame,
    agg: str = "trimmed_mean",
    trim: float = 0.1,
    tol: float = 1e-12,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Collapse locus rows to their mapped id: ``sum``, ``mean`` or ``trimmed_mean``.

    ``counts``: study_id, locus_id, sample_id, value; ``mapping``: study_id, locus_id,
    feature_id, one row per mapped locus of the matrix. Absent cells count as zeros. With
    ``trim`` at or above one half the result is the median.
    """
    sizes = mapping.groupBy("study_id", "feature_id").agg(F.count(F.lit(1)).alias("_n"))
    cells = counts.where(F.col("value") != 0).join(mapping, ["study_id", "locus_id"])
    if agg == "sum":
        return cells.groupBy(*CELL).agg(F.sum("value").alias("value"))
    if agg == "mean":
        total = cells.groupBy(*CELL).agg(F.sum("value").alias("_s"))
        return total.join(sizes, ["study_id", "feature_id"]).select(*CELL, (F.col("_s") / F.col("_n")).alias("value"))
    if agg != "trimmed_mean":
        raise ValueError(f"unknown aggregate: {agg}")
    ranked = ordered_scan(cells, CELL, [F.col("value"), F.col("locus_id")], "_r", hot_rows=hot_rows)
    nnz = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_nnz")).join(sizes, ["study_id", "feature_id"])
    j = ranked.join(nnz, CELL)
    n = F.col("_n")
    k = F.floor((n - 1) / 2) if trim >= 0.5 else F.floor(F.lit(float(trim)) * n)
    at = F.when(F.col("value") < 0, F.col("_r")).otherwise(F.col("_r") + n - F.col("_nnz"))
    inner = F.when((at > k) & (at <= n - k), F.col("value")).otherwise(0.0)
    out = j.groupBy(*CELL).agg((F.sum(inner) / F.max(n - 2 * k)).alias("value"))
    return out.where(F.abs("value") > tol)


def duplicated_targets(mapping: DataFrame) -> DataFrame:
    """Mapped ids that more than one locus maps to."""
    return mapping.groupBy("study_id", "feature_id").agg(F.count(F.lit(1)).alias("loci")).where("loci > 1")


def rename_loci(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows renamed to their mapped id; two loci on one id fail the job."""
    one = mapping.groupBy("study_id", "feature_id").agg(
        F.min("locus_id").alias("locus_id"),
        F.assert_true(F.count(F.lit(1)) == 1,
                      F.lit("duplicated ids after mapping; collapse the rows instead")).alias("_ok"),
    ).where(F.col("_ok").isNull()).drop("_ok")
    return counts.join(one, ["study_id", "locus_id"]).select(*CELL, "value")


def n_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_samples"))


def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("study_id", "sample_id").agg(F.sum("value").alias("lib_size"))


def detect_filter(
    counts: DataFrame,
    samples: DataFrame,
    rate: float,
    detect_count: float = 1.0,
    min_samples: int | None = None,
) -> DataFrame:
    """Keep features seen at ``detect_count`` or more in enough samples of their study.

    A row of the matrix has at most one cell per sample, so the row totals are windows over
    (study, feature): one shuffle, which later steps by feature can use again.
    """
    n = F.col("n_samples")
    seen = F.count_if(F.col("value") >= detect_count).over(_row())
    # A threshold at or below zero is met by absent cells too.
    hits = seen if detect_count > 0 else n
    need = F.lit(max(1, int(min_samples))) if min_samples is not None else F.greatest(
        F.lit(1), F.ceil(F.lit(float(rate)) * n))
    j = counts.join(n_samples(samples), "study_id").withColumn("_seen", hits)
    return j.where(F.col("_seen") >= need).select(*counts.columns)


def low_count_filter(counts: DataFrame, min_total: float = 10.0) -> DataFrame:
    """Keep features whose total is strictly above ``min_total``."""
    total = counts.withColumn("_t", F.sum("value").over(_row()))
    return total.where(F.col("_t") > min_total).drop("_t")


def round_counts(counts: DataFrame) -> DataFrame:
    """Round half to even."""
    return counts.withColumn("value", F.bround(F.col("value"), 0))


def expression_filter(
    counts: DataFrame,
    samples: DataFrame,
    min_count: float = 10.0,
    min_total: float = 15.0,
    large_n: float = 10.0,
    min_prop: float = 0.7,
) -> DataFrame:
    """Keep features with a sufficient CPM in as many samples as the smallest group has."""
    sizes = samples.groupBy("study_id", "grp").agg(F.count(F.lit(1)).alias("_g"))
    small = sizes.groupBy("study_id").agg(F.min("_g").alias("_g"))
    need = F.when(F.col("_g") > large_n, large_n + (F.col("_g") - large_n) * min_prop).otherwise(F.col("_g"))
    libs = library_sizes(counts)
    cut = libs.groupBy("study_id").agg((F.lit(min_count) / F.median("lib_size") * 1e6).alias("_cut"))
    limits = cut.join(small, "study_id").select("study_id", "_cut", need.alias("_need"))
    # One row a sample goes to the cells: studies and samples are few and large, a shuffle by them would land in few tasks.
    scale = libs.join(limits, "study_id")
    cells = counts.join(F.broadcast(scale), ["study_id", "sample_id"])
    cpm_value = F.col("value") / F.col("lib_size") * 1e6
    j = cells.withColumn("_k", F.count_if(cpm_value >= F.col("_cut")).over(_row())).withColumn(
        "_t", F.sum("value").over(_row()))
    kept = j.where((F.col("_k") >= F.col("_need") - 1e-14) & (F.col("_t") >= min_total - 1e-14))
    return kept.select(*counts.columns)


def cpm(counts: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Counts per million of the (normalised) library size."""
    j = counts.join(library_sizes(counts), ["study_id", "sample_id"])
    size = F.col("lib_size")
    if factors is not None:
        j = j.join(factors, ["study_id", "sample_id"])
        size = size * F.col("norm_factor")
    return j.select(*CELL, (F.col("value") / size * 1e6).alias("value"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Length-normalised counts scaled to one million per sample."""
    rate = counts.join(lengths, "feature_id").withColumn("_rate", F.col("value") / F.col("length"))
    total = rate.groupBy("study_id", "sample_id").agg(F.sum("_rate").alias("_t"))
    return rate.join(total, ["study_id", "sample_id"]).select(
        *CELL, (F.col("_rate") / F.col("_t") * 1e6).alias("value"))


def rpkm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    j = counts.join(library_sizes(counts), ["study_id", "sample_id"]).join(lengths, "feature_id")
    return j.select(
        *CELL, (F.col("value") / (F.col("length") / 1e3) / (F.col("lib_size") / 1e6)).alias("value"))


def tmm_factors(
    counts: DataFrame,
    logratio_trim: float = 0.3,
    sum_trim: float = 0.05,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Trimmed-mean-of-M normalisation factor of each sample: (study_id, sample_id, norm_factor).

    The reference sample is the one whose upper quartile is nearest the mean of all; where at least half of the upper
    quartiles are zero (sparse counts), the one with the largest sum of square roots. Equal ones go by name.
    """
    # The cells are read five times below; kept once, as is each pairing with the reference.
    cells = cut_lineage(counts.where(F.col("value") > 0).select(*CELL, "value"))
    hot_rows = hot_rows if has_hot_group(cells, ["study_id", "sample_id"], hot_rows) else None
    libs = library_sizes(cells)
    n_feat = cells.groupBy("study_id").agg(F.count_distinct("feature_id").alias("_nf"))
    nnz = cells.groupBy("study_id", "sample_id").agg(F.count(F.lit(1)).alias("_nnz"))
    zeros = nnz.join(n_feat, "study_id").select("study_id", "sample_id", (F.col("_nf") - F.col("_nnz")).alias("_z"))
    shares = cells.join(libs, ["study_id", "sample_id"]).join(zeros, ["study_id", "sample_id"]).select(
        "study_id", "sample_id", "_z", (F.col("value") / F.col("lib_size")).alias("_share"))
    uq = group_quantile(shares, ["study_id", "sample_id"], "_share", 0.75, "_uq", zeros="_z", hot_rows=hot_rows)
    uq = cut_lineage(uq)
    # Samples of a study are a few hundred rows, so their median is taken in one group.
    centre = uq.groupBy("study_id").agg(F.avg("_uq").alias("_mid"), F.median("_uq").alias("_half"))
    roots = cells.groupBy("study_id", "sample_id").agg(F.sum(F.sqrt("value")).alias("_roots"))
    near = F.struct(F.round(F.abs(F.col("_uq") - F.col("_mid")), 15), "sample_id")
    full_ = F.struct(F.round(-F.col("_roots"), 9), "sample_id")
    # One row per study: kept, because the cells are read against it three times.
    ref = cut_lineage(uq.join(centre, "study_id").join(roots, ["study_id", "sample_id"]).groupBy("study_id").agg(
        F.when(F.max("_half") < 1e-20, F.min_by("sample_id", full_)).otherwise(F.min_by("sample_id", near)).alias("_ref")))
    obs = cells.join(libs, ["study_id", "sample_id"])
    ref_cells = obs.join(ref, "study_id").where(F.col("sample_id") == F.col("_ref")).select(
        "study_id", "feature_id", F.col("value").alias("_yr"), F.col("lib_size").alias("_nr"))
    y, n, yr, nr = (F.col(c) for c in ("value", "lib_size", "_yr", "_nr"))
    pairs = obs.join(ref_cells, ["study_id", "feature_id"]).select(
        "study_id", "sample_id",
        # Rounded, so that equal ratios stay equal whatever order they were computed in.
        F.round(F.log2(y / n) - F.log2(yr / nr), 12).alias("_m"),
        F.round((F.log2(y / n) + F.log2(yr / nr)) / 2, 12).alias("_a"),
        ((n - y) / n / y + (nr - yr) / nr / yr).alias("_v"),
    )
    pairs = cut_lineage(pairs)
    key = ["study_id", "sample_id"]
    band_m = _rank_band(pairs, key, "_m", logratio_trim, hot_rows)
    band_a = _rank_band(pairs, key, "_a", sum_trim, hot_rows)
    j = pairs.join(band_m, key).join(band_a, key)
    keep = F.col("_m").between(F.col("_m_lo"), F.col("_m_hi")) & F.col("_a").between(F.col("_a_lo"), F.col("_a_hi"))
    raw = j.groupBy(*key).agg(
        F.max(F.abs("_m")).alias("_flat"),
        (F.sum(F.when(keep, F.col("_m") / F.col("_v"))) / F.sum(F.when(keep, 1 / F.col("_v")))).alias("_f"),
    ).select(*key, F.when(F.col("_flat") < 1e-6, 0.0).otherwise(F.coalesce("_f", F.lit(0.0))).alias("_l2"))
    full = libs.select(*key).join(raw, key, "left").fillna(0.0, ["_l2"])
    mid = full.groupBy("study_id").agg(F.avg("_l2").alias("_gm"))
    return cut_lineage(
        full.join(mid, "study_id").select(*key, F.pow(F.lit(2.0), F.col("_l2") - F.col("_gm")).alias("norm_factor")))


def _rank_band(pairs: DataFrame, key: list[str], value: str, trim: float, hot_rows: int | None) -> DataFrame:
    """Smallest and largest value whose tie-averaged rank survives trimming both ends.

    One row per sample comes back, so the cells themselves are filtered, never ranked.
    """
    counts = pairs.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered_scan(counts, key, [F.col(value)], rank=None, sums={"_cum": F.col("_c")}, hot_rows=hot_rows)
    total = counts.groupBy(*key).agg(F.sum("_c").alias("_n"))
    rank = F.col("_cum") - (F.col("_c") - 1) / 2.0
    low = F.floor(F.col("_n") * F.lit(float(trim))) + 1
    kept = cum.join(total, key).where((rank >= low) & (rank <= F.col("_n") + 1 - low))
    return cut_lineage(kept.groupBy(*key).agg(F.min(value).alias(f"{value}_lo"), F.max(value).alias(f"{value}_hi")))


def row_variance(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Sample variance of each feature over all samples of its study, zeros included.

    Centred around the mean of the stored cells first, so that large values do not cancel.
    """
    agg = counts.groupBy("study_id", "feature_id").agg(
        F.count(F.lit(1)).alias("_k"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    n, k, m = F.col("n_samples"), F.col("_k"), F.col("_m")
    # k stored cells with mean m and n - k zeros.
    ss = k * F.col("_v") + m * m * k * (n - k) / n
    return agg.join(n_samples(samples), "study_id").select(
        "study_id", "feature_id", (k * m / n).alias("mean"), (ss / (n - 1)).alias("variance"))


def variance_filter(
    counts: DataFrame, samples: DataFrame, quantile: float, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Keep features whose variance is at or above the given quantile of all variances."""
    var = row_variance(counts, samples).withColumn("variance", F.round("variance", 9))
    cut = group_quantile(var, ["study_id"], "variance", quantile, "_cut", hot_rows=hot_rows)
    keep = var.join(cut, "study_id").where(F.col("variance") >= F.col("_cut") - 1e-12)
    return counts.join(keep.select("study_id", "feature_id"), ["study_id", "feature_id"], "left_semi")


def fill_zeros(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Dense long form: every feature gets a row for every sample of its study."""
    wanted = samples.groupBy("study_id").agg(F.collect_set("sample_id").alias("_all"))
    present = counts.groupBy("study_id", "feature_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sample_id", "value"))).alias("_cells"))
    # One row a study goes to the features: a shuffle by study would land in few tasks.
    rows = present.join(F.broadcast(wanted), "study_id").select(
        "study_id", "feature_id", "_cells", F.explode("_all").alias("sample_id"))
    return rows.select(*CELL, F.coalesce(F.try_element_at("_cells", F.col("sample_id")), F.lit(0.0)).alias("value"))


def zscore(counts: DataFrame, samples: DataFrame, by: str = "row") -> DataFrame:
    """Z-scores with the sample standard deviation, by ``row``, ``col`` or ``both`` (columns first)."""
    dense = fill_zeros(counts, samples)
    if by in ("col", "both"):
        dense = _scale(dense, ["study_id", "sample_id"])
    if by in ("row", "both"):  # a row has one cell a sample, and lies in one task already
        dense = _scaled(dense.withColumn("_m", F.avg("value").over(_row())).withColumn("_s", F.stddev_samp("value").over(_row())))
    return dense


def _scale(dense: DataFrame, keys: list[str]) -> DataFrame:
    stats = dense.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return _scaled(dense.join(stats, keys))


def _scaled(j: DataFrame) -> DataFrame:
    return j.select(*CELL, F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).alias("value"))


def colour_breaks(values: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """5 % and 95 % quantiles of all cells of a study, from one pass."""
    v = values.where(F.col("value").isNotNull())
    return group_quantiles(v, ["study_id"], "value", {"q05": 0.05, "q95": 0.95}, hot_rows=hot_rows)


def value_quantiles(values: DataFrame, steps: int = 100, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The quantiles at 0, 1/steps, ..., 1 of all cells of a study: (study_id, step, quantile).

    Equal values are counted first; each distinct value then knows which of the wanted
    order statistics it is, so no group is gathered.
    """
    counts = values.where(F.col("value").isNotNull()).groupBy("study_id", "value").agg(F.count(F.lit(1)).alias("_c"))
    cum = ordered_scan(counts, ["study_id"], [F.col("value")], rank=None, sums={"_cum": F.col("_c")}, hot_rows=hot_rows)
    total = counts.groupBy("study_id").agg(F.sum("_c").alias("_n"))
    j = cum.join(total, "study_id").withColumn("_first", F.col("_cum") - F.col("_c"))

    def place(i: Column) -> Column:
        return (F.col("_n") - 1) * i / F.lit(float(steps))

    def holds(at: Column) -> Column:
        return (at >= F.col("_first")) & (at < F.col("_cum"))

    wanted = F.filter(F.sequence(F.lit(0), F.lit(steps)), lambda i: holds(F.floor(place(i))) | holds(F.ceil(place(i))))
    hit = j.select("study_id", "value", "_n", "_first", "_cum", F.explode(wanted).alias("step"))
    pos = place(F.col("step"))
    ends = hit.groupBy("study_id", "step").agg(
        F.max(F.when(holds(F.floor(pos)), F.col("value"))).alias("_lo"),
        F.max(F.when(holds(F.ceil(pos)), F.col("value"))).alias("_hi"), F.max(pos - F.floor(pos)).alias("_f"))
    return ends.select("study_id", "step", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))


def detection_rate(counts: DataFrame, samples: DataFrame, above: float = 1.0) -> DataFrame:
    """Share of samples in which a feature is above ``above``."""
    seen = counts.groupBy("study_id", "feature_id").agg(F.count_if(F.col("value") > above).alias("_k"))
    return seen.join(n_samples(samples), "study_id").select(
        "study_id", "feature_id", (F.col("_k") / F.col("n_samples")).alias("rate"))


def preprocess(
    counts: DataFrame,
    annotation: DataFrame,
    samples: DataFrame,
    exons: DataFrame | None = None,
    filter_low: bool = False,
    detect_rate: float | None = None,
    detect_count: float = 1.0,
    min_samples: int | None = None,
    grouped: bool = True,
    cpm_tmm: bool = False,
) -> dict[str, DataFrame]:
    """Annotation filter, low-expression filter and TMM-CPM. Returns ``counts`` and maybe ``cpm_tmm``."""
    from .intervals import filter_annotation

    kept = keep_annotated(counts, filter_annotation(annotation, exons))
    if filter_low and grouped:
        kept = expression_filter(kept, samples)
    elif filter_low:
        if detect_rate is None or not 0 < detect_rate < 1:
            raise ValueError("filter_low without groups needs detect_rate in (0, 1)")
        kept = detect_filter(kept, samples, detect_rate, detect_count, min_samples)
    out = {"counts": kept}
    if cpm_tmm:
        out["cpm_tmm"] = cpm(kept, tmm_factors(kept))
    return out
