"""Delimited tables: counts, metadata, annotation, regions, results, per-sample metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefilter import normalise_gsea, normalise_helpers


def _csv(spark: SparkSession, path, sep: str = ",", header: bool = True, **options) -> DataFrame:
    return spark.read.options(sep=sep, header=header, encoding="UTF-8", quote='"', escape='"', multiLine=False, **options).csv(path)


def _require(df: DataFrame, columns: set[str]) -> DataFrame:
    missing = columns - set(df.columns)
    if missing:
        raise ValueError(f"table is missing columns: {sorted(missing)}")
    return df


def read_counts(spark: SparkSession, path, study_id: str = "S", sep: str = "\t") -> DataFrame:
    """Wide matrix (first column = feature) to long form without zeros."""
    return long_counts(_csv(spark, path, sep), study_id)


def long_counts(wide: DataFrame, study_id: str = "S") -> DataFrame:
    first, *names = wide.columns
    values = wide.select(F.col(f"`{first}`").alias("feature_id"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    long = values.unpivot(["feature_id"], [f"`{n}`" for n in names], "sample_id", "value")
    return long.where(F.col("value") != 0).select(F.lit(study_id).alias("study_id"), "feature_id", "sample_id", "value")


def read_samples(spark: SparkSession, path, study_id: str = "S", group: str = "group", source: str = "source_name") -> DataFrame:
    """Sample metadata, first column = sample id. A missing group column stays NULL."""
    return sample_rows(_csv(spark, path), study_id, group, source)


def sample_rows(m: DataFrame, study_id: str = "S", group: str = "group", source: str = "source_name") -> DataFrame:
    m = _require(m, {source})
    grp = F.col(f"`{group}`") if group in m.columns else F.lit(None).cast("string")
    return m.select(F.lit(study_id).alias("study_id"), F.col(f"`{m.columns[0]}`").alias("sample_id"),
                    grp.alias("grp"), F.col(source).alias("source_name"))


def sample_export(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("sample_id").alias("Sample"), "source_name", F.col("grp").alias("group"))


def write_samples(samples: DataFrame, path: str) -> None:
    sample_export(samples).write.mode("overwrite").option("header", True).csv(path)


def read_exons(spark: SparkSession, path) -> DataFrame:
    """Exon rows of a GTF file with gene and exon ids and all attributes as a map."""
    schema = "chrom string, source string, type string, start long, end long, score string, strand string, frame string, attrs string"
    return exon_rows(spark.read.options(sep="\t", comment="#", quote="").schema(schema).csv(path))


def exon_rows(rows: DataFrame) -> DataFrame:
    """Exons of rows with the nine GTF columns."""
    g = rows.where(F.col("type") == "exon")
    pairs = F.filter(F.transform(F.split("attrs", r";\s*"), lambda t: F.trim(t)), lambda a: a != "")
    entries = F.transform(pairs, lambda a: F.struct(
        F.regexp_extract(a, r"^(\S+)", 1).alias("k"), F.regexp_extract(a, r'^\S+\s+"?([^"]*)"?$', 1).alias("v")))
    # Repeated attributes (tags) keep their first value.
    first = F.aggregate(entries, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, e: F.when(
        F.exists(acc, lambda x: x["k"] == e["k"]), acc).otherwise(F.array_append(acc, e)))
    m = g.withColumn("attributes", F.map_from_entries(first))
    return m.select("chrom", "start", "end", "strand", F.try_element_at("attributes", F.lit("gene_id")).alias("gene_id"),
                    F.try_element_at("attributes", F.lit("exon_id")).alias("exon_id"), "attributes")


def read_regions(spark: SparkSession, path, id_col: int = 4, width: int = 12) -> DataFrame:
    """BED regions (0-based, half open, no header, ragged) as closed 1-based intervals.

    A start or end that is no integer fails the job. ``empty`` marks zero-width rows, which
    no join will match.
    """
    names = [f"c{i}" for i in range(1, max(width, id_col) + 1)]
    return region_rows(spark.read.options(sep="\t", quote="", mode="PERMISSIVE").schema(", ".join(f"{n} string" for n in names)).csv(path), id_col)


def region_rows(b: DataFrame, id_col: int = 4) -> DataFrame:
    """Regions of text columns c1, c2, ... of a BED table."""
    s, e = F.col("c2").try_cast("long"), F.col("c3").try_cast("long")
    bad = F.assert_true(s.isNotNull() & e.isNotNull(), F.concat(F.lit("start and end must be integers: "), F.concat_ws(" ", "c1", "c2", "c3")))
    return b.withColumn("_ok", bad).where(F.col("_ok").isNull()).select(
        F.col("c1").alias("chrom"), (s + 1).alias("start"), e.alias("end"), F.col(f"c{id_col}").alias("id"),
        F.monotonically_increasing_id().alias("ord"), (s >= e).alias("empty"))


def read_annotation(spark: SparkSession, path, prefix: str = "") -> DataFrame:
    """Element annotation with header; ``prefix`` is put before chromosomes that lack it."""
    return annotation_rows(_csv(spark, path, "\t"), prefix)


def annotation_rows(a: DataFrame, prefix: str = "") -> DataFrame:
    a = _require(a, {"GHid", "chr", "element_start", "element_end", "regulatory_element_type"})
    chrom = F.col("chr")
    if prefix:
        chrom = F.when(F.startswith(chrom, F.lit(prefix)), chrom).otherwise(F.concat(F.lit(prefix), chrom))
    return a.select(F.col("GHid").alias("id"), chrom.alias("chrom"), F.col("element_start").cast("long").alias("start"),
                    F.col("element_end").cast("long").alias("end"), F.rtrim("regulatory_element_type").alias("regulatory_element_type"))


def read_saf(spark: SparkSession, path) -> DataFrame:
    s = _require(_csv(spark, path, "\t"), {"GeneID", "Chr", "Start", "End"})
    return s.withColumn("Start", F.col("Start").cast("long")).withColumn("End", F.col("End").cast("long"))


def read_association(spark: SparkSession, path) -> DataFrame:
    return association_rows(_csv(spark, path))


def association_rows(a: DataFrame) -> DataFrame:
    return _require(a, {"GHid", "symbol"}).select("GHid", "symbol")


def read_gsea(spark: SparkSession, path, study_id: str = "S") -> DataFrame:
    raw = _csv(spark, path).withColumn("study_id", F.lit(study_id)).withColumn("rec_ord", F.monotonically_increasing_id())
    return normalise_gsea(raw)


def read_helpers(spark: SparkSession, path, study_id: str = "S", tf_names: DataFrame | None = None) -> DataFrame:
    raw = _csv(spark, path).withColumn("study_id", F.lit(study_id)).withColumn("ord", F.monotonically_increasing_id())
    return normalise_helpers(raw, tf_names)


def read_tf_names(spark: SparkSession, path) -> DataFrame:
    return parse_tf_names(spark.read.text(path))


def parse_tf_names(lines: DataFrame) -> DataFrame:
    """First field of each line (value), lower case; blank and comment lines are left out."""
    t = lines.select(F.trim(F.split("value", "\t")[0]).alias("name"))
    return t.where((F.col("name") != "") & ~F.startswith("name", F.lit("#"))).select(F.lower("name").alias("name")).distinct()


def enrichment_csv(result: DataFrame) -> DataFrame:
    """Enrichment table with the leading edge as text, NULL where empty."""
    return result.withColumn("leading_edge", F.nullif(F.array_join("leading_edge", ", "), F.lit("")))


def write_enrichment(result: DataFrame, path: str) -> None:
    enrichment_csv(result).write.mode("overwrite").option("header", True).csv(path)


def metric_rows(values: DataFrame, metric: str) -> DataFrame:
    return values.select("sample_id", F.lit(metric).alias("metric"), "feature_id", F.format_string("%s", "value").alias("value"))


def write_metrics(values: DataFrame, path: str, metric: str) -> None:
    """Headerless feature/value files under sample_id=.../metric=...; other metrics stay."""
    metric_rows(values, metric).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("sep", "\t").partitionBy(
        "sample_id", "metric").csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    schema = "feature_id string, value double, sample_id string, metric string"
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def merge_metric(metrics: DataFrame, metric: str, samples: list[str]) -> DataFrame:
    """One wide matrix joined by feature id; features that are zero everywhere are left out."""
    m = metrics.where(F.col("metric") == metric)
    sums = [F.coalesce(F.sum(F.when(F.col("sample_id") == s, F.col("value"))), F.lit(0.0)).alias(s) for s in samples]
    wide = m.groupBy(F.col("feature_id").alias("Name")).agg(*sums, F.sum("value").alias("_t"))
    return wide.where(F.col("_t") != 0).drop("_t")


def read_verification(spark: SparkSession, path, study_id: str = "S") -> DataFrame:
    """Pipe-separated verification rows with at least seven fields; header and rule lines skipped."""
    return parse_verification(spark.read.text(path).withColumn("row_ord", F.monotonically_increasing_id()), study_id)


def parse_verification(lines: DataFrame, study_id: str = "S") -> DataFrame:
    """Rows of lines (row_ord, value)."""
    t = lines.where((F.trim("value") != "") & ~F.col("value").rlike("^(-|theme)"))
    p = t.select("row_ord", F.transform(F.split("value", r"\|"), lambda t: F.trim(t)).alias("_p"))
    names = ["theme", "direction", "cell_type", "decision", "effect_size", "q_value", "reason"]
    return p.where(F.size("_p") >= 7).select(
        F.lit(study_id).alias("study_id"), "row_ord", *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
