"""Study background forms: ``Key: value`` lines with continuation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXPECTED = "Expected_Phenotypes_or_Trends_(optional, describe expectations not mandates)"
CELLS = "Cell_Types_of_Interest_(optional)"
PATHWAYS = "Pathway_Hypotheses_(optional)"
# The keys of a form, in summary order.
KEYS = [
    "Study_ID", "System_Model", "Perturbation", "Contrast", "Assay_Context", "Known_Biology", "Key_Questions",
    CELLS, EXPECTED, PATHWAYS, "Red_Flag_Contradictions",
]
# Other spellings of the keys (lower case).
SPELLINGS = {
    "contrast": "Contrast", "contrast_info": "Contrast", "contrast-direction": "Contrast",
    "contrast (case vs control)": "Contrast", "study id": "Study_ID", "system model": "System_Model",
    "assay context": "Assay_Context", "known biology": "Known_Biology", "key questions": "Key_Questions",
    "must link cell types": CELLS, "must_link_cell_types": CELLS, "cell types of interest": CELLS,
    "cell_types_of_interest": CELLS, "expected phenotypes or trends": EXPECTED,
    "expected_phenotypes_or_trends": EXPECTED, "expected phenotypes": EXPECTED,
    "must link pathways": PATHWAYS, "must_link_pathways": PATHWAYS, "pathway hypotheses": PATHWAYS,
    "pathway_hypotheses": PATHWAYS, "red flag contradictions": "Red_Flag_Contradictions",
}


def parse_forms(lines: DataFrame) -> DataFrame:
    """(study_id, key, ord, line) of form lines (study_id, line_no, value).

    A line opens a field if the text before its first colon is a known key; every other
    line, also one with a stray colon, belongs to the field above it.
    """
    names = {k.lower(): k for k in KEYS} | SPELLINGS
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    line = F.trim("value")
    clean = lines.withColumn("_l", line).where((F.col("_l") != "") & ~F.startswith("_l", F.lit("#")))
    label = F.when(F.contains("_l", F.lit(":")) & ~F.startswith("_l", F.lit("-")), F.lower(F.trim(F.substring_index("_l", ":", 1))))
    key = F.coalesce(F.try_element_at(table, label), F.when(F.startswith(label, F.lit("contrast")), F.lit("Contrast")))
    keyed = clean.withColumn("_k", key)
    # A form is one file of some dozen lines.
    w = Window.partitionBy("study_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = keyed.withColumn("key", F.last("_k", ignorenulls=True).over(w)).where(F.col("key").isNotNull())
    rest = F.trim(F.regexp_extract("_l", "(?s)^[^:]*:(.*)$", 1))
    text = F.when(F.col("_k").isNotNull(), rest).when(F.startswith("_l", F.lit("-")), F.ltrim(F.col("_l"), F.lit("- "))).otherwise(F.col("_l"))
    return owned.select("study_id", "key", F.col("line_no").alias("ord"), text.alias("line")).where(F.col("line") != "")


def without_contrast(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """Studies whose form names no contrast; such forms are not usable."""
    good = forms.where(F.col("key") == "Contrast").select("study_id").distinct()
    return lines.select("study_id").distinct().join(good, "study_id", "left_anti")


def require_contrast(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """The forms; the job fails if any study lacks a contrast."""
    bad = without_contrast(lines, forms).agg(F.assert_true(
        F.count(F.lit(1)) == 0, F.lit("a background form must name its contrast"))).scalar()
    return forms.withColumn("_ok", bad).where(F.col("_ok").isNull()).drop("_ok")


def read_forms(spark: SparkSession, paths) -> DataFrame:
    """Parsed forms, one file per study; the study id is the file stem."""
    raw = spark.read.text(paths, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1).alias("study_id"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return require_contrast(raw, parse_forms(raw))


def expectations(forms: DataFrame) -> DataFrame:
    """Text of the expected-trends field: (study_id, expected)."""
    f = forms.where(F.col("key") == EXPECTED)
    return f.groupBy("study_id").agg(F.array_join(
        F.array_sort(F.collect_list(F.struct("ord", "line")))["line"], " ").alias("expected"))
