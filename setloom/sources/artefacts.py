"""JSON and CSV artefacts of a linking run, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHWAY = "array<struct<term:string,collection:string,nes:double,q_value:double,size:int>>"
THEME_SCHEMA = (
    "study_id string, direction string, place int, theme_id string, label string, collection string, effect double, "
    f"q_value double, helper_mean_effect double, leading_edges array<string>, top_pathways {PATHWAY}")
CLAIM_SCHEMA = (
    "study_id string, claim_ord long, theme_id string, theme_label string, helper_name string, helper_class string, "
    "direction string, function_phrases array<string>, rationale string, confidence string, helper_top_hallmark string, "
    "helper_effect double, helper_q_value double, claim_id string")
REVIEW_SCHEMA = (
    "study_id string, claim_ord long, theme_id string, helper_name string, verdict string, verdict_reason string, "
    "evidence_snippets array<string>, predictions array<string>, alternative string, gaps string")


def theme_export(themes: DataFrame, digits: bool = True) -> DataFrame:
    """Themes as exported: effect and NES to 3, q to 4 decimals; ``digits=False`` keeps full numbers."""
    r = (lambda c, n: F.round(c, n)) if digits else (lambda c, n: c)
    paths = F.transform("top_pathways", lambda t: F.struct(
        t["term"].alias("term"), t["source"].alias("collection"), r(t["nes"], 3).alias("nes"),
        r(t["q_value"], 4).alias("q_value"), t["size"].alias("size")))
    mean = r(F.col("helper_mean_effect"), 3) if "helper_mean_effect" in themes.columns else F.lit(None).cast("double")
    place = F.col("place") if "place" in themes.columns else F.col("theme_pos")
    return themes.select(
        "study_id", "direction", place.cast("int").alias("place"), "theme_id", "label", "collection",
        r(F.col("effect"), 3).alias("effect"), r(F.col("q_value"), 4).alias("q_value"),
        mean.alias("helper_mean_effect"), "leading_edges", paths.alias("top_pathways"))


def review_export(claims: DataFrame) -> DataFrame:
    return claims.select(
        "study_id", "claim_ord", "theme_id", "helper_name", "verdict", "verdict_reason", "evidence_snippets",
        "predictions", "alternative", "gaps")


def evidence_box(claims: DataFrame) -> DataFrame:
    """Flat evidence table with exactly two predictions."""
    at = lambda i: F.coalesce(F.get("predictions", F.lit(i)), F.lit(""))
    return claims.select(
        "study_id", "claim_ord", "theme_id", "theme_label",
        F.coalesce(F.nullif(F.col("helper_name"), F.lit("")), F.lit("theme_only")).alias("helper_name"), "helper_class",
        "verdict", "verdict_reason", at(0).alias("prediction_1"), at(1).alias("prediction_2"))


def evidence_log(claims: DataFrame) -> DataFrame:
    return claims.select(
        "study_id", "claim_id", "theme_id", "theme_label", "helper_name", "helper_class", "direction",
        "helper_top_hallmark", "helper_effect", "helper_q_value", "source", "used_fallback_snippets",
        "evidence_snippets", "alternative", "gaps", "predictions", "raw_entry")


def helper_status(helpers: DataFrame, studies: DataFrame) -> DataFrame:
    """Text line per study on whether helper evidence was there."""
    has = helpers.select("study_id").distinct().withColumn("_h", F.lit("available"))
    return studies.select("study_id").distinct().join(has, "study_id", "left").select(
        "study_id", F.concat(F.lit("Enhancer helper evidence: "), F.coalesce("_h", F.lit("missing"))).alias("value"))


def write_run(run: dict[str, DataFrame], folder: str) -> None:
    """All artefacts, each partitioned by study; the tables are written once and overwritten whole."""
    def json(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("study_id").json(f"{folder}/{name}")

    json(theme_export(run["themes"]), "themes_condensed")
    json(run["helpers"], "helpers")
    claim_columns = [c.strip().split(" ")[0] for c in CLAIM_SCHEMA.split(", ")]
    json(run["claims"].select(*claim_columns), "helper_claims")
    json(review_export(run["claims"]), "claim_reviews")
    json(evidence_log(run["evidence"]), "evidence_log")
    json(run["notes"], "revision_notes")
    evidence_box(run["claims"]).write.mode("overwrite").partitionBy("study_id").option("header", True).csv(f"{folder}/evidence_box")
    helper_status(run["helpers"], run["studies"]).write.mode("overwrite").partitionBy("study_id").text(f"{folder}/helpers_status")


def write_themes(themes: DataFrame, folder: str) -> None:
    """Uncapped theme summaries with full numbers."""
    theme_export(themes, digits=False).write.mode("overwrite").partitionBy("study_id").json(f"{folder}/themes")


def read_themes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(THEME_SCHEMA).json(f"{folder}/themes_condensed")


def read_claims(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.read.schema(CLAIM_SCHEMA).json(f"{folder}/helper_claims")
    return c.withColumn("direction", F.coalesce(F.nullif(F.upper("direction"), F.lit("")), F.lit("UP"))).fillna(
        {"helper_class": "theme_only", "confidence": "medium", "rationale": ""})


def read_reviews(spark: SparkSession, folder: str, claims: DataFrame) -> DataFrame:
    """Reviews joined to their claims on (theme, helper); a repeated pair belongs to its last claim."""
    r = spark.read.schema(REVIEW_SCHEMA).json(f"{folder}/claim_reviews").withColumnRenamed("claim_ord", "review_ord")
    body = F.struct(*[c for c in claims.columns if c not in ("study_id", "theme_id", "helper_name")])
    last = claims.groupBy("study_id", "theme_id", "helper_name").agg(F.max_by(body, "claim_ord").alias("_c"))
    a, b = r.alias("a"), last.alias("b")
    same = (F.col("a.study_id") == F.col("b.study_id")) & (F.col("a.theme_id") == F.col("b.theme_id")) & F.col(
        "a.helper_name").eqNullSafe(F.col("b.helper_name"))
    clean = F.filter(F.transform("predictions", lambda t: F.trim(t)), lambda p: p != "")
    return a.join(b, same).select("a.*", "b._c.*").withColumn("predictions", clean).fillna({"verdict": "Hypothesis"})
