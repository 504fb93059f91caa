"""Figure tables: links, magnitudes, verdict matrix, prediction flow, consistency, network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts in display order, with their line widths.
VERDICTS = ["Supported", "Partial", "Hypothesis", "Not supported"]
VERDICT_WIDTH = {"Supported": 4.0, "Partial": 2.6, "Hypothesis": 1.8, "Not supported": 1.2}
CONFIDENCE_WIDTH = {"high": 3.0, "medium": 2.0, "low": 1.2}
# Follow-up categories and their keywords, first match counts.
CATEGORIES = [
    ("Chromatin/Enhancer", ["chromatin", "h3k27", "atac", "enhancer", "chip"]),
    ("Gene Expression", ["rna", "transcript", "expression", "bulk", "single-cell"]),
    ("Functional Perturbation", ["crispr", "perturb", "knockdown", "overexpress", "inhibit", "block"]),
]
OTHER_CATEGORY = "Phenotypic/Other"
# Colours, dashes and widths of the verification network.
DECISION_COLOUR = {"Supported": "#2ca02c", "Partial": "#ff7f0e", "Hypothesis": "#1f77b4", "Refuted": "#d62728"}
THEME_COLOUR, CELL_COLOUR, OTHER_COLOUR = "#6a51a3", "#17becf", "#7f7f7f"
CRITIC_COLOUR = {"Discard": "#9e9e9e"}
CRITIC_DASH = {"Contextualize": "8,4", "Discard": "3,6"}
CRITIC_WIDTH = {"Contextualize": 2.5, "Discard": 1.8}


def _pick(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def edge_width(verdict: Column, q: Column, confidence: Column) -> Column:
    by_q = F.least(F.lit(4.0), F.greatest(F.lit(1.2), -F.log10(F.greatest(q, F.lit(1e-6)))))
    return (
        F.when(F.coalesce(verdict, F.lit("")) != "", _pick(verdict, VERDICT_WIDTH, 2.0)).when(q.isNotNull(), by_q)
        .otherwise(_pick(F.coalesce(confidence, F.lit("medium")), CONFIDENCE_WIDTH, 1.5)))


def supported_themes(reviews: DataFrame) -> DataFrame:
    return reviews.where(F.col("verdict") == "Supported").select("study_id", "theme_id").distinct()


def theme_helper_links(themes: DataFrame, claims: DataFrame, helpers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Edges between supported themes and the helpers claimed for them, with line widths."""
    shown = themes.join(supported_themes(reviews), ["study_id", "theme_id"], "left_semi").select(
        "study_id", "theme_id", "label")
    verdict = reviews.groupBy("study_id", "theme_id", "helper_name").agg(F.max_by("verdict", "claim_ord").alias("_v"))
    q = helpers.groupBy("study_id", "helper_name").agg(F.max_by("q_value", "ord").alias("_q"))
    c = claims.where(F.coalesce("helper_name", F.lit("")) != "").join(shown, ["study_id", "theme_id"])
    j = c.join(verdict, ["study_id", "theme_id", "helper_name"], "left").join(q, ["study_id", "helper_name"], "left")
    return j.select(
        "study_id", "theme_id", "label", "direction", "helper_name", "helper_class",
        edge_width(F.col("_v"), F.col("_q"), F.col("confidence")).alias("width"))


def theme_magnitudes(themes: DataFrame, reviews: DataFrame) -> DataFrame:
    return themes.join(supported_themes(reviews), ["study_id", "theme_id"], "left_semi").select(
        "study_id", "theme_id", "label", "direction", "effect", "q_value")


def verdict_matrix(reviews: DataFrame) -> DataFrame:
    """One row per claim with a 1 under its verdict; unknown verdicts count as Hypothesis."""
    clean = F.initcap(F.coalesce("verdict", F.lit("Hypothesis")))
    v = F.when(clean.isin("Supported", "Partial", "Hypothesis"), clean).otherwise("Hypothesis")
    label = F.concat(F.col("theme_id"), F.lit(" | "), F.coalesce(F.nullif(F.col("helper_name"), F.lit("")), F.lit("theme-only")))
    return reviews.select(
        "study_id", label.alias("label"),
        *[(v == name).cast("int").alias(name.lower().replace(" ", "_")) for name in VERDICTS])


def verdict_counts(reviews: DataFrame) -> DataFrame:
    m = verdict_matrix(reviews)
    cols = [v.lower().replace(" ", "_") for v in VERDICTS]
    return m.groupBy("study_id").agg(*[F.sum(c).alias(c) for c in cols])


def prediction_category(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(OTHER_CATEGORY)
    for name, keys in reversed(CATEGORIES):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, name).otherwise(out)
    return out


def prediction_flow(reviews: DataFrame) -> DataFrame:
    """Counts of follow-up categories per theme over the first two predictions of a claim."""
    p = reviews.select("study_id", "theme_id", F.explode(F.slice("predictions", 1, 2)).alias("_p"))
    return p.where(F.trim("_p") != "").groupBy("study_id", "theme_id", prediction_category(F.col("_p")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))


def nes_consistency(themes: DataFrame) -> DataFrame:
    return themes.where(F.col("helper_mean_effect").isNotNull()).select(
        "study_id", "theme_id", "label", "direction", F.col("effect").alias("gsea"), F.col("helper_mean_effect").alias("helper"))


def verification_network(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of verification rows (study_id, row_ord, theme, direction, cell_type, ...)."""
    key = F.concat(F.col("theme"), F.lit(" ("), F.col("direction"), F.lit(")"))
    r = rows.withColumn("_t", key)
    ends = r.select("study_id", F.explode(F.array(
        F.struct(F.lit("theme").alias("class"), F.col("_t").alias("id")),
        F.struct(F.lit("cell").alias("class"), F.col("cell_type").alias("id")))).alias("_e"))
    degree = ends.groupBy("study_id", "_e.id", "_e.class").agg(F.count(F.lit(1)).alias("degree"))
    theme = F.col("class") == "theme"
    nodes = degree.select(
        "study_id", "id", "class", "degree",
        F.when(theme, 32 + F.col("degree") * 2.0).otherwise(18 + F.col("degree") * 1.2).alias("radius"),
        F.when(theme, THEME_COLOUR).otherwise(CELL_COLOUR).alias("color"),
        F.when(theme, 18).otherwise(14).alias("font_size"))
    critic = F.col("critic_action") if "critic_action" in rows.columns else F.lit(None).cast("string")
    colour = F.coalesce(_pick(critic, CRITIC_COLOUR, None), _pick(F.col("decision"), DECISION_COLOUR, OTHER_COLOUR))
    tip = F.concat(
        key, F.lit(" → "), F.col("cell_type"), F.lit("\nDecision: "), F.col("decision"), F.lit(" | Effect "),
        F.col("effect_size"), F.lit(" | q="), F.col("q_value"), F.lit("\n"), F.col("reason"))
    if "critic_concern" in rows.columns:
        more = F.when(F.coalesce("critic_recommendation", F.lit("")) != "", F.concat(
            F.lit(" ("), F.col("critic_recommendation"), F.lit(")"))).otherwise("")
        tip = F.concat(tip, F.when(F.coalesce(critic, F.lit("")) != "", F.concat(
            F.lit("\nCritic: "), critic, F.lit(" — "), F.coalesce("critic_concern", F.lit("None")), more)).otherwise(""))
    edges = r.select(
        "study_id", "row_ord", F.col("_t").alias("source"), F.col("cell_type").alias("target"), colour.alias("color"),
        tip.alias("tooltip"), _pick(critic, CRITIC_DASH, None).alias("dash"), _pick(critic, CRITIC_WIDTH, 2.5).alias("width"))
    return nodes, edges
