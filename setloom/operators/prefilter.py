"""Direction split of result rows, helper ranking, and table normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import helper_class, tf_family
from ..params import LinkSettings

SIDE = ["study_id", "direction"]

# Accepted header names (lower case) of the two input tables.
GSEA_HEADERS = {
    "compare.list": "term", "term": "term", "nes": "nes", "qvalue": "q_value", "q_value": "q_value",
    "size": "size", "source": "source", "leadingedge": "leading_edge", "leading_edge": "leading_edge",
}
HELPER_HEADERS = {
    "compare.list": "helper_name", "helper_name": "helper_name", "helper": "helper_name",
    "class": "helper_class", "helper_class": "helper_class", "catalog": "helper_class",
    "nes": "nes", "effect_size": "nes", "score": "nes", "qvalue": "q_value", "q_value": "q_value",
    "pvalue": "p_value", "direction": "direction", "size": "size", "top_hallmark": "top_hallmark",
    "tf_family": "tf_family",
}


def rename_headers(df: DataFrame, headers: dict[str, str], required: set[str]) -> DataFrame:
    """Trimmed string columns under their canonical names; several spellings are coalesced."""
    found: dict[str, list[Column]] = {}
    rest = []
    for c in df.columns:
        name = headers.get(c.strip("﻿ \"").lower())
        value = F.trim(F.col(f"`{c}`").cast("string"))
        if name:
            found.setdefault(name, []).append(F.nullif(value, F.lit("")))
        else:
            rest.append(F.col(f"`{c}`"))
    missing = required - set(found)
    if missing:
        raise ValueError(f"table is missing columns: {sorted(missing)}")
    return df.select(*rest, *[F.coalesce(*reversed(v)).alias(k) for k, v in found.items()])


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def normalise_gsea(raw: DataFrame) -> DataFrame:
    """Typed result rows; rows without a usable q or NES are dropped.

    ``raw`` carries study_id and rec_ord next to the free-named columns.
    """
    t = rename_headers(raw, GSEA_HEADERS, {"term", "nes", "q_value", "size"})
    text = lambda c: F.col(c) if c in t.columns else F.lit(None).cast("string")
    genes = F.filter(F.transform(F.split(F.coalesce(text("leading_edge"), F.lit("")), ","), lambda t: F.trim(t)), lambda g: g != "")
    out = t.select(
        "study_id", "rec_ord", "term", text("source").alias("source"), _number("nes").alias("nes"),
        _number("q_value").alias("q_value"), _number("size").cast("int").alias("size"), genes.alias("leading_edge"))
    return out.where(F.col("nes").isNotNull() & F.col("q_value").isNotNull())


def split_directions(rows: DataFrame, settings: LinkSettings) -> DataFrame:
    """Rows kept for theming with direction, score and reading order.

    Rows at or below the q threshold stay; a direction with fewer than the minimum is filled
    up with its next best rows by (q, -|NES|). NES of 0 belongs to no direction.
    """
    signed = rows.where(F.col("nes") != 0).withColumn("direction", F.when(F.col("nes") > 0, "UP").otherwise("DOWN"))
    passed = signed.withColumn("_ok", F.col("q_value") <= settings.gsea_q_threshold)
    kept = passed.where("_ok").withColumn("_late", F.lit(0))
    if settings.gsea_min_per_direction > 0:
        have = kept.groupBy(*SIDE).agg(F.count(F.lit(1)).alias("_have"))
        w = Window.partitionBy(*SIDE).orderBy("q_value", F.abs("nes").desc(), "rec_ord")
        spare = passed.where(~F.col("_ok")).withColumn("_late", F.row_number().over(w)).where(
            F.col("_late") <= settings.gsea_min_per_direction)
        fill = spare.join(have, SIDE, "left").where(
            F.col("_late") <= settings.gsea_min_per_direction - F.coalesce("_have", F.lit(0))).drop("_have")
        kept = kept.unionByName(fill)
    score = F.abs("nes")
    out = kept.withColumn("score", score).withColumn(
        "rec_ord", F.struct((-score).alias("s"), F.col("_late").alias("late"), F.col("rec_ord").alias("ord")))
    if settings.gsea_top_n > 0:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*SIDE).orderBy("rec_ord"))).where(
            F.col("_r") <= settings.gsea_top_n).drop("_r")
    return out.select(
        *SIDE, "rec_ord", "term", F.nullif(F.col("source"), F.lit("")).alias("source"), "nes", "q_value", "size",
        "score", F.slice("leading_edge", 1, 20).alias("leading_edge"))


def normalise_helpers(raw: DataFrame, tf_names: DataFrame | None = None) -> DataFrame:
    """Typed helper rows. ``q_from_signed`` marks a q taken from the signed column."""
    t = rename_headers(raw, HELPER_HEADERS, set())
    text = lambda c: F.col(f"`{c}`") if c in t.columns else F.lit(None).cast("string")
    name = F.coalesce(text("helper_name"), F.nullif(text("Compare_List"), F.lit("")), F.nullif(text("term"), F.lit("")))
    q_alt = text("signed_qValue").try_cast("double")
    nes = _number("nes") if "nes" in t.columns else F.lit(0.0)
    typed = t.select(
        "study_id", "ord", F.trim(name).alias("helper_name"), helper_class(text("helper_class")).alias("helper_class"),
        text("tf_family").alias("tf_family"), nes.alias("nes"),
        F.when(text("q_value").isNull(), q_alt).otherwise(text("q_value").try_cast("double")).alias("q_value"),
        text("q_value").isNull().alias("q_from_signed"),
        F.upper(text("direction")).alias("direction"), text("size").try_cast("double").cast("int").alias("size"),
        F.coalesce(text("top_hallmark"), F.nullif(text("TopHallmark"), F.lit(""))).alias("top_hallmark"))
    side = F.coalesce("direction", F.when(F.col("nes") > 0, "UP").when(F.col("nes") < 0, "DOWN"))
    out = typed.withColumn("direction", side).where(
        F.col("helper_name").isNotNull() & F.col("nes").isNotNull() & F.col("q_value").isNotNull()
        & F.col("direction").isin("UP", "DOWN"))
    if tf_names is not None:
        known = tf_names.select(F.lower(F.trim("name")).alias("_tf")).distinct()
        out = out.join(known, F.lower("helper_name") == F.col("_tf"), "left").withColumn(
            "helper_class", F.when(F.col("_tf").isNotNull(), "tf_family").otherwise(F.col("helper_class"))).drop("_tf")
    family = F.when(F.col("helper_class") == "tf_family", F.coalesce("tf_family", tf_family(F.col("helper_name"))))
    return out.withColumn("tf_family", F.coalesce(family, F.col("tf_family")))


def rank_helpers(helpers: DataFrame, settings: LinkSettings) -> DataFrame:
    """Helpers of each direction by (q, -|NES|), capped; the two optional thresholds are off by default."""
    kept = helpers
    if settings.helper_q_threshold is not None:
        kept = kept.where(F.col("q_value") <= settings.helper_q_threshold)
    if settings.helper_nes_threshold is not None:
        kept = kept.where(F.abs("nes") >= settings.helper_nes_threshold)
    if settings.helper_max_per_direction <= 0:
        return kept
    w = Window.partitionBy(*SIDE).orderBy("q_value", F.abs("nes").desc(), "ord")
    return kept.withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= settings.helper_max_per_direction).drop("_r")
