"""Theme-helper claims: validation, injection, selection, evidence, verdict, revision.

Claims are rows (study_id, claim_ord, theme_id, theme_label, helper_name, helper_class,
direction, function_phrases, rationale, confidence, helper_top_hallmark, helper_effect,
helper_q_value). ``claim_ord`` is their order; themes are ordered UP first, then by place.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as say
from ..functions.text import (
    drop_stopwords, hallmark_phrase, label_keywords, theme_tokens, token_set,
)
from ..params import LinkSettings
from .scan import ordered_scan, range_scan

CLAIM = [
    "study_id", "claim_ord", "theme_id", "theme_label", "helper_name", "helper_class", "direction",
    "function_phrases", "rationale", "confidence", "helper_top_hallmark", "helper_effect", "helper_q_value",
]
THEME_ONLY = "theme_only"
# Step between the blocks of the claim order; two steps and a side fit a long.
BLOCK = 1 << 30
# Keys an answer object may hold its text under, in this order.
SNIPPET_KEYS = ("evidence", "snippets", "sentences", "items", "values", "text")


def _named(c: str = "helper_name") -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _strength(c: str = "helper_effect") -> Column:
    return F.coalesce(F.abs(c), F.lit(0.0))


def _side(c: str = "direction") -> Column:
    return F.when(F.col(c) == "UP", F.lit(0).cast("long")).otherwise(F.lit(1).cast("long"))


def _rank_of(confidence: Column, high: int, medium: int, low: int, other: int) -> Column:
    c = F.lower(confidence)
    return F.when(c == "high", high).when(c == "medium", medium).when(c == "low", low).otherwise(other)


def background_tokens(forms: DataFrame) -> DataFrame:
    """Token set of each study form: (study_id, tokens). Key names take part, as in the summary."""
    text = forms.groupBy("study_id", "key").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("ord", "line")))["line"], " ").alias("_t"))
    found = text.where(F.col("_t") != "").select("study_id", F.explode(token_set(F.col("key"), F.col("_t"))).alias("t"))
    return found.groupBy("study_id").agg(drop_stopwords(F.collect_set("t")).alias("tokens"))


def with_theme_tokens(themes: DataFrame, background: DataFrame) -> DataFrame:
    """Themes with their token set, the flags of touching the study background, and a place."""
    t = themes.join(background, "study_id", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    tokens = theme_tokens(F.col("label"), F.col("collection"), F.col("top_pathways.term"), F.col("leading_edges"))
    return t.select(
        *themes.columns, tokens.alias("theme_tokens"),
        F.arrays_overlap(label_keywords(F.col("label")), "tokens").alias("named_in_background"),
        F.arrays_overlap(tokens, "tokens").alias("touches_background"))


def background_claim(themes: DataFrame, order: Column) -> DataFrame:
    """A theme-only claim for each given theme."""
    why = F.concat(F.col("label"), F.lit(
        " theme is explicitly requested in the study background; "
        "retaining it as a hypothesis until enhancer helpers confirm the signal."))
    none = F.lit(None)
    return themes.select(
        "study_id", order.cast("long").alias("claim_ord"), "theme_id", F.col("label").alias("theme_label"),
        none.cast("string").alias("helper_name"), F.lit(THEME_ONLY).alias("helper_class"), "direction",
        F.array("label").alias("function_phrases"), why.alias("rationale"), F.lit("medium").alias("confidence"),
        none.cast("string").alias("helper_top_hallmark"), none.cast("double").alias("helper_effect"),
        none.cast("double").alias("helper_q_value"))


def validate_claims(items: DataFrame, themes: DataFrame, helpers: DataFrame, per_batch: int) -> DataFrame:
    """Supplied claims checked against themes and helpers, first ``per_batch`` of each batch.

    ``items``: study_id, batch_id, item_ord, theme_id, helper_name, helper_class, direction,
    function_phrases, rationale, confidence, helper_top_hallmark. A helper is looked up in
    the direction of the theme, else UP, else DOWN; of equal names the later row counts.
    """
    t = themes.select("study_id", "theme_id", F.col("label").alias("theme_label"), F.col("direction").alias("_dir"))
    j = items.join(t, ["study_id", "theme_id"]).where(
        (F.coalesce("direction", F.lit("")) == "") | (F.upper("direction") == F.col("_dir")))
    # A helper changes no number of rows: only the claims that stay look for theirs.
    if per_batch > 0:
        w = Window.partitionBy("study_id", "batch_id").orderBy("item_ord")
        j = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_batch).drop("_r")
    ref = helpers.groupBy("study_id", "helper_name", F.col("direction").alias("_hd")).agg(
        F.max_by(F.struct("helper_class", "top_hallmark", "nes", "q_value"), "ord").alias("_ref"))
    by_name = ref.groupBy("study_id", "helper_name").agg(F.map_from_entries(F.collect_list(F.struct("_hd", "_ref"))).alias("_refs"))
    j = j.join(by_name, ["study_id", "helper_name"], "left")
    hit = F.coalesce(
        F.try_element_at("_refs", F.col("_dir")), F.try_element_at("_refs", F.lit("UP")), F.try_element_at("_refs", F.lit("DOWN")))
    j = j.withColumn("_ref", F.when(_named(), hit))
    blank = F.array().cast("array<string>")
    phrases = F.filter(F.transform(F.coalesce("function_phrases", blank), lambda t: F.trim(t)), lambda p: p != "")
    return j.select(
        "study_id", "batch_id", "item_ord", "theme_id", "theme_label", "helper_name",
        F.coalesce(F.nullif(F.col("helper_class"), F.lit("")), F.col("_ref.helper_class"), F.lit(THEME_ONLY)).alias("helper_class"),
        F.col("_dir").alias("direction"), phrases.alias("function_phrases"),
        F.coalesce("rationale", F.lit("")).alias("rationale"),
        F.lower(F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("medium"))).alias("confidence"),
        F.when(F.col("_ref").isNotNull(), F.col("_ref.top_hallmark")).otherwise(F.col("helper_top_hallmark")).alias("helper_top_hallmark"),
        F.col("_ref.nes").alias("helper_effect"), F.col("_ref.q_value").alias("helper_q_value"))


def assign_themes(items: DataFrame, batch_themes: DataFrame) -> DataFrame:
    """Theme id for items without one: the theme of the batch sharing most tokens, first on ties.

    ``batch_themes``: study_id, batch_id, place, theme_id, theme_tokens.
    """
    batch = ["study_id", "batch_id"]
    # Only the first theme of each token set can win, and items with equal tokens have the same answer.
    loose = items.withColumn("_mine", F.when(F.col("theme_id").isNull(), F.array_sort(
        token_set(F.col("helper_name"), F.col("helper_class"), F.col("helper_top_hallmark")))))
    lead = batch_themes.groupBy(*batch, F.array_sort("theme_tokens").alias("_theirs")).agg(
        F.min("place").alias("place"), F.min_by("theme_id", "place").alias("_id"))
    mine = loose.where(F.col("_mine").isNotNull()).select(*batch, "_mine").distinct().withColumn("t", F.explode("_mine"))
    theirs = lead.select(*batch, "place", "_id", F.explode("_theirs").alias("t"))
    shared = mine.join(theirs, [*batch, "t"]).groupBy(*batch, "_mine", "_id", "place").agg(F.count(F.lit(1)).alias("_n"))
    best = shared.groupBy(*batch, "_mine").agg(F.max_by("_id", F.struct("_n", (-F.col("place")).alias("p"))).alias("_best"))
    first = lead.groupBy(*batch).agg(F.min_by("_id", "place").alias("_first"))
    return loose.join(best, [*batch, "_mine"], "left").join(first, batch, "left").select(*[
        F.coalesce("theme_id", "_best", "_first").alias("theme_id") if c == "theme_id" else F.col(c) for c in items.columns])


def theme_batches(themes: DataFrame, per_direction: int = 2) -> DataFrame:
    """Batch number of each theme: ``per_direction`` of either direction, in order."""
    w = Window.partitionBy("study_id", "direction").orderBy("theme_pos")
    n = F.row_number().over(w)
    return themes.withColumn("batch_id", F.ceil(n / per_direction).cast("int")).withColumn(
        "place", _side() * BLOCK + n)


def batch_claims(valid: DataFrame, batched: DataFrame, settings: LinkSettings) -> DataFrame:
    """Strongest helper claims of each batch, or its best background theme if it has none."""
    w = Window.partitionBy("study_id", "batch_id").orderBy(
        _strength().desc(), F.coalesce("helper_q_value", F.lit(1.0)), _rank_of(F.col("confidence"), 2, 1, 0, 0).desc(), "item_ord")
    top = valid.where(_named()).withColumn("_r", F.row_number().over(w))
    if settings.claims_per_batch > 0:
        top = top.where(F.col("_r") <= settings.claims_per_batch)
    chosen = top.withColumn("claim_ord", F.col("batch_id").cast("long") * BLOCK + F.col("_r")).select(*CLAIM)
    served = top.select("study_id", "batch_id").distinct()
    bare = batched.join(served, ["study_id", "batch_id"], "left_anti")
    lead = bare.withColumn("_r", F.row_number().over(Window.partitionBy("study_id", "batch_id").orderBy(
        F.col("named_in_background").desc(), "place"))).where(F.col("_r") == 1)
    return chosen.unionByName(background_claim(lead, F.col("batch_id").cast("long") * BLOCK))


def fallback_claims(themes: DataFrame, helpers: DataFrame, settings: LinkSettings, helpers_available: bool = True) -> DataFrame:
    """Each theme with the first helpers of its direction (0 = all), or alone if there are none."""
    w = Window.partitionBy("study_id", "direction").orderBy("q_value", F.abs("nes").desc(), "ord")
    h = helpers.withColumn("_r", F.row_number().over(w))
    if settings.helper_claims_per_theme > 0:
        h = h.where(F.col("_r") <= settings.helper_claims_per_theme)
    h = h.select("study_id", "direction", "_r", "helper_name", "helper_class", "top_hallmark", "nes", "q_value")
    t = themes.select("study_id", "direction", "theme_pos", "theme_id", "label", "collection")
    j = t.join(h, ["study_id", "direction"], "left")
    alone = F.col("helper_name").isNull()
    phrase = F.when(alone, F.concat(F.coalesce(F.nullif(F.col("collection"), F.lit("")), F.lit("pathway")), F.lit(" adaptation"))).otherwise(
        F.coalesce(F.nullif(F.col("top_hallmark"), F.lit("")), F.concat("helper_class", F.lit(" program"))))
    why = F.concat(
        F.col("label"), F.lit(" ("), F.col("direction"), F.lit(say.ALIGNS), phrase, F.lit(say.HELPER_Q),
        F.when(alone, say.Q_PENDING).otherwise("available"), F.lit("."))
    sure = F.when(alone, "low").otherwise("medium") if helpers_available else F.lit("hypothesis")
    return j.select(
        "study_id", ((_side() * BLOCK + F.col("theme_pos")).cast("long") * BLOCK + F.coalesce("_r", F.lit(0))).alias("claim_ord"),
        "theme_id", F.col("label").alias("theme_label"), "helper_name", F.coalesce("helper_class", F.lit(THEME_ONLY)).alias("helper_class"),
        "direction", F.array(phrase).alias("function_phrases"), why.alias("rationale"), sure.alias("confidence"),
        F.col("top_hallmark").alias("helper_top_hallmark"), F.col("nes").alias("helper_effect"), F.col("q_value").alias("helper_q_value"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """One claim per (theme, helper): highest (confidence, |effect|, rationale length), first on ties.

    The survivor takes the place of the first one seen. Theme-only claims stay as they are.
    """
    body = F.struct(*[c for c in CLAIM if c not in ("study_id", "claim_ord", "theme_id", "helper_name")])
    merit = F.struct(
        _rank_of(F.col("confidence"), 3, 2, 1, 0).alias("c"), _strength().alias("e"),
        F.length(F.coalesce("rationale", F.lit(""))).alias("l"), (-F.col("claim_ord")).alias("o"))
    best = claims.where(F.col("helper_name").isNotNull()).groupBy("study_id", "theme_id", "helper_name").agg(
        F.max_by(body, merit).alias("_b"), F.min("claim_ord").alias("claim_ord"))
    merged = best.select("study_id", "claim_ord", "theme_id", "helper_name", "_b.*").select(*CLAIM)
    return merged.unionByName(claims.where(F.col("helper_name").isNull()).select(*CLAIM))


def add_background_claims(claims: DataFrame, themes: DataFrame) -> DataFrame:
    """Front-insert a claim for every unclaimed theme named in the background, newest first."""
    w = Window.partitionBy("study_id").orderBy(_side(), "theme_pos")
    new = themes.where("named_in_background").join(
        claims.select("study_id", "theme_id").distinct(), ["study_id", "theme_id"], "left_anti"
    ).withColumn("_k", F.row_number().over(w))
    return claims.select(*CLAIM).unionByName(background_claim(new, -F.col("_k")))


def cover_directions(claims: DataFrame, themes: DataFrame, cap: int = 3) -> DataFrame:
    """Up to ``cap`` theme-only claims for a direction without any helper claim."""
    served = claims.where(_named()).select("study_id", "direction").distinct()
    w = Window.partitionBy("study_id", "direction").orderBy("theme_pos")
    new = themes.join(served, ["study_id", "direction"], "left_anti").join(
        claims.select("study_id", "theme_id").distinct(), ["study_id", "theme_id"], "left_anti"
    ).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap)
    late = F.lit(BLOCK).cast("long") * BLOCK + _side() * BLOCK + F.col("_k")
    return claims.select(*CLAIM).unionByName(background_claim(new, late))


def prioritise_claims(claims: DataFrame, settings: LinkSettings) -> DataFrame:
    """Helper claims by (-|effect|, q) first; theme-only claims by label, capped per direction."""
    q = F.coalesce(F.nullif(F.col("helper_q_value"), F.lit(0.0)), F.lit(1.0))
    has = claims.where(_named()).select("study_id", "direction").distinct().withColumn("_has", F.lit(True))
    # The larger cap as a constant first: Spark then cuts each group before it meets in one task.
    most = max(settings.theme_only_cap_with_helpers, settings.theme_only_cap_no_helpers)
    alone = claims.where(~_named()).withColumn("_r", F.row_number().over(
        Window.partitionBy("study_id", "direction").orderBy("theme_label", "claim_ord"))).where(F.col("_r") <= most)
    cap = F.when(F.col("_has"), settings.theme_only_cap_with_helpers).otherwise(settings.theme_only_cap_no_helpers)
    alone = alone.join(has, ["study_id", "direction"], "left").where(F.col("_r") <= cap).drop("_has")
    both = claims.where(_named()).withColumn("_r", F.lit(0)).unionByName(alone)
    order = {"_o1": F.when(_named(), 0).otherwise(1), "_o2": -_strength(), "_o3": q, "_o4": _side(), "_o5": F.col("_r"), "_o6": F.col("claim_ord")}
    # One range sort: a study may hold any share of the claims.
    ranked = range_scan(both.withColumns(order | {"_new": F.lit(1).cast("long")}), ["study_id"], list(order), ["_new"])
    return ranked.drop("claim_ord").withColumnRenamed("_new", "claim_ord").select(*CLAIM)


def semantic_scores(themes: DataFrame, claims: DataFrame, helpers: DataFrame) -> DataFrame:
    """Score of each theme: background, claims, shared tokens with the helpers of the study, effect.

    The overlap with all helpers is a sum over tokens of how many helpers carry the token, so
    no theme-helper pair is ever formed.
    """
    h = helpers.groupBy("study_id", "helper_name").agg(
        F.max_by(token_set(F.col("helper_name"), F.col("helper_class"), F.col("top_hallmark")), "ord").alias("_t"))
    carried = h.select("study_id", F.explode("_t").alias("t")).groupBy("study_id", "t").agg(F.count(F.lit(1)).alias("_n"))
    tt = themes.select("study_id", "theme_id", F.explode("theme_tokens").alias("t"))
    overlap = tt.join(carried, ["study_id", "t"]).groupBy("study_id", "theme_id").agg(F.sum("_n").alias("_shared"))
    c = claims.select("study_id", "theme_id", _named().alias("_h"), token_set(
        F.col("helper_name"), F.col("helper_class"), F.col("helper_top_hallmark")).alias("_ct"))
    c = c.join(themes.select("study_id", "theme_id", "theme_tokens", "touches_background"), ["study_id", "theme_id"])
    n = F.size(F.array_intersect("_ct", "theme_tokens"))
    gain = F.when(F.col("_h") & (n > 0), 3.0 + n * 1.5).when(F.col("_h"), 1.0).when(F.col("touches_background"), 2.5).otherwise(0.0)
    claimed = c.groupBy("study_id", "theme_id").agg(F.sum(gain).alias("_claims"))
    j = themes.join(overlap, ["study_id", "theme_id"], "left").join(claimed, ["study_id", "theme_id"], "left")
    zero = F.lit(0.0)
    score = (
        F.when(F.col("touches_background"), 10.0).otherwise(0.0) + F.coalesce("_claims", zero)
        + 3.0 * F.coalesce("_shared", zero) + F.abs("effect") * 0.1)
    return j.select("study_id", "theme_id", F.round(score, 9).alias("semantic_score"))


def select_themes(
    themes: DataFrame, claims: DataFrame, helpers: DataFrame, settings: LinkSettings
) -> tuple[DataFrame, DataFrame]:
    """Themes kept for reporting with their order, and the claims that stay with them.

    Quota per direction: themes with helper claims, then up to three theme-only ones, then
    the best scored until the cap; the best background theme goes first. A theme that is in
    both claim lists takes two places but is reported once. The total cap drops themes
    without helper claims first, then the smallest effects. All steps are ranked filters.
    """
    key = ["study_id", "theme_id"]
    side = ["study_id", "direction"]
    scored = themes.join(semantic_scores(themes, claims, helpers), key)
    w = Window.partitionBy(*side).orderBy(F.col("semantic_score").desc(), F.abs("effect").desc(), "theme_pos")
    t = scored.withColumn("_ord", F.row_number().over(w))
    held = claims.groupBy(*key).agg(
        F.min(F.when(_named(), F.col("claim_ord"))).alias("_h"), F.min(F.when(~_named(), F.col("claim_ord"))).alias("_o"))
    t = t.join(held, key, "left")
    whole = Window.partitionBy(*side)
    t = t.withColumn("_nh", F.count("_h").over(whole)).withColumn(
        "_ro", F.when(F.col("_o").isNotNull(), F.row_number().over(whole.orderBy(F.col("_o").asc_nulls_last()))))
    cap = settings.theme_cap
    slots = F.greatest(F.lit(0), F.lit(cap) - F.col("_nh")) if cap > 0 else F.lit(2**31 - 1)
    t = t.withColumn("_only", F.col("_ro").isNotNull() & (F.col("_ro") <= F.least(F.lit(3), slots)))
    t = t.withColumn("_taken", F.count_if("_only").over(whole)).withColumn(
        "_in", F.col("_h").isNotNull() | F.col("_only"))
    if cap > 0:
        free = F.greatest(F.lit(0), F.lit(cap) - F.col("_nh")) - F.col("_taken")
        t = t.withColumn("_rf", F.when(~F.col("_in"), F.row_number().over(
            Window.partitionBy(*side, "_in").orderBy("_ord"))))
        # With no slot left the first scored theme is still looked at once.
        fill = ~F.col("_in") & F.when(free > 0, F.col("_rf") <= free).otherwise(F.col("_ord") == 1)
        t = t.withColumn("_fill", fill)
    else:
        t = t.withColumn("_fill", F.lit(False))
    prime = F.min(F.when(F.col("touches_background"), F.col("_ord"))).over(whole)
    t = t.withColumn("_prime", F.coalesce(F.col("_ord") == prime, F.lit(False)))
    kept = t.where(F.col("_in") | F.col("_fill") | F.col("_prime"))
    block = F.when(F.col("_prime"), 0).when(F.col("_h").isNotNull(), 1).when(F.col("_only"), 2).otherwise(3)
    within = F.when(F.col("_h").isNotNull(), F.col("_h")).when(F.col("_only"), F.col("_o")).otherwise(F.col("_ord"))
    kept = kept.withColumn("_place", F.row_number().over(whole.orderBy(block, within)))
    study = Window.partitionBy("study_id")
    if settings.theme_cap_total > 0:
        backed = F.col("_h").isNotNull()
        kept = kept.withColumn("_n", F.count(F.lit(1)).over(study)).withColumn("_limit", F.greatest(
            F.count("_h").over(study), F.lit(max(1, settings.theme_cap_total))))
        drop_order = F.row_number().over(study.orderBy(
            F.when(backed, 1).otherwise(0), F.abs("effect"), _side(), "_place"))
        kept = kept.withColumn("_drop", drop_order).where(F.col("_drop") > F.col("_n") - F.col("_limit"))
    out = kept.select(*themes.columns, "semantic_score", F.col("_place").alias("place"))
    return out, claims.join(out.select(*key), key, "left_semi")


def number_claims(claims: DataFrame) -> DataFrame:
    """claim_id ``claim_0``, ``claim_1``, ... in claim order."""
    n = ordered_scan(claims, ["study_id"], [F.col("claim_ord")], "_n")
    return n.withColumn("claim_id", F.concat(F.lit("claim_"), (F.col("_n") - 1).cast("string"))).drop("_n")


# ---- evidence ---------------------------------------------------------------------------

def open_envelopes(answers: DataFrame) -> DataFrame:
    """Entries of JSON answers: a list, one object with a claim_id, or a list under a usual key.

    ``answers``: study_id, answer_ord, body. Code fences around the body are removed.
    """
    bare = F.regexp_replace(F.trim("body"), r"^`{3,}(json)?\s*|\s*`{3,}$", "")
    v = answers.select("study_id", "answer_ord", F.try_parse_json(bare).alias("_v"))
    lists = [F.try_variant_get("_v", p, "array<variant>") for p in ("$.claims", "$.entries", "$.results", "$.data")]
    single = F.when(F.coalesce(F.try_variant_get("_v", "$.claim_id", "string"), F.lit("")) != "", F.array("_v"))
    entries = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), single, *lists)
    return v.select("study_id", "answer_ord", F.posexplode(entries).alias("entry_ord", "entry"))


def nested_texts(body: str | None) -> list[str]:
    """Trimmed strings of a JSON value of any depth: text, lists, and objects under the usual keys, in order."""
    todo, out = [json.loads(body)] if body else [], []
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            out.append(value.strip(" "))
        elif isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            todo.extend(value[k] for k in reversed(SNIPPET_KEYS) if k in value)
    return [s for s in out if s]


def collect_snippets(v: Column) -> Column:
    """``nested_texts`` of a variant; depth has no bound, so the walk is a batched function over the text of the value."""
    @F.pandas_udf("array<string>")
    def walk(bodies: pd.Series) -> pd.Series:
        return bodies.map(nested_texts)

    return walk(F.to_json(v))


def _texts(v: Column) -> Column:
    """A string or a list of strings as trimmed, non-empty texts."""
    one = F.when(F.schema_of_variant(v) == "STRING", F.array(F.trim(F.try_variant_get(v, "$", "string"))))
    many = F.filter(F.transform(F.try_variant_get(v, "$", "array<string>"), lambda t: F.trim(t)), lambda s: s != "")
    return F.coalesce(one, many, F.array().cast("array<string>"))


def read_evidence(entries: DataFrame) -> DataFrame:
    """Evidence fields per (study, claim_id); of repeated claim ids the last entry counts."""
    e = F.col("entry")
    none = F.array().cast("array<string>")
    snippets = F.concat(*[
        F.coalesce(collect_snippets(F.try_variant_get(e, f"$.{k}", "variant")), none)
        for k in ("evidence", "evidence_snippets", "snippets")])
    preds = F.coalesce(_texts(F.try_variant_get(e, "$.predictions", "variant")), none)
    spare = F.array(F.lit(say.NEW_ASSAY_1), F.lit(say.NEW_ASSAY_2))
    padded = F.when(F.size(preds) < 2, F.concat(preds, F.slice(spare, F.lit(1), 2 - F.size(preds)))).otherwise(preds)
    text = lambda k: F.nullif(F.try_variant_get(e, f"$.{k}", "string"), F.lit(""))
    flat = entries.select(
        "study_id", text("claim_id").alias("claim_id"), F.struct("answer_ord", "entry_ord").alias("_o"),
        snippets.alias("snippets"), padded.alias("predictions"),
        F.coalesce(text("alternative"), F.lit(say.OTHER_PROGRAMS)).alias("alternative"),
        F.coalesce(text("missing_or_conflicting"), F.lit("")).alias("gaps"), F.to_json("entry").alias("raw_entry"))
    fields = ["snippets", "predictions", "alternative", "gaps", "raw_entry"]
    last = flat.where(F.col("claim_id").isNotNull()).groupBy("study_id", "claim_id").agg(
        F.max_by(F.struct(*fields), "_o").alias("_e"))
    return last.select("study_id", "claim_id", "_e.*")


def _theme_part(themes: DataFrame) -> DataFrame:
    return themes.select(
        "study_id", "theme_id", F.col("label").alias("_label"),
        F.col("top_pathways.term").alias("_terms"), F.col("leading_edges").alias("_genes"))


def _first(items: Column, n: int, otherwise: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, n), ", ")).otherwise(otherwise)


def attach_evidence(claims: DataFrame, themes: DataFrame, evidence: DataFrame | None, helpers: DataFrame) -> DataFrame:
    """Claims with snippets, alternative, gaps and predictions; templates where no answer helps."""
    j = claims.join(_theme_part(themes), ["study_id", "theme_id"], "left")
    meta = helpers.groupBy("study_id", "helper_name", "direction").agg(
        F.max_by(F.coalesce(F.nullif(F.col("top_hallmark"), F.lit("")), F.col("helper_class")), "ord").alias("_meta"))
    j = j.join(meta, ["study_id", "helper_name", "direction"], "left")
    if evidence is not None:
        j = j.join(evidence, ["study_id", "claim_id"], "left")
    else:
        null = F.lit(None)
        j = j.withColumns({
            "snippets": null.cast("array<string>"), "predictions": null.cast("array<string>"),
            "alternative": null.cast("string"), "gaps": null.cast("string"), "raw_entry": null.cast("string")})
    answered = F.col("predictions").isNotNull()
    about = F.when(F.col("_label").isNotNull(), F.concat(
        F.col("_label"), F.lit(" "), F.col("direction"), F.lit(" shift tracks "), _first(F.col("_terms"), 2, "theme pathways"),
        F.lit(" and genes "), _first(F.col("_genes"), 3, "leading-edge genes"), F.lit("."))).otherwise(F.concat(
            F.col("theme_label"), F.lit(" "), F.col("direction"), F.lit(say.FOLLOWS_GENES)))
    known = answered & F.col("_meta").isNotNull()
    mark = F.coalesce(F.nullif(F.col("helper_top_hallmark"), F.lit("")), F.col("helper_class"))
    helper_line = F.when(known, F.concat(
        F.lit("Helper "), F.col("helper_name"), F.lit(" reflects "), F.col("_meta"), F.lit(say.SUPPORTS_RESPONSE))).otherwise(
        F.concat(F.lit("Helper "), F.col("helper_name"), F.lit(" captures "), mark, F.lit(say.FITS_THEME)))
    template = F.when(_named(), F.array(about, helper_line)).otherwise(F.array(about))
    empty = F.coalesce(F.size("snippets"), F.lit(0)) <= 0
    usual = F.array(F.lit(say.ASSAY_MARKS), F.lit(say.ASSAY_ATLAS))
    return j.select(
        *CLAIM, "claim_id",
        F.when(empty, template).otherwise(F.col("snippets")).alias("evidence_snippets"),
        F.coalesce("alternative", F.lit(say.OTHER_REGULATORS)).alias("alternative"),
        F.coalesce("gaps", F.lit("")).alias("gaps"), F.coalesce("predictions", usual).alias("predictions"), "raw_entry",
        F.when(answered, "llm").otherwise("fallback").alias("source"), (~answered | empty).alias("used_fallback_snippets"))


def verdict_of(gaps: Column, snippets: Column) -> tuple[Column, Column]:
    """Verdict and reason from the evidence alone."""
    n = F.size(F.filter(snippets, lambda s: F.trim(s) != ""))
    conflict = F.contains(F.lower(F.coalesce(gaps, F.lit(""))), F.lit("conflict"))
    verdict = F.when(conflict, "Hypothesis").when(n >= 2, "Supported").when(n == 1, "Partial").otherwise("Hypothesis")
    reason = F.when(conflict, gaps).when(n >= 2, say.TWO_SNIPPETS).when(
        n == 1, say.ONE_SNIPPET).otherwise(say.NO_SNIPPET)
    return verdict, reason


def review_claims(claims: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """Verdicts: a review found by claim id, else by (theme, helper), else the deterministic rule.

    ``reviews``: study_id, review_ord, claim_id, theme_id, helper_name, verdict,
    verdict_reason, alternative, gaps, predictions. Without a table every verdict is derived.
    """
    own, why = verdict_of(F.col("gaps"), F.col("evidence_snippets"))
    if reviews is None:
        return claims.withColumn("verdict", own).withColumn("verdict_reason", why)
    body = F.struct("verdict", "verdict_reason", "alternative", "gaps", "predictions")
    has_id = F.coalesce("claim_id", F.lit("")) != ""
    by_id = reviews.where(has_id).groupBy("study_id", "claim_id").agg(F.max_by(body, "review_ord").alias("_r1"))
    by_pair = reviews.where(~has_id).groupBy("study_id", "theme_id", F.col("helper_name").alias("_hn")).agg(
        F.max_by(body, "review_ord").alias("_r2"))
    c = claims.join(by_id, ["study_id", "claim_id"], "left").alias("c")
    p = by_pair.alias("p")
    same = (F.col("c.study_id") == F.col("p.study_id")) & (F.col("c.theme_id") == F.col("p.theme_id")) & (
        F.col("c.helper_name").eqNullSafe(F.col("p._hn")))
    j = c.join(p, same, "left").select("c.*", F.coalesce("c._r1", "p._r2").alias("_r"))
    given = F.nullif(F.col("_r.verdict"), F.lit(""))
    pick = lambda name: F.coalesce(F.nullif(F.col(f"_r.{name}"), F.lit("")), F.col(name))
    preds = F.when(F.size("_r.predictions") > 0, F.transform("_r.predictions", lambda t: F.trim(t))).otherwise(F.col("predictions"))
    return j.withColumns({
        "verdict": F.coalesce(given, own),
        "verdict_reason": F.when(given.isNull(), why).otherwise(F.coalesce(
            F.nullif(F.col("_r.verdict_reason"), F.lit("")), F.lit(say.NO_CRITIC))),
        "alternative": pick("alternative"), "gaps": pick("gaps"), "predictions": preds,
    }).drop("_r")


# ---- revision ---------------------------------------------------------------------------

def claim_signature(theme_id: Column, helper_class: Column, hallmark: Column, name: Column) -> Column:
    label = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")
    mark = F.coalesce(F.nullif(F.lower(hallmark), F.lit("")), label)
    return F.concat_ws("|", theme_id, helper_class, mark)


def revision_gates(
    verdict: Column, snippets: Column, gaps: Column, alternative: Column, helper_class: Column,
    helper_direction: Column, direction: Column,
) -> Column:
    """Sorted distinct issues of a reviewed claim."""
    v = F.lower(verdict)
    few = F.size(snippets) < 2
    weak = (v == "not supported") | ((v == "hypothesis") & (helper_class != THEME_ONLY)) | ((v == "partial") & few)
    conflict = F.lower(F.concat_ws(" ", gaps, F.lit("|"), alternative)).rlike("contrad|opposite")
    issues = F.array(
        F.when(conflict, "background conflict"), F.when(helper_direction != direction, "direction mismatch"),
        F.when(few, "insufficient evidence"), F.when(weak, "weak evidence"))
    return F.array_compact(issues)


def calibrated(confidence: Column, verdict: Column) -> Column:
    v = F.lower(verdict)
    return F.when(v == "supported", "high").when(v == "partial", "medium").when(
        v.isin("hypothesis", "not supported"), "low").otherwise(confidence)


def revise_claims(
    reviewed: DataFrame, themes: DataFrame, helpers: DataFrame, expectations: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Risk-gated revision: (claims with evidence, notes).

    Only a severe issue changes a claim: it gets the first helper of its direction that the
    theme has not used, or becomes theme-only. Which helpers are used depends on the claims
    before it, so the choice is a fold over the ordered claims of one theme.
    ``expectations``: study_id, expected (text of the expected-trends field).
    """
    issues = revision_gates(
        F.col("verdict"), F.col("evidence_snippets"), F.col("gaps"), F.col("alternative"), F.col("helper_class"),
        F.col("_hd"), F.col("direction"))
    refs = helpers.select("study_id", "helper_name", "direction", F.col("direction").alias("_hd")).distinct()
    c = reviewed.join(refs, ["study_id", "helper_name", "direction"], "left").withColumn("issues", issues).drop("_hd")
    severe = F.arrays_overlap("issues", F.array(F.lit("direction mismatch"), F.lit("background conflict")))
    c = c.withColumn("_severe", severe)

    # As many candidates per direction as the longest theme could use up.
    need = c.groupBy("study_id", "theme_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("study_id").agg(
        (F.max("_n") + 1).alias("_need"))
    first = helpers.groupBy("study_id", "direction", "helper_name").agg(
        F.min(F.struct("q_value", (-F.abs("nes")).alias("a"), "ord")).alias("_o"),
        F.min_by(F.struct("helper_class", "top_hallmark", "nes", "q_value"), F.struct("q_value", -F.abs("nes"), "ord")).alias("_h"))
    queue = ordered_scan(first, ["study_id", "direction"], [F.col("_o")], "_r").join(need, "study_id").where(
        F.col("_r") <= F.col("_need")).groupBy("study_id", "direction").agg(
        F.array_sort(F.collect_list(F.struct("_r", "helper_name")))["helper_name"].alias("_queue"))

    walk = c.groupBy("study_id", "theme_id", "direction").agg(F.array_sort(F.collect_list(F.struct(
        F.col("claim_ord").alias("o"), F.col("_severe").alias("s"), F.col("helper_name").alias("h")))).alias("_claims"))
    walk = walk.where(F.exists("_claims", lambda x: x["s"])).join(queue, ["study_id", "direction"], "left")
    blank = F.array().cast("array<string>")
    start = F.struct(blank.alias("used"), F.array().cast("array<struct<o:bigint,p:string>>").alias("picks"))

    def step(acc, x):
        free = F.filter(F.coalesce("_queue", blank), lambda n: ~F.array_contains(acc["used"], n) & ~n.eqNullSafe(x["h"]))
        pick = F.when(x["s"], F.get(free, F.lit(0)))
        final = F.when(x["s"], pick).otherwise(F.nullif(x["h"], F.lit("")))
        used = F.when(final.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], final))
        return F.struct(used.alias("used"), F.array_append(acc["picks"], F.struct(
            x["o"].alias("o"), pick.alias("p"))).alias("picks"))

    picks = walk.select("study_id", "theme_id", F.explode(
        F.aggregate("_claims", start, step, lambda a: a["picks"])).alias("_p")).select(
        "study_id", "theme_id", F.col("_p.o").alias("claim_ord"), F.col("_p.p").alias("_pick"))
    c = c.join(picks, ["study_id", "theme_id", "claim_ord"], "left")
    c = c.join(first.select("study_id", "direction", F.col("helper_name").alias("_pick"), "_h"), ["study_id", "direction", "_pick"], "left")
    c = c.join(_theme_part(themes), ["study_id", "theme_id"], "left")
    c = c.join(expectations, "study_id", "left") if expectations is not None else c.withColumn("expected", F.lit(""))

    has_theme = F.col("_label").isNotNull()
    genes = F.when(has_theme & (F.size("_genes") > 0), F.array_join(F.slice("_genes", 1, 3), ", ")).otherwise("")
    expected = F.coalesce("expected", F.lit(""))
    low = F.lower("direction")
    phrase = F.coalesce(hallmark_phrase(F.col("_h.top_hallmark")), F.concat("_h.helper_class", F.lit(" program")))
    subject = F.when(has_theme, F.col("_label")).otherwise(F.lit("The pathway"))
    lead = F.when(genes != "", F.concat(subject, F.lit(" "), low, F.lit(say.DRIVEN_BY), genes)).otherwise(
        F.concat(subject, F.lit(say.FOLLOWS_SHIFT)))
    swap_why = F.concat_ws(
        " ", lead, F.concat(F.coalesce("_pick", F.col("_h.helper_class")), F.lit(" captures the "), phrase, F.lit(say.LINKED_ACTIVITY)),
        F.when(expected != "", F.concat(F.lit("Expectation: "), F.substring(expected, 1, 140))))
    label = F.coalesce("_label", "theme_label")
    alone_why = F.concat(
        label, F.lit(" "), low, F.lit(say.RETAINED), genes,
        F.lit(") even though no enhancer helper survived gating."),
        F.when(expected != "", F.concat(F.lit(" Expected trend: "), F.substring(expected, 1, 140), F.lit("."))).otherwise(""))
    sets = F.when(has_theme & (F.size("_terms") > 0), F.array_join(F.slice("_terms", 1, 2), ", ")).otherwise(label)
    line1 = F.concat(label, F.lit(" "), F.col("direction"), F.lit(say.CONCENTRATES), sets)
    line2 = F.when(F.col("_pick").isNotNull(), F.concat(
        "_pick", F.lit(" models the "), phrase, F.lit(say.FITS_DIRECTION))).otherwise(
        say.NO_HELPER_QC)
    check = F.when(has_theme & (F.size("_genes") > 0), F.concat(
        F.lit("Check enhancer marks at "), F.array_join(F.slice("_genes", 1, 2), ", "))).otherwise(
        say.ASSAY_ACTIVATION)
    reason = F.when(F.col("_pick").isNotNull(), say.SWAPPED).otherwise(
        say.NO_HELPER_GATES)
    swapped = F.col("_severe") & F.col("_pick").isNotNull()
    bad = F.col("_severe")

    def choose(swap, alone, keep):
        return F.when(swapped, swap).when(bad, alone).otherwise(keep)

    none = F.lit(None)
    clean = F.size("issues") == 0
    claims = c.select(
        "study_id", "claim_ord", "theme_id", F.when(bad, label).otherwise(F.col("theme_label")).alias("theme_label"),
        choose(F.col("_pick"), none.cast("string"), F.col("helper_name")).alias("helper_name"),
        choose(F.col("_h.helper_class"), F.lit(THEME_ONLY), F.col("helper_class")).alias("helper_class"), "direction",
        choose(F.array(phrase), F.array(F.concat(label, F.lit(" program"))), F.col("function_phrases")).alias("function_phrases"),
        choose(swap_why, alone_why, F.col("rationale")).alias("rationale"),
        choose(F.when(F.coalesce(F.col("_h.top_hallmark"), F.lit("")) != "", "medium").otherwise("low"), F.lit("low"),
               F.when(clean, calibrated(F.col("confidence"), F.col("verdict"))).otherwise(F.col("confidence"))).alias("confidence"),
        choose(F.col("_h.top_hallmark"), none.cast("string"), F.col("helper_top_hallmark")).alias("helper_top_hallmark"),
        choose(F.col("_h.nes"), none.cast("double"), F.col("helper_effect")).alias("helper_effect"),
        choose(F.col("_h.q_value"), none.cast("double"), F.col("helper_q_value")).alias("helper_q_value"),
        F.when(bad, none.cast("string")).otherwise(F.col("claim_id")).alias("claim_id"),
        F.when(bad, F.array(line1, line2)).otherwise(F.col("evidence_snippets")).alias("evidence_snippets"),
        F.when(bad, say.AWAIT).otherwise(F.col("alternative")).alias("alternative"),
        F.when(bad, reason).otherwise(F.col("gaps")).alias("gaps"),
        F.when(bad, F.array(check, F.lit(say.ASSAY_REVERSAL))).otherwise(
            F.col("predictions")).alias("predictions"),
        choose(F.lit("Partial"), F.lit("Hypothesis"), F.col("verdict")).alias("verdict"),
        F.when(bad, reason).otherwise(F.col("verdict_reason")).alias("verdict_reason"), "issues")
    notes = c.where(bad).select(
        "study_id", "claim_ord", "theme_id", F.col("helper_name").alias("original_helper"), F.col("_pick").alias("new_helper"),
        F.when(F.col("_pick").isNotNull(), "replacement").otherwise("downgraded_to_theme_only").alias("action"),
        F.array_join("issues", ", ").alias("reason"))
    return claims, notes


def flag_duplicates(claims: DataFrame) -> DataFrame:
    """Marks helper claims whose signature occurs more than once in the study."""
    sig = claim_signature(F.col("theme_id"), F.col("helper_class"), F.col("helper_top_hallmark"), F.col("helper_name"))
    s = claims.withColumn("signature", F.when(_named(), sig))
    many = s.where(F.col("signature").isNotNull()).groupBy("study_id", "signature").agg(
        (F.count(F.lit(1)) > 1).alias("duplicate"))
    return s.join(many, ["study_id", "signature"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def first_per_pair(claims: DataFrame) -> DataFrame:
    """First claim of each (theme, helper), theme-only claims of a theme counting as one pair."""
    body = F.struct(*[c for c in claims.columns if c not in ("study_id", "theme_id", "helper_name", "claim_ord")])
    kept = claims.groupBy("study_id", "theme_id", "helper_name").agg(
        F.min("claim_ord").alias("claim_ord"), F.min_by(body, "claim_ord").alias("_b"))
    return kept.select("study_id", "theme_id", "helper_name", "claim_ord", "_b.*").select(*claims.columns)


def helper_means(themes: DataFrame, claims: DataFrame) -> DataFrame:
    """Themes with the mean effect of their helper claims."""
    m = claims.where(_named() & F.col("helper_effect").isNotNull()).groupBy("study_id", "theme_id").agg(
        F.avg("helper_effect").alias("helper_mean_effect"))
    return themes.join(m, ["study_id", "theme_id"], "left")


def thesis_themes(themes: DataFrame, claims: DataFrame, settings: LinkSettings) -> DataFrame:
    """Themes for the closing summary: helper themes first, then the strongest others, then claimed ones."""
    side = ["study_id", "direction"]
    held = claims.groupBy("study_id", "theme_id").agg(
        F.max(_named()).alias("_helped"), F.min("claim_ord").alias("_c"))
    t = themes.join(held, ["study_id", "theme_id"], "left").withColumn("_helped", F.coalesce("_helped", F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(*side, "_helped").orderBy("place"))
    loud = F.row_number().over(Window.partitionBy(*side, "_helped").orderBy(F.abs("effect").desc(), "place"))
    t = t.withColumn("_nth", nth).withColumn("_loud", loud)
    n_block = F.least(F.count_if("_helped").over(Window.partitionBy(*side)), F.lit(settings.thesis_helper_themes))
    t = t.withColumn("_nb", n_block)
    in_block = F.col("_helped") & (F.col("_nth") <= settings.thesis_helper_themes)
    cap = settings.thesis_theme_cap
    in_loud = ~F.col("_helped") & (F.col("_loud") <= F.lit(cap) - F.col("_nb")) if cap > 0 else F.lit(False)
    block = F.when(in_block, 0).when(in_loud, 1).when(F.col("_c").isNotNull(), 2)
    order = F.when(in_block, F.col("_nth")).when(in_loud, F.col("_loud")).otherwise(F.col("_c"))
    t = t.withColumn("_block", block).where(F.col("_block").isNotNull()).withColumn(
        "thesis_place", F.row_number().over(Window.partitionBy(*side).orderBy("_block", order)))
    if cap > 0:
        t = t.where(F.col("thesis_place") <= cap)
    return t.select(*themes.columns, "thesis_place")
