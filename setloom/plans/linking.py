"""Theme-claim linking of many studies in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking as lk
from ..operators.prefilter import rank_helpers, split_directions
from ..operators.themes import build_themes
from ..params import LinkSettings
from ..session import cut_lineage
from ..sources.forms import expectations
from ..sources.rules import RuleBook


def run_linking(
    gsea: DataFrame,
    helpers: DataFrame,
    forms: DataFrame,
    book: RuleBook,
    settings: LinkSettings = LinkSettings(),
    linker_items: DataFrame | None = None,
    answers: DataFrame | None = None,
    reviews: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Themes, claims with evidence and verdicts, notes and the closing theme list.

    ``gsea``: normalised result rows; ``helpers``: normalised helper rows; ``forms``: parsed
    background forms. ``linker_items``, ``answers`` and ``reviews`` are what outside
    reviewers supplied; without them every step falls back to its rule. Condensed themes
    and reviewed claims are a few dozen rows per study and are kept between the steps.
    """
    ranked = cut_lineage(rank_helpers(helpers, settings))
    records = cut_lineage(split_directions(gsea, settings))
    found = build_themes(records, book, settings, settings.linker_theme_cap, settings.linker_theme_cap_total)
    background = lk.background_tokens(forms)
    themes = cut_lineage(lk.with_theme_tokens(found, background))

    batched = lk.theme_batches(themes, settings.themes_per_batch)
    if linker_items is None:
        spark = gsea.sparkSession
        valid = spark.createDataFrame([], (
            "study_id string, batch_id int, item_ord long, theme_id string, theme_label string, helper_name string, "
            "helper_class string, direction string, function_phrases array<string>, rationale string, confidence string, "
            "helper_top_hallmark string, helper_effect double, helper_q_value double"))
    else:
        valid = lk.validate_claims(linker_items, themes, ranked, settings.claims_per_batch)
    claims = lk.dedupe_claims(lk.batch_claims(valid, batched, settings))
    claims = lk.add_background_claims(cut_lineage(claims), themes)
    claims = cut_lineage(lk.cover_directions(claims, themes, settings.coverage_cap))
    claims = cut_lineage(lk.prioritise_claims(claims, settings))

    chosen, kept = lk.select_themes(themes, claims, ranked, settings)
    chosen = cut_lineage(chosen)
    kept = claims.join(chosen.select("study_id", "theme_id"), ["study_id", "theme_id"], "left_semi")
    numbered = lk.number_claims(kept)
    evidence = None if answers is None else lk.read_evidence(lk.open_envelopes(answers))
    backed = cut_lineage(lk.attach_evidence(numbered, chosen, evidence, ranked))
    reviewed = cut_lineage(lk.review_claims(backed, reviews))
    revised, notes = lk.revise_claims(reviewed, chosen, ranked, expectations(forms))
    final = cut_lineage(lk.first_per_pair(revised))
    summary = lk.helper_means(chosen, final)
    return {
        "records": records, "candidates": themes, "helpers": ranked, "themes": summary, "evidence": backed,
        "claims": final, "notes": notes, "thesis": lk.thesis_themes(summary, final, settings),
        "studies": gsea.select("study_id").distinct(),
    }
