"""Weighted-pattern theming of result terms, theme ranking and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, text_variants
from ..params import LinkSettings
from ..session import cut_lineage
from ..sources.rules import Pattern, Rule, RuleBook
from .scan import ordered_scan

THEME = ["study_id", "direction"]


def _hit(pattern: Pattern, variants: dict[str, Column]) -> Column:
    regex = "(?iu)" + pattern.regex
    tests = [variants[t].rlike(regex) for t in pattern.targets if t in variants]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def rule_weight(rule: Rule, variants: dict[str, Column]) -> Column:
    """Weight of one rule: a pattern counts once however many of its targets match."""

    def total(patterns):
        out = F.lit(0.0)
        for p in patterns:
            out = out + F.when(_hit(p, variants), p.weight).otherwise(0.0)
        return out

    core, more = total(rule.canonical), total(rule.positive)
    weight = core + more + F.when((core != 0) & (more == 0), core * 0.25).otherwise(0.0)
    if rule.negative:
        refused = F.lit(False)
        for p in rule.negative:
            refused = refused | _hit(p, variants)
        weight = F.when(refused, 0.0).otherwise(weight)
    return weight


def match_themes(
    records: DataFrame, book: RuleBook, term: str = "term", source: str | None = None,
    description: str | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """One row per (record, theme) with a positive weight; ``theme_ord`` is the rule order.

    The rules become expressions over the row, so the records are neither joined nor moved.
    Their text forms are computed once per row, before any rule looks at them.
    """
    keep = keep or records.columns
    forms = text_variants(
        F.col(term), F.col(source) if source else None, F.col(description) if description else None)
    used = sorted({t for r in book.rules for p in (*r.canonical, *r.positive, *r.negative) for t in p.targets if t in forms})
    staged = records.withColumn("_forms", F.struct(*[forms[t].alias(t) for t in used]))
    variants = {t: F.col(f"_forms.{t}") for t in used}
    weighed = staged.select(*keep, F.array(*[rule_weight(r, variants) for r in book.rules]).alias("_w"))
    sources: dict[str, list[tuple[int, int, float]]] = {}
    for i, r in enumerate(book.rules):
        for j, (theme, factor) in enumerate(r.contributions):
            sources.setdefault(theme, []).append((i, 100 * i + j, factor))
    entries = []
    for theme, given in sources.items():
        total, seen = F.lit(0.0), F.lit(None).cast("int")
        for i, place, factor in given:
            w = F.get("_w", F.lit(i))
            total = total + w * factor
            seen = F.coalesce(seen, F.when(w > 0, place))
        entries.append(F.struct(F.lit(theme).alias("theme"), total.alias("weight"), seen.alias("theme_ord")))
    found = weighed.select(*keep, F.explode(F.filter(F.array(*entries), lambda e: e["weight"] > 0)).alias("_e"))
    return found.select(*keep, "_e.theme", "_e.weight", "_e.theme_ord")


def _priority(book: RuleBook, theme: Column) -> Column:
    out = F.lit(float(book.default_priority))
    for name, value in book.priorities.items():
        out = F.when(theme == name, float(value)).otherwise(out)
    return out


def rank_themes(matched: DataFrame, book: RuleBook, keys: list[str] | None = None) -> DataFrame:
    """Ranking score of each theme: weighted mean score times (1 + priority / 100).

    ``matched``: keys, theme, score, weight, and ``rec_ord`` / ``theme_ord`` for first-seen order.
    """
    keys = keys or THEME
    agg = matched.where(F.col("weight") > 0).groupBy(*keys, "theme").agg(
        F.sum(F.col("score") * F.col("weight")).alias("_signal"), F.sum("weight").alias("total_weight"),
        F.count(F.lit(1)).alias("n_terms"), F.min(F.struct("rec_ord", "theme_ord")).alias("first_seen"))
    base = F.col("_signal") / F.greatest("total_weight", F.lit(1e-6))
    return agg.select(
        *keys, "theme", "total_weight", "n_terms", "first_seen",
        F.round(base * (1.0 + _priority(book, F.col("theme")) / 100.0), 12).alias("ranking_score"))


def _cap(cap: int) -> int | None:
    return cap if cap > 0 else None


def group_themes(records: DataFrame, book: RuleBook, settings: LinkSettings, cap: int) -> DataFrame:
    """Terms assigned to kept themes: study_id, direction, theme_pos, label, pos, record columns.

    Records: study_id, direction, rec_ord, term, source, nes, q_value, size, score,
    leading_edge. Unmatched terms fill free places as single-term themes and what is left
    over joins the last theme.
    """
    cap_n = _cap(cap)
    cols = ["term", "source", "nes", "q_value", "size", "score", "leading_edge"]
    same = records.groupBy(*THEME, *cols).agg(F.min("rec_ord").alias("rec_ord"), F.count(F.lit(1)).alias("_copies"))
    matched = match_themes(
        same, book, "term", "source", keep=[*THEME, *cols, "rec_ord", "_copies"]
    ).withColumn("weight", F.col("weight") * F.col("_copies")).drop("_copies")
    # One row per matched term and theme, read by several steps.
    matched = cut_lineage(matched)
    ranked = rank_themes(matched, book)
    w = Window.partitionBy(*THEME).orderBy(F.col("ranking_score").desc(), "first_seen")
    kept = ranked.withColumn("theme_pos", F.row_number().over(w))
    if cap_n is not None:
        kept = kept.where(F.col("theme_pos") <= cap_n)
    kept = kept.select(*THEME, "theme", "theme_pos")
    in_theme = matched.join(kept, [*THEME, "theme"]).select(
        *THEME, "theme_pos", F.col("theme").alias("label"), F.lit(0).alias("late"), "rec_ord", *cols)

    # Unmatched records, repeated as often as they occur.
    hit = matched.select(*THEME, "rec_ord").distinct()
    loose = records.withColumn("_first", F.min("rec_ord").over(Window.partitionBy(*THEME, *cols)))
    loose = loose.join(hit.withColumnRenamed("rec_ord", "_first"), [*THEME, "_first"], "left_anti").drop("_first")
    n_kept = kept.groupBy(*THEME).agg(F.count(F.lit(1)).alias("_kept"))
    queue = ordered_scan(
        loose.join(n_kept, THEME, "left").withColumn("_kept", F.coalesce("_kept", F.lit(0))),
        THEME, [-F.col("score"), F.col("rec_ord")], "_q").withColumn("_q", F.col("_q").cast("int"))
    places = F.lit(2**31 - 1) if cap_n is None else F.lit(cap_n) - F.col("_kept")
    single = F.col("_q") <= places
    label = F.concat(F.lit("Additional "), F.col("direction"), F.lit(" signal "), F.col("_q").cast("string"), F.lit(": "), F.col("term"))
    queue = queue.withColumn("_single", single)
    alone = queue.where("_single").select(
        *THEME, (F.col("_kept") + F.col("_q")).alias("theme_pos"), label.alias("label"), F.lit(0).alias("late"), "rec_ord", *cols)
    parts = in_theme.unionByName(alone)
    if cap_n is None:
        return parts
    last = parts.groupBy(*THEME).agg(F.max(F.struct("theme_pos", "label")).alias("_last"))
    rest = queue.where(~F.col("_single")).join(last, THEME).select(
        *THEME, F.col("_last.theme_pos").alias("theme_pos"), F.col("_last.label").alias("label"),
        F.lit(1).alias("late"), "rec_ord", *cols)
    return cut_lineage(parts.unionByName(rest))


def summarise_themes(grouped: DataFrame, settings: LinkSettings, total_cap: int) -> DataFrame:
    """Condensed themes with effect, q, collection, voted leading edge and top pathways."""
    theme = [*THEME, "theme_pos", "label"]
    order = Window.partitionBy(*theme).orderBy(F.col("score").desc(), "late", "rec_ord")
    top = grouped.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= settings.theme_top_pathways)
    genes = top.select(*theme, "_r", F.posexplode("leading_edge").alias("_g", "gene")).withColumn("gene", F.trim("gene"))
    votes = genes.where(F.col("gene") != "").groupBy(*theme, "gene").agg(
        F.count(F.lit(1)).alias("_c"), F.min(F.struct("_r", "_g")).alias("_first"))
    edge = votes.groupBy(*theme).agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("_c")).alias("c"), F.col("_first").alias("f"), "gene"))), 1, settings.max_genes)["gene"].alias("leading_edges"))
    src = F.nullif(F.col("source"), F.lit(""))
    body = top.groupBy(*theme).agg(
        F.avg("nes").alias("effect"), F.min("q_value").alias("q_value"),
        F.min_by(src, F.when(src.isNotNull(), F.col("_r"))).alias("collection"),
        F.array_sort(F.collect_list(F.struct("_r", "term", "source", "nes", "q_value", "size"))).alias("_tp"))
    paths = F.transform("_tp", lambda t: F.struct(
        t["term"].alias("term"), t["source"].alias("source"), t["nes"].alias("nes"),
        t["q_value"].alias("q_value"), t["size"].alias("size")))
    out = body.join(edge, theme, "left").select(
        *THEME, "theme_pos",
        F.concat_ws("_", F.lower("direction"), F.col("theme_pos").cast("string"), slug(F.col("label"))).alias("theme_id"),
        "label", "collection", "effect", "q_value", paths.alias("top_pathways"),
        F.coalesce("leading_edges", F.array().cast("array<string>")).alias("leading_edges"))
    return cap_total(out, total_cap)


def cap_total(themes: DataFrame, total_cap: int) -> DataFrame:
    """Shrink both directions to ``total_cap`` themes by dropping the weakest of the longer side.

    The side sizes have a closed form, so this is one ranked filter. Equal effects drop the
    earlier theme. 0 keeps everything.
    """
    if total_cap <= 0:
        return themes
    c = F.lit(total_cap)
    sizes = themes.groupBy("study_id").agg(
        F.count_if(F.col("direction") == "UP").alias("_u"), F.count_if(F.col("direction") == "DOWN").alias("_d"))
    small = F.least("_u", "_d")
    up = F.when(F.col("_u") + F.col("_d") <= c, F.col("_u")).when(
        c >= 2 * small, F.when(F.col("_u") >= F.col("_d"), c - small).otherwise(small)).otherwise(F.floor(c / 2))
    down = F.when(F.col("_u") + F.col("_d") <= c, F.col("_d")).when(
        c >= 2 * small, F.when(F.col("_d") > F.col("_u"), c - small).otherwise(small)).otherwise(F.ceil(c / 2))
    w = Window.partitionBy(*THEME).orderBy(F.abs("effect").desc(), F.col("theme_pos").desc())
    ranked = themes.join(sizes, "study_id").withColumn("_r", F.row_number().over(w))
    allowed = F.when(F.col("direction") == "UP", up).otherwise(down)
    return ranked.where(F.col("_r") <= allowed).drop("_r", "_u", "_d")


def build_themes(
    records: DataFrame, book: RuleBook, settings: LinkSettings,
    cap: int | None = None, total_cap: int | None = None,
) -> DataFrame:
    cap = settings.theme_cap if cap is None else cap
    total = settings.theme_cap_total if total_cap is None else total_cap
    return summarise_themes(group_themes(records, book, settings, cap), settings, total)
