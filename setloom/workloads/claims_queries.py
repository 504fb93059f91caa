"""Claims, verdicts, verification, report tables and the complete linking run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking as lk, prefilter as pf, report as rp, verify as vf
from ..params import LinkSettings
from ..plans.linking import run_linking
from ..sources import artefacts as art
from ..sources.forms import parse_forms
from .roles import RESULTS_SQL, results, rounded, table
from .text_queries import RULES, _records


def _claims(spark, sf):
    """Order lines as claims: supplier = theme, line number = helper, tax = confidence."""
    li = table(spark, sf, "lineitem")
    level = F.when(F.col("l_tax") >= 0.06, "HIGH").when(F.col("l_tax") >= 0.03, "medium").when(F.col("l_tax") >= 0.01, "low").otherwise("unsure")
    return li.select(
        F.col("l_returnflag").alias("study_id"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100003 + F.col("l_partkey")) * 1009 + F.col("l_suppkey")).alias("claim_ord"),
        F.concat(F.lit("t"), "l_suppkey").alias("theme_id"), F.concat(F.lit("T"), "l_suppkey").alias("theme_label"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("h"), "l_linenumber")).alias("helper_name"),
        F.lit("celltype").alias("helper_class"), F.when(F.col("l_linestatus") == "O", "UP").otherwise("DOWN").alias("direction"),
        F.array(F.col("l_linestatus")).alias("function_phrases"), F.col("l_partkey").cast("string").alias("rationale"),
        level.alias("confidence"), F.lit(None).cast("string").alias("helper_top_hallmark"),
        (F.col("l_quantity") - 25).alias("helper_effect"), F.col("l_discount").alias("helper_q_value"))


_CLAIMS_SQL = """cl AS (SELECT l_returnflag AS study_id, ((l_orderkey * 8 + l_linenumber) * 100003 + l_partkey) * 1009 + l_suppkey AS claim_ord, 't' || l_suppkey AS theme_id,
  CASE WHEN l_linenumber < 7 THEN 'h' || l_linenumber END AS helper_name, l_linestatus,
  CASE WHEN l_tax >= 0.06 THEN 'HIGH' WHEN l_tax >= 0.03 THEN 'medium' WHEN l_tax >= 0.01 THEN 'low' ELSE 'unsure' END AS confidence,
  CASE WHEN l_tax >= 0.06 THEN 3 WHEN l_tax >= 0.03 THEN 2 WHEN l_tax >= 0.01 THEN 1 ELSE 0 END AS cr,
  CAST(l_partkey AS VARCHAR) AS rationale, l_quantity - 25 AS helper_effect, l_discount AS q FROM lineitem)"""


def claim_dedupe(spark, sf):
    return lk.dedupe_claims(_claims(spark, sf)).select(
        "study_id", "claim_ord", "theme_id", "helper_name", "confidence", "helper_effect", "rationale")


def claim_duplicates(spark, sf):
    return lk.flag_duplicates(_claims(spark, sf)).select("study_id", "claim_ord", "signature", "duplicate")


def claim_priority(spark, sf):
    p = lk.prioritise_claims(_claims(spark, sf), LinkSettings())
    return p.select("study_id", "claim_ord", "theme_id", "helper_name", "helper_effect", "helper_q_value")


def first_per_pair(spark, sf):
    return lk.first_per_pair(_claims(spark, sf)).select("study_id", "theme_id", "helper_name", "claim_ord")


def _reviewed(spark, sf):
    """Documents as claims: sentences as snippets, the text itself as the gap statement."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.replace("text", F.lit(" und "), F.lit(" conflict ")).alias("gaps"),
        F.split("text", r"\.\s").alias("snippets"), F.col("source").alias("alternative"))


def verdict(spark, sf):
    v, why = lk.verdict_of(F.col("gaps"), F.col("snippets"))
    return _reviewed(spark, sf).select("doc_id", v.alias("verdict"), F.md5(why).alias("reason"))


def revision_gates(spark, sf):
    v, _ = lk.verdict_of(F.col("gaps"), F.col("snippets"))
    g = lk.revision_gates(v, F.col("snippets"), F.replace("gaps", F.lit("the"), F.lit("opposite")), F.col("alternative"),
                          F.lit("celltype"), F.lit("UP"), F.lit("UP"))
    return _reviewed(spark, sf).select("doc_id", F.array_join(g, ",").alias("issues"))


def confidence_levels(spark, sf):
    v, _ = lk.verdict_of(F.col("gaps"), F.col("snippets"))
    return _reviewed(spark, sf).select("doc_id", lk.calibrated(F.lit("none"), v).alias("confidence"))


def _effects(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.round((F.col("l_quantity") - 25) / 50, 2).alias("effect"), F.round(F.col("l_tax") * 2, 2).alias("q"),
        F.when(F.col("l_linestatus") == "O", "UP").otherwise("DOWN").alias("direction"),
        F.when(F.col("l_returnflag") == "R", "Yes — returned").otherwise("no").alias("flag"))


def support_decision(spark, sf):
    d = vf.support_decision(F.col("effect"), F.col("q"), F.col("direction"))
    return _effects(spark, sf).select("l_orderkey", "l_linenumber", vf.downgraded(d, F.col("flag")).alias("decision"))


def support_rows(spark, sf):
    e = table(spark, sf, "supplier").select(
        F.lit("S").alias("study_id"), F.col("s_suppkey").alias("ord"), F.concat(F.lit(" "), F.upper("s_name")).alias("cell_type"),
        (F.col("s_acctbal") / 10000).alias("effect_size"), (F.col("s_nationkey") / 200).alias("q_value"))
    c = table(spark, sf, "lineitem").select(
        F.lit("S").alias("study_id"), F.col("l_linestatus").alias("theme"), F.when(F.col("l_returnflag") == "A", "UP").otherwise("DOWN").alias("direction"),
        F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") + 50).cast("string"), 9, "0")).alias("cell_type")).distinct()
    return vf.decide(c, e).select("theme", "direction", "cell_type", "decision", "effect_size")


def edge_widths(spark, sf):
    v = F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).when(F.col("l_returnflag") == "A", "Partial")
    w = rp.edge_width(v, F.when(F.col("l_tax") > 0, F.col("l_tax") / 1000), F.lit("high"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(w, 6).alias("width"))


def prediction_categories(spark, sf):
    """Whole document and benchmark texts sorted into follow-up categories."""
    d = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("schei"), F.lit("block")).alias("t"))
    return d.select("doc_id", rp.prediction_category(F.col("t")).alias("category"))


def prediction_flow(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("lang").alias("study_id"), F.col("source").alias("theme_id"), F.split("text", r"\.\s").alias("predictions"))
    return rp.prediction_flow(d)


def _reviews(spark, sf):
    o = table(spark, sf, "orders")
    v = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "Not supported").otherwise("Partial")
    return o.select(F.lit("S").alias("study_id"), F.col("o_orderkey").cast("string").alias("theme_id"),
                    F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("helper_name"), v.alias("verdict"))


def verdict_matrix(spark, sf):
    return rp.verdict_matrix(_reviews(spark, sf))


def verdict_counts(spark, sf):
    return rp.verdict_counts(_reviews(spark, sf))


def _network(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.lit("S").alias("study_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_ord"),
        F.concat(F.lit("S"), "l_suppkey").alias("theme"), F.col("l_linestatus").alias("direction"), F.col("l_partkey").cast("string").alias("cell_type"),
        F.when(F.col("l_returnflag") == "R", "Refuted").when(F.col("l_returnflag") == "A", "Supported").otherwise("Other").alias("decision"),
        F.col("l_quantity").cast("string").alias("effect_size"), F.lit("NA").alias("q_value"), F.lit("none").alias("reason"))
    return rp.verification_network(rows)


def network_nodes(spark, sf):
    return rounded(_network(spark, sf)[0], "radius")


def network_edges(spark, sf):
    return _network(spark, sf)[1].select("row_ord", "source", "target", "color", "width")


# ---- the complete run -----------------------------------------------------------------

def _helpers(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(
        F.lit("HALLMARK_"), F.upper(F.translate("p_name", " ", "_"))).alias("top_hallmark"))
    raw = results(spark, sf).join(names, "ord").select(
        "study_id", "ord", F.concat(F.when(F.col("ord") < 50, "FOX").otherwise("CELL"), F.col("ord").cast("string")).alias("helper_name"),
        F.when(F.col("ord") < 50, "tfbs").otherwise("lineage").alias("class"), F.col("nes").cast("string").alias("nes"),
        F.col("q_value").cast("string").alias("q_value"), F.col("size").cast("string").alias("size"), "top_hallmark")
    return pf.normalise_helpers(raw)


def _forms(spark, sf):
    """Study forms written from the region and part tables."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("n"), F.when(
        F.col("r_regionkey") == 0, F.concat(F.lit("Contrast: "), "r_name", F.lit(" vs rest"))).otherwise(F.concat(F.lit("- "), "r_name")).alias("value"))
    p = table(spark, sf, "part").select(F.col("p_type").alias("v")).distinct().select(
        F.lit(50).cast("long").alias("n"), F.concat(F.lit("Known biology: "), "v", F.lit(" machines")).alias("value"))
    studies = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("study_id")).distinct()
    # One row per return flag: a list in a row, not a join.
    every = studies.agg(F.sort_array(F.collect_set("study_id")).alias("_all")).first()[0]
    return r.unionByName(p).select(
        F.explode(F.array(*map(F.lit, every))).alias("study_id"), F.col("n").alias("line_no"), "value")


def background_forms(spark, sf):
    return parse_forms(_forms(spark, sf)).select("study_id", "key", "ord", "line")


def _run(spark, sf):
    return run_linking(_records(spark, sf), _helpers(spark, sf), parse_forms(_forms(spark, sf)), RULES,
                       LinkSettings(gsea_q_threshold=0.5))


def linking_themes(spark, sf):
    return art.theme_export(_run(spark, sf)["themes"]).select(
        "study_id", "direction", "place", "theme_id", "label", "effect", "q_value", "helper_mean_effect", F.array_join("leading_edges", ",").alias("genes"))


def linking_claims(spark, sf):
    return art.evidence_box(_run(spark, sf)["claims"])


def linking_fallback(spark, sf):
    """Every theme with the helpers of its direction."""
    from ..operators.themes import build_themes

    s = LinkSettings(gsea_q_threshold=0.5, helper_claims_per_theme=2)
    t = build_themes(pf.split_directions(_records(spark, sf), s), RULES, s)
    return lk.fallback_claims(t, pf.rank_helpers(_helpers(spark, sf), s), s).select(
        "study_id", "theme_id", "helper_name", "helper_class", "rationale", "confidence")


def evidence_answers(spark, sf):
    """Event property documents wrapped as answers and opened again."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("study_id"), F.col("event_id").alias("answer_ord"), F.concat(
            F.lit('```json\n{"results": [{"claim_id": "c'), F.get_json_object("props", "$.k"),
            F.lit('", "evidence": ["'), F.col("user_id").cast("string"), F.lit('", {"text": " v '), F.col("event_id").cast("string"),
            F.lit(' "}, {"items": {"values": [[{"snippets": [{"text": "deep '), F.col("event_id").cast("string"),
            F.lit('"}]}]]}}], "predictions": "check '), F.col("event_id").cast("string"), F.lit('"}]}\n```')).alias("body"))
    r = lk.read_evidence(lk.open_envelopes(e))
    return r.select("study_id", "claim_id", F.array_join("snippets", "|").alias("snippets"), F.array_join("predictions", "|").alias("predictions"), "gaps")


QUERIES = {
    "claim_dedupe": claim_dedupe, "claim_duplicates": claim_duplicates, "claim_priority": claim_priority,
    "first_per_pair": first_per_pair, "verdict": verdict, "revision_gates": revision_gates,
    "confidence_levels": confidence_levels, "support_decision": support_decision, "support_rows": support_rows,
    "edge_widths": edge_widths, "prediction_categories": prediction_categories, "prediction_flow": prediction_flow,
    "verdict_matrix": verdict_matrix, "verdict_counts": verdict_counts, "network_nodes": network_nodes,
    "network_edges": network_edges, "background_forms": background_forms, "linking_themes": linking_themes,
    "linking_claims": linking_claims, "linking_fallback": linking_fallback, "evidence_answers": evidence_answers,
}

_REVIEWED = r"""rv AS (SELECT doc_id, replace(text, ' und ', ' conflict ') AS gaps, source,
  regexp_split_to_array(text, '\.\s') AS sn FROM documents),
 vd AS (SELECT *, contains(lower(gaps), 'conflict') AS cf, len(list_filter(sn, lambda s: trim(s, ' ') <> '')) AS n FROM rv)"""
_VERDICT = "CASE WHEN cf THEN 'Hypothesis' WHEN n >= 2 THEN 'Supported' WHEN n = 1 THEN 'Partial' ELSE 'Hypothesis' END"
_CAT = """CASE WHEN regexp_matches(lower({t}), 'chromatin|h3k27|atac|enhancer|chip') THEN 'Chromatin/Enhancer'
  WHEN regexp_matches(lower({t}), 'rna|transcript|expression|bulk|single-cell') THEN 'Gene Expression'
  WHEN regexp_matches(lower({t}), 'crispr|perturb|knockdown|overexpress|inhibit|block') THEN 'Functional Perturbation' ELSE 'Phenotypic/Other' END"""

ORACLES = {
    "claim_dedupe": f"""WITH {_CLAIMS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY study_id, theme_id, helper_name
        ORDER BY cr DESC, abs(helper_effect) DESC, length(rationale) DESC, claim_ord) AS rn,
        min(claim_ord) OVER (PARTITION BY study_id, theme_id, helper_name) AS first FROM cl WHERE helper_name IS NOT NULL)
      SELECT study_id, first AS claim_ord, theme_id, helper_name, confidence, helper_effect, rationale FROM b WHERE rn = 1
      UNION ALL SELECT study_id, claim_ord, theme_id, helper_name, confidence, helper_effect, rationale FROM cl WHERE helper_name IS NULL""",
    "claim_duplicates": f"""WITH {_CLAIMS_SQL} SELECT study_id, claim_ord, CASE WHEN helper_name IS NOT NULL THEN theme_id || '|celltype|' || helper_name END AS signature,
      helper_name IS NOT NULL AND count(*) OVER (PARTITION BY study_id, theme_id, helper_name) > 1 AS duplicate FROM cl""",
    "claim_priority": f"""WITH {_CLAIMS_SQL}, x AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS d,
        row_number() OVER (PARTITION BY study_id, l_linestatus, helper_name IS NULL ORDER BY 'T' || substr(theme_id, 2), claim_ord) AS r FROM cl)
      SELECT study_id, row_number() OVER (PARTITION BY study_id ORDER BY helper_name IS NULL, -abs(helper_effect), coalesce(nullif(q, 0), 1), d,
        CASE WHEN helper_name IS NULL THEN r ELSE 0 END, claim_ord) AS claim_ord, theme_id, helper_name, helper_effect, q AS helper_q_value
      FROM x WHERE helper_name IS NOT NULL OR r <= 1""",
    "first_per_pair": f"WITH {_CLAIMS_SQL} SELECT study_id, theme_id, helper_name, min(claim_ord) AS claim_ord FROM cl GROUP BY ALL",
    "verdict": f"""WITH {_REVIEWED} SELECT doc_id, {_VERDICT} AS verdict, md5(CASE WHEN cf THEN gaps WHEN n >= 2 THEN 'Two or more specific evidence snippets available.'
      WHEN n = 1 THEN 'Single evidence snippet available.' ELSE 'No evidence snippets provided.' END) AS reason FROM vd""",
    "revision_gates": f"""WITH {_REVIEWED}, g AS (SELECT doc_id, {_VERDICT} AS v, len(sn) AS k, lower(replace(gaps, 'the', 'opposite') || ' | ' || source) AS t FROM vd)
      SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(t, 'contrad|opposite') THEN 'background conflict' END, CASE WHEN k < 2 THEN 'insufficient evidence' END,
        CASE WHEN v = 'Hypothesis' OR (v = 'Partial' AND k < 2) THEN 'weak evidence' END) AS issues FROM g""",
    "confidence_levels": f"WITH {_REVIEWED} SELECT doc_id, CASE {_VERDICT} WHEN 'Supported' THEN 'high' WHEN 'Partial' THEN 'medium' ELSE 'low' END AS confidence FROM vd",
    "support_decision": """WITH e AS (SELECT l_orderkey, l_linenumber, round((l_quantity - 25) / 50, 2) AS e, round(l_tax * 2, 2) AS q, l_linestatus, l_returnflag FROM lineitem),
      d AS (SELECT *, CASE WHEN (l_linestatus = 'O') <> (e > 0) OR e = 0 THEN 'Refuted' WHEN q <= 0.05 AND abs(e) >= 0.3 THEN 'Supported'
        WHEN q <= 0.1 OR abs(e) >= 0.2 THEN 'Partial' ELSE 'Refuted' END AS v FROM e)
      SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN v WHEN v = 'Supported' THEN 'Partial' ELSE 'Refuted' END AS decision FROM d""",
    "support_rows": """WITH c AS (SELECT DISTINCT l_linestatus AS theme, CASE WHEN l_returnflag = 'A' THEN 'UP' ELSE 'DOWN' END AS direction,
        'Supplier#' || lpad(CAST(l_suppkey + 50 AS VARCHAR), 9, '0') AS cell_type FROM lineitem),
      s AS (SELECT lower(s_name) AS label, arg_max((s_acctbal / 10000, s_nationkey / 200), s_suppkey) AS m FROM supplier GROUP BY 1),
      j AS (SELECT c.*, m[1] AS e, m[2] AS q FROM c LEFT JOIN s ON label = lower(cell_type))
      SELECT theme, direction, cell_type, CASE WHEN e IS NULL OR (direction = 'UP') <> (e > 0) OR e = 0 THEN 'Refuted' WHEN q <= 0.05 AND abs(e) >= 0.3 THEN 'Supported'
        WHEN q <= 0.1 OR abs(e) >= 0.2 THEN 'Partial' ELSE 'Refuted' END AS decision, CASE WHEN e IS NULL THEN 'NA' ELSE printf('%+.2f', e) END AS effect_size FROM j""",
    "edge_widths": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN 2.0 WHEN l_returnflag = 'A' THEN 2.6
      WHEN l_tax > 0 THEN least(4.0, greatest(1.2, -log10(greatest(l_tax / 1000, 1e-6)))) ELSE 3.0 END, 6) AS width FROM lineitem""",
    "prediction_categories": f"SELECT doc_id, {_CAT.format(t=chr(39).join(['replace(text, ', 'schei', ', ', 'block', ')']))} AS category FROM documents",
    "prediction_flow": f"""WITH p AS (SELECT lang AS study_id, source AS theme_id, unnest(list_slice(regexp_split_to_array(text, '\\.\\s'), 1, 2)) AS p FROM documents)
      SELECT study_id, theme_id, {_CAT.format(t='p')} AS category, count(*) AS n FROM p WHERE trim(p, ' ') <> '' GROUP BY ALL""",
    "verdict_matrix": """SELECT 'S' AS study_id, o_orderkey || ' | ' || CASE WHEN o_orderpriority = '5-LOW' THEN 'theme-only' ELSE o_orderpriority END AS label,
      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS supported, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END AS partial,
      CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS hypothesis, 0 AS not_supported FROM orders""",
    "verdict_counts": """SELECT 'S' AS study_id, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS supported, CAST(count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS BIGINT) AS partial,
      CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS hypothesis, CAST(0 AS BIGINT) AS not_supported FROM orders""",
    "network_nodes": """WITH t AS (SELECT 'S' || l_suppkey || ' (' || l_linestatus || ')' AS id, 'theme' AS class, count(*) AS degree FROM lineitem GROUP BY 1
        UNION ALL SELECT CAST(l_partkey AS VARCHAR), 'cell', count(*) FROM lineitem GROUP BY 1)
      SELECT 'S' AS study_id, id, class, degree, round(CASE WHEN class = 'theme' THEN 32 + degree * 2.0 ELSE 18 + degree * 1.2 END, 6)::DOUBLE AS radius,
        CASE WHEN class = 'theme' THEN '#6a51a3' ELSE '#17becf' END AS color, CASE WHEN class = 'theme' THEN 18 ELSE 14 END AS font_size FROM t""",
    "network_edges": """SELECT l_orderkey * 10 + l_linenumber AS row_ord, 'S' || l_suppkey || ' (' || l_linestatus || ')' AS source, CAST(l_partkey AS VARCHAR) AS target,
      CASE l_returnflag WHEN 'R' THEN '#d62728' WHEN 'A' THEN '#2ca02c' ELSE '#7f7f7f' END AS color, 2.5::DOUBLE AS width FROM lineitem""",
    "background_forms": """WITH s AS (SELECT DISTINCT l_returnflag AS study_id FROM lineitem),
      r AS (SELECT 'Contrast' AS key, CAST(r_regionkey AS BIGINT) AS ord, CASE WHEN r_regionkey = 0 THEN r_name || ' vs rest' ELSE r_name END AS line FROM region
        UNION ALL SELECT DISTINCT 'Known_Biology', CAST(50 AS BIGINT), p_type || ' machines' FROM part)
      SELECT study_id, r.* FROM s, r""",
    "evidence_answers": """WITH x AS (SELECT event_type AS study_id, 'c' || regexp_extract(props, '"k": *([0-9]+)', 1) AS claim_id, event_id, user_id FROM events),
      y AS (SELECT study_id, claim_id, max(event_id) AS event_id FROM x GROUP BY ALL)
      SELECT y.study_id, y.claim_id, user_id || '|v ' || event_id || '|deep ' || event_id AS snippets, 'check ' || event_id || '|Replicate enhancer validation' AS predictions, '' AS gaps
      FROM y JOIN x USING (study_id, claim_id, event_id)""",
}
