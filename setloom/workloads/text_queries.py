"""Theming, tokens and rule audit over names and whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, themes as th
from ..operators.linking import claim_signature
from ..operators.prefilter import normalise_gsea, normalise_helpers, rank_helpers, split_directions
from ..params import LinkSettings
from ..sources.rules import parse_rules
from .roles import RESULTS_SQL, results, rounded, table

# A small rule book over the vocabulary of the test tables.
RULES = parse_rules({
    "defaults": {"priority": 50, "targets": ["spaced", "underscored", "raw"], "negative_targets": ["spaced"],
                 "weights": {"canonical": 3.0, "positive": 1.0}},
    "themes": [
        {"id": "metal", "name": "Metal parts", "priority": 90, "seed_sets": ["SMALL_RING", "BRASS_RING"],
         "patterns": {"canonical": [{"pattern": r"\bSMALL_RING\b", "targets": ["underscored"]}],
                      "positive": [r"\bRING\b", r"\bBOLT\b", r"\bPLATE\b"], "negative": ["HOT"]}},
        {"id": "colour", "name": "Coloured goods", "priority": 70,
         "contributions": {"primary": 1.0, "secondary": [{"theme": "Metal parts", "weight": 0.5}]},
         "patterns": {"positive": [r"\bRED\b", r"\bBLUE\b", {"pattern": r"\bGREEN\b", "weight": 2.0}]}},
        {"id": "machine", "name": "Machines", "patterns": {"canonical": [r"\bGEAR\b"], "positive": [r"\bWIDGET\b", r"\bGIZMO\b", r"LARGE[_ ]?GEAR"]}},
    ],
})
TEXT_RULES = parse_rules({
    "defaults": {"targets": ["spaced"]},
    "themes": [
        {"id": "english", "name": "English", "patterns": {"canonical": [r"\bTHE\b"], "positive": [r"\bOF\b", r"\bAND\b", r"\bWAS\b"], "negative": [r"\bDER\b"]}},
        {"id": "german", "name": "German", "patterns": {"canonical": [r"\bDER\b"], "positive": [r"\bDIE\b", r"\bUND\b", r"\bNICHT\b"]}},
        {"id": "french", "name": "French", "patterns": {"canonical": [r"\bLES\b"], "positive": [r"\bUNE\b", r"\bDANS\b", r"\bQUE\b"]}},
    ],
})


def _parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("rec_ord"), F.col("p_name").alias("term"), F.lit(None).cast("string").alias("source"),
        F.col("p_brand").alias("study_id"), F.when(F.col("p_size") > 25, "UP").otherwise("DOWN").alias("direction"),
        (F.col("p_size") / 10).alias("score"))


def theme_match(spark, sf):
    return rounded(th.match_themes(_parts(spark, sf), RULES, "term", "source", keep=["rec_ord"]).select("rec_ord", "theme", "weight"), "weight")


def theme_rank(spark, sf):
    m = th.match_themes(_parts(spark, sf), RULES, "term", "source")
    return rounded(th.rank_themes(m, RULES).select("study_id", "direction", "theme", "n_terms", "ranking_score"), "ranking_score")


def theme_documents(spark, sf):
    """Whole document texts against a language rule book."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("term"))
    return th.match_themes(d, TEXT_RULES, "term", keep=["doc_id"]).select("doc_id", "theme", "weight")


def theme_conversations(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("term"))
    m = th.match_themes(d, TEXT_RULES, "term", keep=["conv_id", "turn"])
    return m.groupBy("conv_id", "theme").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("turns"))


def _records(spark, sf):
    """Suppliers as result rows; their term is the name of the part with their number."""
    r = results(spark, sf)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("term"), F.col("p_type").alias("source"))
    return r.join(names, "ord").select(
        "study_id", F.col("ord").alias("rec_ord"), "term", "source", "nes", "q_value", "size", "leading_edge")


def direction_split(spark, sf):
    s = split_directions(_records(spark, sf), LinkSettings(gsea_q_threshold=0.3, gsea_min_per_direction=40))
    return s.select("study_id", "direction", F.col("rec_ord.ord").alias("rec_ord"), "term", "nes", "score")


def theme_summary(spark, sf):
    s = split_directions(_records(spark, sf), LinkSettings(gsea_q_threshold=0.9))
    t = th.build_themes(s, RULES, LinkSettings())
    return t.select("study_id", "direction", "theme_id", "label", "collection", F.round("effect", 6).alias("effect"), "q_value",
                    F.array_join("leading_edges", ",").alias("leading_edges"), F.size("top_pathways").alias("n_top"))


def theme_tokens(spark, sf):
    m = audit.matched_terms(_parts(spark, sf).select("term", "source").distinct(), RULES)
    return audit.count_tokens(m)


def theme_bigrams(spark, sf):
    m = audit.matched_terms(_parts(spark, sf).select("term", "source").distinct(), RULES)
    return audit.count_tokens(m, "bigram")


def synonym_suggestions(spark, sf):
    m = audit.matched_terms(_parts(spark, sf).select("term", "source").distinct(), RULES)
    return audit.suggest_synonyms(m, RULES).select("theme", "item", "n", "place")


def library_breakdown(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("source"))
    return audit.library_counts(audit.matched_terms(p, RULES))


def missing_seeds(spark, sf):
    return audit.unmatched_seeds(audit.matched_terms(
        _parts(spark, sf).select(F.upper(F.translate("term", " ", "_")).alias("term"), "source").distinct(), RULES), RULES)


def document_tokens(spark, sf):
    """Lower-case words of whole texts without stop words, counted per language."""
    d = table(spark, sf, "documents").select("lang", F.explode(tx.words(F.col("text"))).alias("token"))
    return d.where(~F.col("token").isin(tx.STOPWORDS)).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


def text_bigrams(spark, sf):
    tokens = tx.upper_tokens(F.regexp_replace(F.col("text"), r"[^A-Za-z0-9]", " "))
    return table(spark, sf, "benchmark").select(F.explode(tx.bigrams(tokens)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def term_variants(spark, sf):
    v = tx.text_variants(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("/αβ-θ__"), F.col("o_orderstatus")))
    return table(spark, sf, "orders").select("o_orderkey", *[v[k].alias(k) for k in ("raw", "spaced", "underscored", "compact")])


def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


def helper_families(spark, sf):
    """Families, classes and phrases of made names around the brand and segment columns."""
    c = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("FOX", "Gata-", "sp1", "jun_", "BACH", "my", "aSMAD", "hox::", "ZZ")]),
                                          (F.col("c_nationkey") % 9 + 1).cast("int")), F.col("c_nationkey").cast("string")).alias("name"),
        F.col("c_mktsegment").alias("seg"))
    return c.select("c_custkey", tx.tf_family(F.col("name")).alias("family"),
                    tx.hallmark_phrase(F.concat(F.lit("HALLMARK_"), F.upper("seg"), F.lit("_B"))).alias("phrase"),
                    claim_signature(F.col("seg"), F.lit("celltype"), F.lit(None).cast("string"), F.col("name")).alias("signature"))


def split_lists(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.split_list(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").alias("n"))


def normal_labels(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", tx.normal_label(F.concat(F.lit("  "), "c_mktsegment", F.lit(" —  "), "c_name", F.lit(" "))).alias("label"))


def gsea_normalise(spark, sf):
    raw = results(spark, sf).select(
        "study_id", F.col("ord").alias("rec_ord"), F.concat(F.lit(" "), "set_name").alias("Compare.List"),
        F.when(F.col("size") > 190, F.col("nes").cast("string")).otherwise("NA").alias("NES"), F.col("q_value").cast("string").alias("qValue"),
        F.concat("size", F.lit(".0")).alias("SIZE"), F.array_join("leading_edge", " , ").alias("leadingEdge"))
    n = normalise_gsea(raw)
    return n.select("study_id", "rec_ord", "term", "nes", "q_value", "size", F.array_join("leading_edge", ";").alias("leading_edge"))


def helper_rank(spark, sf):
    raw = results(spark, sf).select(
        "study_id", "ord", F.col("set_name").alias("Helper"), F.when(F.col("nes") > 1, "TFBS").otherwise("lineage").alias("Class"),
        F.col("nes").cast("string").alias("score"), F.col("q_value").cast("string").alias("qvalue"))
    h = rank_helpers(normalise_helpers(raw), LinkSettings(helper_max_per_direction=20))
    return h.select("study_id", "direction", "ord", "helper_name", "helper_class", "nes", "q_value", "q_from_signed")


QUERIES = {
    "theme_match": theme_match, "theme_rank": theme_rank, "theme_documents": theme_documents,
    "theme_conversations": theme_conversations, "direction_split": direction_split, "theme_summary": theme_summary,
    "theme_audit_tokens": theme_tokens, "theme_audit_bigrams": theme_bigrams, "synonym_suggestions": synonym_suggestions,
    "library_breakdown": library_breakdown, "missing_seeds": missing_seeds, "document_tokens": document_tokens,
    "text_bigrams": text_bigrams, "term_variants": term_variants, "slugs": slugs, "helper_families": helper_families,
    "split_lists": split_lists, "normal_labels": normal_labels, "gsea_normalise": gsea_normalise, "helper_rank": helper_rank,
}


def _w(src, cols):
    """Weights of the part rule book on upper-case names."""
    u = "upper(term)"
    s = lambda pats: " + ".join(f"(CASE WHEN regexp_matches({u}, '{p}') THEN {w} ELSE 0 END)" for p, w in pats)
    core1, more1 = "(CASE WHEN regexp_matches(replace(upper(term), ' ', '_'), '\\bSMALL_RING\\b') THEN 3.0 ELSE 0 END)", s([(r"\bRING\b", 1.0), (r"\bBOLT\b", 1.0), (r"\bPLATE\b", 1.0)])
    col = s([(r"\bRED\b", 1.0), (r"\bBLUE\b", 1.0), (r"\bGREEN\b", 2.0)])
    core3, more3 = s([(r"\bGEAR\b", 3.0)]), s([(r"\bWIDGET\b", 1.0), (r"\bGIZMO\b", 1.0), (r"LARGE[_ ]?GEAR", 1.0)])
    add = lambda c, m: f"({c} + {m} + CASE WHEN ({c}) > 0 AND ({m}) = 0 THEN 0.25 * ({c}) ELSE 0 END)"
    return f"""m0 AS (SELECT {cols}, 'Metal parts' AS theme, CASE WHEN regexp_matches({u}, 'HOT') THEN 0 ELSE {add(core1, more1)} END AS w FROM {src}
      UNION ALL SELECT {cols}, 'Coloured goods', {col} FROM {src} UNION ALL SELECT {cols}, 'Metal parts', 0.5 * ({col}) FROM {src}
      UNION ALL SELECT {cols}, 'Machines', {add(core3, more3)} FROM {src}),
    mt AS (SELECT {cols}, theme, sum(w) AS weight FROM m0 WHERE w > 0 GROUP BY ALL)"""


_PARTS = """px AS (SELECT p_partkey AS rec_ord, p_name AS term, p_type AS source, p_brand AS study_id,
  CASE WHEN p_size > 25 THEN 'UP' ELSE 'DOWN' END AS direction, p_size / 10 AS score FROM part)"""


def _lang(src, keys):
    sp = "' ' || trim(regexp_replace(regexp_replace(upper(term), '[-–—/_]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"
    rules = [("English", "THE", ["OF", "AND", "WAS"], "DER"), ("German", "DER", ["DIE", "UND", "NICHT"], None), ("French", "LES", ["UNE", "DANS", "QUE"], None)]
    hit = lambda word: f"regexp_matches(sp, '(?:^|[^\\p{{L}}\\p{{N}}_]){word}(?:[^\\p{{L}}\\p{{N}}_]|$)')"
    parts = []
    for name, core, more, neg in rules:
        c = f"(CASE WHEN {hit(core)} THEN 3.0 ELSE 0 END)"
        m = "(" + " + ".join(f"(CASE WHEN {hit(x)} THEN 1.0 ELSE 0 END)" for x in more) + ")"
        w = f"({c} + {m} + CASE WHEN {c} > 0 AND {m} = 0 THEN 0.75 ELSE 0 END)"
        if neg:
            w = f"(CASE WHEN {hit(neg)} THEN 0 ELSE {w} END)"
        parts.append(f"SELECT {keys}, '{name}' AS theme, CAST({w} AS DOUBLE) AS weight FROM sp")
    return f"sp AS (SELECT {keys}, {sp} AS sp FROM {src}), lang AS ({' UNION ALL '.join(parts)})"


_DT = """dt AS (SELECT DISTINCT term FROM px), tok AS (SELECT DISTINCT theme, term FROM mt),
  t AS (SELECT theme, term, unnest(string_split(upper(term), ' ')) AS item FROM tok)"""

def _placed_weights():
    """Weights of the part rule book on the records ``rc``, with the place of each contribution in the book."""
    u = "upper(term)"
    s = lambda pats: " + ".join(f"(CASE WHEN regexp_matches({u}, '{p}') THEN {w} ELSE 0 END)" for p, w in pats)
    core1, more1 = "(CASE WHEN regexp_matches(replace(upper(term), ' ', '_'), '\\bSMALL_RING\\b') THEN 3.0 ELSE 0 END)", s([(r"\bRING\b", 1.0), (r"\bBOLT\b", 1.0), (r"\bPLATE\b", 1.0)])
    col = s([(r"\bRED\b", 1.0), (r"\bBLUE\b", 1.0), (r"\bGREEN\b", 2.0)])
    core3, more3 = s([(r"\bGEAR\b", 3.0)]), s([(r"\bWIDGET\b", 1.0), (r"\bGIZMO\b", 1.0), (r"LARGE[_ ]?GEAR", 1.0)])
    add = lambda c, m: f"({c} + {m} + CASE WHEN ({c}) > 0 AND ({m}) = 0 THEN 0.25 * ({c}) ELSE 0 END)"
    return f"""m0 AS (SELECT ro, study_id, direction, score, 'Metal parts' AS theme, 0 AS place, CASE WHEN regexp_matches({u}, 'HOT') THEN 0 ELSE {add(core1, more1)} END AS w FROM rc
      UNION ALL SELECT ro, study_id, direction, score, 'Coloured goods', 100, {col} FROM rc UNION ALL SELECT ro, study_id, direction, score, 'Metal parts', 101, 0.5 * ({col}) FROM rc
      UNION ALL SELECT ro, study_id, direction, score, 'Machines', 200, {add(core3, more3)} FROM rc),
    mt AS (SELECT study_id, direction, ro, score, theme, sum(w)::DOUBLE AS weight, min(place) AS place FROM m0 WHERE w > 0 GROUP BY ALL)"""


_D = LinkSettings()
# Records in reading order, themes by rank, loose terms on free places or in the last theme, then the summary of each theme.
_SUMMARY = f"""WITH {RESULTS_SQL}, r AS (SELECT study_id, CASE WHEN nes > 0 THEN 'UP' ELSE 'DOWN' END AS direction, ord, set_name, p_name AS term, p_type AS source,
      nes, abs(nes) AS score, q_value, q_value <= 0.9 AS ok FROM res JOIN part ON p_partkey = ord WHERE nes <> 0),
  k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY study_id, direction) AS have,
    row_number() OVER (PARTITION BY study_id, direction, ok ORDER BY q_value, score DESC, ord) AS rn FROM r),
  rc AS (SELECT *, row_number() OVER (PARTITION BY study_id, direction ORDER BY score DESC, CASE WHEN ok THEN 0 ELSE rn END, ord) AS ro
    FROM k WHERE ok OR rn <= {_D.gsea_min_per_direction} - have),
  {_placed_weights()},
  rk AS (SELECT study_id, direction, theme, min((ro, place)) AS first, round(sum(score * weight) / greatest(sum(weight), 1e-6)
    * (1 + any_value(CASE theme WHEN 'Metal parts' THEN 90 WHEN 'Coloured goods' THEN 70 ELSE 50 END) / 100.0), 12) AS rank_score FROM mt GROUP BY ALL),
  kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id, direction ORDER BY rank_score DESC, first) AS pos FROM rk) WHERE pos <= {_D.theme_cap}),
  nk AS (SELECT study_id, direction, count(*) AS n FROM kp GROUP BY ALL),
  lo AS (SELECT rc.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY rc.study_id, rc.direction ORDER BY ro) AS q FROM rc LEFT JOIN nk USING (study_id, direction)
    WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.study_id = rc.study_id AND mt.direction = rc.direction AND mt.ro = rc.ro)),
  p1 AS (SELECT study_id, direction, pos, theme AS label, 0 AS late, ro FROM mt JOIN kp USING (study_id, direction, theme)
    UNION ALL SELECT study_id, direction, n + q, 'Additional ' || direction || ' signal ' || q || ': ' || term, 0, ro FROM lo WHERE q <= {_D.theme_cap} - n),
  la AS (SELECT study_id, direction, max((pos, label)) AS last FROM p1 GROUP BY ALL),
  p2 AS (SELECT * FROM p1 UNION ALL SELECT study_id, direction, last[1], last[2], 1, ro FROM lo JOIN la USING (study_id, direction) WHERE q > {_D.theme_cap} - n),
  tp AS (SELECT * FROM (SELECT p2.*, rc.* EXCLUDE (study_id, direction, ro), row_number() OVER (PARTITION BY study_id, direction, pos, label ORDER BY score DESC, late, ro) AS at_
    FROM p2 JOIN rc USING (study_id, direction, ro)) WHERE at_ <= {_D.theme_top_pathways}),
  ed AS (SELECT study_id, set_name, member, row_number() OVER (PARTITION BY study_id, set_name ORDER BY member) AS g FROM edges),
  vo AS (SELECT study_id, direction, pos, label, member, count(*) AS c, min((at_, g)) AS f FROM tp JOIN ed USING (study_id, set_name) WHERE g <= 20 GROUP BY ALL),
  vr AS (SELECT *, row_number() OVER (PARTITION BY study_id, direction, pos, label ORDER BY c DESC, f, member) AS v FROM vo),
  le AS (SELECT study_id, direction, pos, label, string_agg(member, ',' ORDER BY v) AS genes FROM vr WHERE v <= {_D.max_genes} GROUP BY ALL),
  bo AS (SELECT study_id, direction, pos, label, avg(nes) AS effect, min(q_value) AS q_value, arg_min(source, at_) FILTER (source <> '') AS collection, count(*) AS n FROM tp GROUP BY ALL)"""

ORACLES = {
    "theme_summary": f"""{_SUMMARY} SELECT study_id, direction, lower(direction) || '_' || pos || '_' ||
        coalesce(nullif(lower(trim(regexp_replace(label, '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'theme') AS theme_id,
      label, collection, round(effect, 6) AS effect, q_value, coalesce(genes, '') AS leading_edges, CAST(n AS INTEGER) AS n_top
      FROM bo LEFT JOIN le USING (study_id, direction, pos, label)""",
    "theme_match": f"WITH {_PARTS}, {_w('px', 'rec_ord')} SELECT rec_ord, theme, round(CAST(weight AS DOUBLE), 6) AS weight FROM mt",
    "theme_rank": f"""WITH {_PARTS}, {_w('px', 'rec_ord, study_id, direction, score')} SELECT study_id, direction, theme, count(*) AS n_terms,
      round(round(CAST(sum(score * weight) / sum(weight) * (1 + any_value(CASE theme WHEN 'Metal parts' THEN 90 WHEN 'Coloured goods' THEN 70 ELSE 50 END) / 100.0) AS DOUBLE), 12), 6) AS ranking_score FROM mt GROUP BY ALL""",
    "theme_documents": f"WITH dd AS (SELECT doc_id, text AS term FROM documents), {_lang('dd', 'doc_id')} SELECT * FROM lang WHERE weight > 0",
    "theme_conversations": f"""WITH dd AS (SELECT conv_id, turn, text AS term FROM conversations), {_lang('dd', 'conv_id, turn')}
      SELECT conv_id, theme, sum(weight) AS weight, count(*) AS turns FROM lang WHERE weight > 0 GROUP BY ALL""",
    "direction_split": f"""WITH {RESULTS_SQL}, r AS (SELECT study_id, CASE WHEN nes > 0 THEN 'UP' ELSE 'DOWN' END AS direction, ord AS rec_ord, p_name AS term, nes, abs(nes) AS score, q_value,
        q_value <= 0.3 AS ok FROM res JOIN part ON p_partkey = ord WHERE nes <> 0),
      k AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY study_id, direction) AS have,
        row_number() OVER (PARTITION BY study_id, direction, ok ORDER BY q_value, score DESC, rec_ord) AS rn FROM r)
      SELECT study_id, direction, rec_ord, term, nes, score FROM k WHERE ok OR rn <= 40 - have""",
    "theme_audit_tokens": f"WITH {_PARTS}, {_w('px', 'term')}, {_DT} SELECT theme, item, count(*) AS n FROM t GROUP BY ALL",
    "theme_audit_bigrams": f"WITH {_PARTS}, {_w('px', 'term')}, {_DT} SELECT theme, upper(term) AS item, count(*) AS n FROM tok GROUP BY ALL",
    "synonym_suggestions": f"""WITH {_PARTS}, {_w('px', 'term')}, {_DT}, c AS (SELECT theme, count(*) AS c FROM tok GROUP BY 1),
      k AS (SELECT theme, item, count(*) AS n FROM t GROUP BY ALL),
      f AS (SELECT k.* FROM k JOIN c USING (theme) WHERE n >= greatest(2, ceil(c * 0.12)) AND item NOT IN ({', '.join(repr(x) for x in audit.GENERIC + audit.BARRED)})
        AND NOT (theme = 'Metal parts' AND item = 'RING') AND NOT (theme = 'Machines' AND item IN ('LARGE', 'GEAR')))
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY theme ORDER BY n DESC, item) AS INTEGER) AS place FROM f) WHERE place <= 5""",
    "library_breakdown": f"""WITH px AS (SELECT p_partkey AS id, p_name AS term, p_type AS source FROM part), {_w('px', 'id, source')}
      SELECT theme, source, count(*) AS n FROM mt GROUP BY ALL""",
    "missing_seeds": "SELECT 'Metal parts' AS theme, 'BRASS_RING' AS term WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_name = 'brass ring')",
    "document_tokens": f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
      SELECT lang, token, count(*) AS n FROM w WHERE length(token) >= 3 AND token NOT IN ({', '.join(repr(x) for x in tx.STOPWORDS)}) GROUP BY ALL""",
    "text_bigrams": """WITH x AS (SELECT regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g')), '[A-Z0-9]+') AS t FROM benchmark)
      SELECT item, count(*) AS n FROM (SELECT unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) AS item FROM x) GROUP BY ALL""",
    "term_variants": """WITH x AS (SELECT o_orderkey, o_orderpriority || '/AB-TH__' || o_orderstatus AS raw FROM orders),
      y AS (SELECT *, regexp_replace(raw, '[-/_]+', ' ', 'g') AS spaced FROM x)
      SELECT o_orderkey, raw, spaced, replace(spaced, ' ', '_') AS underscored, replace(spaced, ' ', '') AS compact FROM y""",
    "slugs": """SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'theme') AS slug FROM pages""",
    "helper_families": """WITH x AS (SELECT c_custkey, c_mktsegment AS seg, (['FOX', 'Gata-', 'sp1', 'jun_', 'BACH', 'my', 'aSMAD', 'hox::', 'ZZ'])[c_nationkey % 9 + 1] || c_nationkey AS name FROM customer)
      SELECT c_custkey, CASE WHEN name LIKE 'FOX%' THEN 'FOX-family' WHEN name LIKE 'Gata%' THEN 'GATA-family' WHEN name LIKE 'sp1%' THEN 'SP/KLF-family' WHEN name LIKE 'jun%' THEN 'AP-1-family'
        WHEN name LIKE 'BACH%' THEN 'BTB-bZIP-family' WHEN name LIKE 'aSMAD%' THEN 'SMAD-family' WHEN name LIKE 'hox%' THEN 'HOX-family' END AS family,
        upper(seg[1]) || lower(seg[2:]) || ' B' AS phrase, seg || '|celltype|' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS signature FROM x""",
    "split_lists": """SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS INTEGER) AS n FROM documents""",
    "normal_labels": "SELECT c_custkey, lower(c_mktsegment || ' - ' || c_name) AS label FROM customer",
    "gsea_normalise": f"""WITH {RESULTS_SQL}, e AS (SELECT study_id, set_name, string_agg(member, ';' ORDER BY member) AS le FROM edges GROUP BY ALL)
      SELECT res.study_id, ord AS rec_ord, res.set_name AS term, nes, q_value, CAST(size AS INTEGER) AS size, coalesce(le, '') AS leading_edge
      FROM res LEFT JOIN e USING (study_id, set_name) WHERE size > 190""",
    "helper_rank": f"""WITH {RESULTS_SQL}, h AS (SELECT study_id, CASE WHEN nes > 0 THEN 'UP' ELSE 'DOWN' END AS direction, ord, set_name AS helper_name,
        CASE WHEN nes > 1 THEN 'tf_family' ELSE 'celltype' END AS helper_class, nes, q_value, false AS q_from_signed FROM res WHERE nes <> 0)
      SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY study_id, direction ORDER BY q_value, abs(nes) DESC, ord) AS rn FROM h) WHERE rn <= 20""",
}
