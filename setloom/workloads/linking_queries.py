"""Steps of the linking run on supplied claims, answers and reviews, made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences as say
from ..functions.text import token_set
from ..operators import linking as lk, report as rp
from ..params import LinkSettings
from .roles import table


def _themes(spark, sf):
    """Every part is a theme of the study of its type."""
    return table(spark, sf, "part").select(
        F.col("p_type").alias("study_id"), F.concat(F.lit("t"), "p_partkey").alias("theme_id"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") > 25, "UP").otherwise("DOWN").alias("direction"), F.col("p_partkey").alias("place"),
        (F.col("p_size") / 10 - 2.5).alias("effect"), (F.col("p_size") % 5).cast("int").alias("batch_id"))


def _helpers(spark, sf):
    """Every part is also a helper row named by its brand: names repeat, the last of a direction counts."""
    return table(spark, sf, "part").select(
        F.col("p_type").alias("study_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("H"), "p_brand").alias("helper_name"),
        F.when(F.col("p_size") % 2 == 0, "tf_family").otherwise("celltype").alias("helper_class"),
        F.when(F.col("p_size") % 3 == 0, "UP").otherwise("DOWN").alias("direction"), (F.col("p_size") / 10 - 2.5).alias("nes"),
        (F.col("p_size") / 100).alias("q_value"), F.concat(F.lit("HM"), "p_size").alias("top_hallmark"))


# A number of its own for each order line: order, line, quantity and part.
_LINE = "((l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT)) * 1000000 + l_partkey"


def _items(spark, sf):
    """Every order line is a claim on its part, in the batch of its supplier; some name a helper, a direction, a class."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    q = F.col("l_quantity").cast("int")
    return li.select(
        F.col("p_type").alias("study_id"), F.col("l_suppkey").cast("int").alias("batch_id"), F.expr(_LINE).alias("item_ord"),
        F.concat(F.lit("t"), "l_partkey").alias("theme_id"),
        F.when(q % 4 == 0, F.lit(None)).when(q % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("HBrand#"), q % 28)).alias("helper_name"),
        F.when(q % 3 == 0, "lineage").otherwise("").alias("helper_class"),
        F.when(q % 5 == 0, "up").when(q % 5 == 1, "DOWN").when(q % 5 == 2, "").alias("direction"),
        F.array(F.lit(" a "), F.lit(" "), F.col("l_returnflag")).alias("function_phrases"),
        F.when(q > 20, "because").alias("rationale"), F.when(q > 30, "HIGH").when(q > 10, "").alias("confidence"), F.lit("own").alias("helper_top_hallmark"))


def validated_claims(spark, sf):
    """Supplied claims against themes and helpers, the first three of each batch."""
    v = lk.validate_claims(_items(spark, sf), _themes(spark, sf), _helpers(spark, sf), 3)
    return v.withColumn("function_phrases", F.array_join("function_phrases", "|")).drop("batch_id")


def _loose_items(spark, sf):
    """Claims without a theme: words of a part name stand for the helper; every ninth has its theme already."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_type").alias("study_id"), ((F.col("p_size") + 1) % 5).cast("int").alias("batch_id"), F.col("p_partkey").alias("item_ord"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit("given")).alias("theme_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("helper_name"),
        F.lit("tf_family").alias("helper_class"), F.concat("p_brand", F.lit(" large")).alias("helper_top_hallmark"))


def assigned_themes(spark, sf):
    """Each loose claim with the theme of its batch that shares most words; the first on ties or without any."""
    t = _themes(spark, sf).withColumn("theme_tokens", token_set(F.col("label")))
    return lk.assign_themes(_loose_items(spark, sf), t).select("study_id", "batch_id", "item_ord", "theme_id")


def _claims(spark, sf):
    o = table(spark, sf, "orders")
    n = (F.col("o_orderkey") % 4).cast("int")
    return o.select(
        F.col("o_orderstatus").alias("study_id"), F.concat(F.lit("c"), F.col("o_orderkey")).alias("claim_id"), F.concat(F.lit("t"), F.col("o_custkey")).alias("theme_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("helper_name"),
        F.when(F.col("o_orderkey") % 10 == 0, "a Conflict").when(F.col("o_orderkey") % 10 == 1, "open").alias("gaps"), F.lit("other").alias("alternative"),
        F.slice(F.array(F.lit("x"), F.lit(" "), F.lit("y")), F.lit(1), n).alias("evidence_snippets"), F.array(F.lit("p")).alias("predictions"))


def _reviews(spark, sf):
    """Reviews of every third order by its id, of others by theme and helper; the last of several counts."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    by_id = k % 3 == 0
    rows = o.where(k % 2 == 0).select(
        F.col("o_orderstatus").alias("study_id"), k.alias("review_ord"), F.when(by_id, F.concat(F.lit("c"), F.col("o_orderkey"))).alias("claim_id"),
        F.concat(F.lit("t"), F.col("o_custkey")).alias("theme_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("helper_name"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "Supported").otherwise("Refuted").alias("verdict"), F.when(k % 7 != 0, F.concat(F.lit("r"), F.col("o_orderkey"))).alias("verdict_reason"),
        F.when(k % 4 == 0, "").otherwise("new").alias("alternative"), F.lit("").alias("gaps"),
        F.when(k % 8 == 0, F.array(F.lit(" z "))).otherwise(F.array().cast("array<string>")).alias("predictions"))
    return rows


def reviewed_claims(spark, sf):
    """Verdicts from reviews by claim id, else by theme and helper, else from the evidence."""
    r = lk.review_claims(_claims(spark, sf), _reviews(spark, sf))
    return r.select("study_id", "claim_id", "verdict", "verdict_reason", "alternative", "gaps", F.array_join("predictions", "|").alias("predictions"))


def thesis_themes(spark, sf):
    """Themes of the closing summary: helper themes first, then the strongest others, then claimed ones."""
    t = _themes(spark, sf).drop("batch_id")
    c = table(spark, sf, "lineitem").join(t.select("study_id", "theme_id"), F.concat(F.lit("t"), "l_partkey") == F.col("theme_id"))
    c = c.where("l_quantity > 45").select("study_id", "theme_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_ord"),
                                          F.when(F.col("l_discount") > 0.08, F.lit("H")).alias("helper_name"))
    return lk.thesis_themes(t, c, LinkSettings(thesis_theme_cap=12)).select("study_id", "direction", "theme_id", "thesis_place")


def _verdicts(spark, sf):
    """One verdict per part and order line: the theme is supported where a supported line exists."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return li.select(
        F.col("p_type").alias("study_id"), F.expr(_LINE).alias("claim_ord"), F.concat(F.lit("t"), "l_partkey").alias("theme_id"),
        F.concat(F.lit("HBrand#"), F.col("l_suppkey") % 28).alias("helper_name"),
        F.when(F.col("l_quantity") > 49, "Supported").when(F.col("l_quantity") > 40, "Partial").when(F.col("l_quantity") > 30, "").alias("verdict"))


def theme_links(spark, sf):
    """Edges between supported themes and their helpers with line widths, by verdict, q or confidence."""
    c = _items(spark, sf).withColumn("helper_name", F.concat(F.lit("HBrand#"), F.col("batch_id") % 28)).where("item_ord % 3 = 0").withColumn(
        "confidence", F.lower("confidence"))
    return rp.theme_helper_links(_themes(spark, sf), c.drop("batch_id"), _helpers(spark, sf), _verdicts(spark, sf)).withColumn("width", F.round("width", 6))


def theme_magnitudes(spark, sf):
    t = _themes(spark, sf).withColumn("q_value", F.col("place") / 1000)
    return rp.theme_magnitudes(t, _verdicts(spark, sf))


def nes_consistency(spark, sf):
    """Theme effects beside the mean effect of their helper claims."""
    c = lk.validate_claims(_items(spark, sf), _themes(spark, sf), _helpers(spark, sf), 0)
    r = rp.nes_consistency(lk.helper_means(_themes(spark, sf), c))
    return r.withColumn("helper", F.round("helper", 6)).withColumn("gsea", F.round("gsea", 6))


QUERIES = {"theme_links": theme_links, "theme_magnitudes": theme_magnitudes, "nes_consistency": nes_consistency, "validated_claims": validated_claims, "assigned_themes": assigned_themes, "reviewed_claims": reviewed_claims,
           "thesis_themes": thesis_themes}

_Q = "CAST(l_quantity AS INTEGER)"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 3))"

_VERDICTS = f"""v AS (SELECT p_type AS study_id, {_LINE} AS ord, 't' || l_partkey AS theme_id, 'HBrand#' || (l_suppkey % 28) AS hn,
    CASE WHEN l_quantity > 49 THEN 'Supported' WHEN l_quantity > 40 THEN 'Partial' WHEN l_quantity > 30 THEN '' END AS verdict FROM lineitem JOIN part ON l_partkey = p_partkey),
  ok AS (SELECT DISTINCT study_id, theme_id FROM v WHERE verdict = 'Supported'),
  t AS (SELECT p_type AS study_id, 't' || p_partkey AS theme_id, p_name AS label, CASE WHEN p_size > 25 THEN 'UP' ELSE 'DOWN' END AS direction, p_partkey, p_size / 10 - 2.5 AS effect FROM part)"""

ORACLES = {
    # The last verdict of a pair counts, missing ones left out; then q, then the confidence.
    "theme_links": f"""WITH {_VERDICTS}, lv AS (SELECT study_id, theme_id, hn, arg_max(verdict, ord) AS v FROM (SELECT *, max(ord) OVER (PARTITION BY study_id, theme_id, hn) AS last FROM v) WHERE ord = last GROUP BY ALL),
      hq AS (SELECT p_type AS study_id, 'H' || p_brand AS hn, arg_max(p_size / 100, p_partkey) AS q FROM part GROUP BY ALL),
      c AS (SELECT p_type AS study_id, 't' || l_partkey AS theme_id, 'HBrand#' || (l_suppkey % 28) AS hn, CASE WHEN {_Q} % 3 = 0 THEN 'lineage' ELSE '' END AS helper_class,
        CASE {_Q} % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'DOWN' WHEN 2 THEN '' END AS d, CASE WHEN {_Q} > 30 THEN 'high' WHEN {_Q} > 10 THEN '' END AS conf
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE ({_LINE}) % 3 = 0)
      SELECT c.study_id, c.theme_id, label, d AS direction, c.hn AS helper_name, helper_class, round(CASE WHEN coalesce(v, '') <> '' THEN CASE v WHEN 'Supported' THEN 4.0 ELSE 2.6 END
        WHEN q IS NOT NULL THEN least(4.0, greatest(1.2, -log10(greatest(q, 1e-6)))) ELSE CASE coalesce(conf, 'medium') WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 ELSE 1.5 END END, 6)::DOUBLE AS width
      FROM c JOIN ok USING (study_id, theme_id) JOIN t USING (study_id, theme_id) LEFT JOIN lv USING (study_id, theme_id, hn) LEFT JOIN hq ON hq.study_id = c.study_id AND hq.hn = c.hn""",
    "theme_magnitudes": f"WITH {_VERDICTS} SELECT study_id, theme_id, label, direction, effect, p_partkey / 1000 AS q_value FROM t JOIN ok USING (study_id, theme_id)",
    "nes_consistency": f"""WITH h AS (SELECT p_type AS study_id, 'H' || p_brand AS hn, CASE WHEN p_size % 3 = 0 THEN 'UP' ELSE 'DOWN' END AS hd, arg_max(p_size / 10 - 2.5, p_partkey) AS nes FROM part GROUP BY ALL),
      i AS (SELECT p_type AS study_id, 't' || l_partkey AS theme_id, CASE WHEN p_size > 25 THEN 'UP' ELSE 'DOWN' END AS dir,
          CASE WHEN {_Q} % 4 > 1 THEN 'HBrand#' || ({_Q} % 28) END AS hn, CASE {_Q} % 5 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE '' END AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
      j AS (SELECT i.*, coalesce(x.nes, u.nes, w.nes) AS nes FROM i LEFT JOIN h x ON x.study_id = i.study_id AND x.hn = i.hn AND x.hd = dir
        LEFT JOIN h u ON u.study_id = i.study_id AND u.hn = i.hn AND u.hd = 'UP' LEFT JOIN h w ON w.study_id = i.study_id AND w.hn = i.hn AND w.hd = 'DOWN' WHERE d = '' OR d = dir),
      m AS (SELECT study_id, theme_id, avg(nes) AS helper FROM j WHERE hn IS NOT NULL AND nes IS NOT NULL GROUP BY ALL)
      SELECT p_type AS study_id, theme_id, p_name AS label, CASE WHEN p_size > 25 THEN 'UP' ELSE 'DOWN' END AS direction, round(p_size / 10 - 2.5, 6) AS gsea, round(helper, 6) AS helper
      FROM part JOIN m ON m.study_id = p_type AND theme_id = 't' || p_partkey""",
    "validated_claims": f"""WITH h AS (SELECT p_type AS study_id, 'H' || p_brand AS hn, CASE WHEN p_size % 3 = 0 THEN 'UP' ELSE 'DOWN' END AS hd,
        arg_max((CASE WHEN p_size % 2 = 0 THEN 'tf_family' ELSE 'celltype' END, 'HM' || p_size, p_size / 10 - 2.5, p_size / 100), p_partkey) AS ref FROM part GROUP BY ALL),
      i AS (SELECT p_type AS study_id, l_suppkey AS b, {_LINE} AS item_ord, 't' || l_partkey AS theme_id, p_name AS theme_label,
          CASE WHEN p_size > 25 THEN 'UP' ELSE 'DOWN' END AS dir, CASE {_Q} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'HBrand#' || ({_Q} % 28) END AS hn,
          CASE WHEN {_Q} % 3 = 0 THEN 'lineage' END AS cls, CASE {_Q} % 5 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE '' END AS d, l_returnflag AS fl, {_Q} AS q
        FROM lineitem JOIN part ON l_partkey = p_partkey),
      k AS (SELECT *, row_number() OVER (PARTITION BY study_id, b ORDER BY item_ord) AS r FROM i WHERE d = '' OR d = dir),
      j AS (SELECT k.*, coalesce(x.ref, u.ref, w.ref) AS ref FROM k
        LEFT JOIN h x ON x.study_id = k.study_id AND x.hn = k.hn AND x.hd = k.dir LEFT JOIN h u ON u.study_id = k.study_id AND u.hn = k.hn AND u.hd = 'UP'
        LEFT JOIN h w ON w.study_id = k.study_id AND w.hn = k.hn AND w.hd = 'DOWN' WHERE r <= 3)
      SELECT study_id, item_ord, theme_id, theme_label, hn AS helper_name, coalesce(cls, ref[1], 'theme_only') AS helper_class, dir AS direction, 'a|' || fl AS function_phrases,
        CASE WHEN q > 20 THEN 'because' ELSE '' END AS rationale, CASE WHEN q > 30 THEN 'high' ELSE 'medium' END AS confidence,
        CASE WHEN ref IS NULL THEN 'own' ELSE ref[2] END AS helper_top_hallmark, ref[3] AS helper_effect, ref[4] AS helper_q_value FROM j""",
    "assigned_themes": f"""WITH t AS (SELECT p_type AS study_id, p_size % 5 AS b, p_partkey AS place, 't' || p_partkey AS theme_id, unnest({_WORDS.format("p_name")}) AS w FROM part),
      i AS (SELECT p_type AS study_id, (p_size + 1) % 5 AS b, p_partkey AS item_ord, CASE WHEN p_partkey % 9 = 0 THEN 'given' END AS theme_id,
        {_WORDS.format("coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_name END, '') || ' tf_family ' || p_brand || ' large'")} AS ws FROM part),
      m AS (SELECT study_id, b, item_ord, unnest(ws) AS w FROM i WHERE theme_id IS NULL),
      n AS (SELECT m.study_id, m.b, item_ord, t.theme_id, count(*) AS n, min(place) AS p FROM m JOIN t ON t.study_id = m.study_id AND t.b = m.b AND t.w = m.w GROUP BY ALL),
      best AS (SELECT study_id, b, item_ord, arg_max(theme_id, (n, -p)) AS best FROM n GROUP BY ALL),
      fst AS (SELECT p_type AS study_id, p_size % 5 AS b, arg_min('t' || p_partkey, p_partkey) AS fst FROM part GROUP BY ALL)
      SELECT i.study_id, CAST(i.b AS INTEGER) AS batch_id, i.item_ord, coalesce(theme_id, best, fst) AS theme_id FROM i LEFT JOIN best USING (study_id, b, item_ord) LEFT JOIN fst USING (study_id, b)""",
    "reviewed_claims": f"""WITH c AS (SELECT o_orderstatus AS study_id, 'c' || o_orderkey AS claim_id, 't' || o_custkey AS theme_id, o_orderkey AS k,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS hn, CASE o_orderkey % 10 WHEN 0 THEN 'a Conflict' WHEN 1 THEN 'open' END AS gaps, [0, 1, 1, 2][o_orderkey % 4 + 1] AS n FROM orders),
      r AS (SELECT *, k % 3 = 0 AS by_id, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Supported' ELSE 'Refuted' END AS v, CASE WHEN k % 7 <> 0 THEN 'r' || k END AS vr,
        CASE WHEN k % 4 <> 0 THEN 'new' END AS alt, CASE WHEN k % 8 = 0 THEN 'z' END AS pr FROM c WHERE k % 2 = 0),
      r2 AS (SELECT study_id, theme_id, hn, max(k) AS k FROM r WHERE NOT by_id GROUP BY ALL),
      j AS (SELECT c.*, coalesce(a.v, b.v) AS v0, a.k AS ak, a.v AS av, a.vr AS avr, a.alt AS aalt, a.pr AS apr, b.v AS bv, b.vr AS bvr, b.alt AS balt, b.pr AS bpr
        FROM c LEFT JOIN r a ON a.by_id AND a.study_id = c.study_id AND a.claim_id = c.claim_id
        LEFT JOIN r2 ON r2.study_id = c.study_id AND r2.theme_id = c.theme_id AND r2.hn IS NOT DISTINCT FROM c.hn LEFT JOIN r b ON b.k = r2.k),
      f AS (SELECT *, CASE WHEN ak IS NULL THEN bv ELSE av END AS v, CASE WHEN ak IS NULL THEN bvr ELSE avr END AS vr, CASE WHEN ak IS NULL THEN balt ELSE aalt END AS alt, CASE WHEN ak IS NULL THEN bpr ELSE apr END AS pr,
        coalesce(gaps, '') = 'a Conflict' AS conflict FROM j)
      SELECT study_id, claim_id, coalesce(v, CASE WHEN conflict THEN 'Hypothesis' WHEN n >= 2 THEN 'Supported' WHEN n = 1 THEN 'Partial' ELSE 'Hypothesis' END) AS verdict,
        CASE WHEN v IS NOT NULL THEN coalesce(vr, '{say.NO_CRITIC}') WHEN conflict THEN gaps WHEN n >= 2 THEN '{say.TWO_SNIPPETS}' WHEN n = 1 THEN '{say.ONE_SNIPPET}' ELSE '{say.NO_SNIPPET}' END AS verdict_reason,
        coalesce(alt, 'other') AS alternative, gaps, coalesce(pr, 'p') AS predictions FROM f""",
    "thesis_themes": """WITH t AS (SELECT p_type AS study_id, 't' || p_partkey AS theme_id, CASE WHEN p_size > 25 THEN 'UP' ELSE 'DOWN' END AS direction, p_partkey AS place, p_size / 10 - 2.5 AS effect FROM part),
      c AS (SELECT 't' || l_partkey AS theme_id, max((l_discount > 0.08)::INT) = 1 AS helped, min(l_orderkey * 10 + l_linenumber) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY ALL),
      j AS (SELECT t.*, coalesce(helped, false) AS helped, c FROM t LEFT JOIN c USING (theme_id)),
      n AS (SELECT *, row_number() OVER (PARTITION BY study_id, direction, helped ORDER BY place) AS nth, row_number() OVER (PARTITION BY study_id, direction, helped ORDER BY abs(effect) DESC, place) AS loud,
        least(count(*) FILTER (helped) OVER (PARTITION BY study_id, direction), 3) AS nb FROM j),
      b AS (SELECT *, helped AND nth <= 3 AS in_block, NOT helped AND loud <= 12 - nb AS in_loud FROM n),
      o AS (SELECT *, CASE WHEN in_block THEN 0 WHEN in_loud THEN 1 ELSE 2 END AS bl, CASE WHEN in_block THEN nth WHEN in_loud THEN loud ELSE c END AS od FROM b WHERE in_block OR in_loud OR c IS NOT NULL),
      p AS (SELECT *, CAST(row_number() OVER (PARTITION BY study_id, direction ORDER BY bl, od) AS INTEGER) AS thesis_place FROM o)
      SELECT study_id, direction, theme_id, thesis_place FROM p WHERE thesis_place <= 12""",
}
