"""Set collections: frequency, specificity, over-representation, similarity, helper selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import hypergeom_tail
from ..operators import bipartite as bp, ora, sets as st, similarity as sim, setjoin
from ..operators.intervals import overlapping_ids
from ..operators.scan import adjust_p
from .roles import (
    BRAND_SETS_SQL, PROPERTY_SETS_SQL, RESULTS_SQL, SUPPLIER_SETS_SQL, brand_sets, intervals, intervals_sql,
    property_sets, results, rounded, supplier_sets, table,
)


def member_frequency(spark, sf):
    return rounded(st.member_frequency(supplier_sets(spark, sf)), "frequency")


def specific_sets(spark, sf):
    return st.retain_specific(supplier_sets(spark, sf), 0.12, 20).select("study_id", "set_name", "member")


def set_sizes(spark, sf):
    return st.set_sizes(supplier_sets(spark, sf))


def clean_sets(spark, sf):
    """Comma-separated phrases of whole texts: padded and empty ones trimmed, dropped and made distinct."""
    d = table(spark, sf, "documents").select(
        F.col("lang").alias("study_id"), F.col("source").alias("set_name"),
        F.explode(F.split("text", ",")).alias("member"))
    return st.clean_sets(d)


def _returned(spark, sf):
    """Query members: parts returned in large quantity, per return flag."""
    return table(spark, sf, "lineitem").where(F.col("l_quantity") >= 45).select(
        F.col("l_returnflag").alias("study_id"), F.col("l_partkey").cast("string").alias("member")).distinct()


def set_intersection(spark, sf):
    return st.intersect_members(brand_sets(spark, sf), _returned(spark, sf)).select("study_id", "set_name", "member")


def set_difference(spark, sf):
    return st.difference(brand_sets(spark, sf), _returned(spark, sf)).select("study_id", "set_name", "member")


def set_universe(spark, sf):
    return st.append_members(st.universe(brand_sets(spark, sf)), _returned(spark, sf))


def ora_interval_counts(spark, sf):
    """Property sets against the intervals open just before any event, counted per set."""
    x = intervals(spark, sf)
    points = x.select("chrom", (F.col("start") - 1).alias("start"), (F.col("start") - 1).alias("end"), "id")
    hit = overlapping_ids(x, points).select(F.lit("E").alias("study_id"), F.col("id").cast("string").alias("member"))
    return ora.ora_counts(st.clean_sets(property_sets(spark, sf)), hit)


def ora_intervals(spark, sf):
    """Interval mapping, universe counts, hypergeometric p and BH in one plan."""
    tested = ora.with_hypergeometric(ora_interval_counts(spark, sf))
    tested = tested.withColumn("p_hyper", F.round("p_hyper", 9))
    return rounded(adjust_p(tested, ["study_id"], "p_hyper", "p_adj"), "p_hyper", "p_adj")


def ora_parts(spark, sf):
    c = ora.with_hypergeometric(ora.ora_counts(st.clean_sets(supplier_sets(spark, sf)), _returned(spark, sf)))
    return rounded(c, "p_hyper")


def ora_empirical(spark, sf):
    return ora.run_ora(brand_sets(spark, sf), _returned(spark, sf), draws=2000)


def ora_empirical_bounds(spark, sf):
    """The complete table, its drawn p values as a check against the exact ones: within six standard errors."""
    p, n = F.col("p_hyper"), 2000
    near = F.abs(F.col("p_empirical") - p) <= 6 * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n) + 2 / n
    return ora_empirical(spark, sf).select(
        "study_id", "set_name", "N", "M", "K", "x", F.round(p, 6).alias("p_hyper"), near.alias("within_bounds"),
        (F.col("p_empirical_adj") >= F.col("p_empirical") * (1 - 1e-12)).alias("adjusted_up"))


def hypergeometric(spark, sf):
    """Tail probabilities on one quadruple per order line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("x0"),
                                            (F.col("l_suppkey") + 1).alias("m0"))
    n = F.lit(5000).cast("long")
    p = hypergeom_tail(n, F.col("m0") * 4, F.lit(300).cast("long"), F.col("x0"))
    return li.select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


def _adjusted(method):
    def run(spark, sf):
        p = F.floor(F.col("o_totalprice")) % 1000 / 1000
        o = table(spark, sf, "orders").select(
            F.col("o_orderstatus").alias("study_id"), "o_orderkey", F.when(p > 0.01, p).alias("p"))
        return rounded(adjust_p(o, ["study_id"], "p", "q", method), "q").select("study_id", "o_orderkey", "p", "q")
    return run


def set_pairs(spark, sf):
    s = supplier_sets(spark, sf)
    return st.pair_counts(s.select("study_id", F.col("set_name").alias("id"), "member"))


def set_cosine(spark, sf):
    s = supplier_sets(spark, sf, distinct=False)
    return rounded(sim.cosine_pairs(s.select("study_id", "set_name", "member")), "similarity")


def _basket_sets(spark, sf):
    """The brands in each order as a set per order priority: many small sets, some of them alike."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("study_id"), F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("member"))
    # Orders come last: their rows then lie as the sets are gathered.
    return lines.join(parts, "p_partkey").join(o, "l_orderkey").select("study_id", F.col("l_orderkey").alias("set_name"), "member")


def similar_baskets(spark, sf):
    """All pairs of orders whose sets of brands and types have a Jaccard similarity of 0.6 or more."""
    return rounded(setjoin.similar_sets(_basket_sets(spark, sf), 0.6), "similarity")


def similar_baskets_cosine(spark, sf):
    return rounded(setjoin.similar_sets(_basket_sets(spark, sf), 0.75, setjoin.COSINE), "similarity")


def similarity_edges(spark, sf):
    return rounded(sim.similarity_network(results(spark, sf), 0.12)[1], "similarity")


def similarity_nodes(spark, sf):
    return rounded(sim.similarity_network(results(spark, sf), 0.12)[0], "size")


def elbow(spark, sf):
    r = results(spark, sf)
    return sim.elbow_cut(r.where(F.col("q_value") < 0.9))


def connectivity(spark, sf):
    return rounded(sim.connectivity(results(spark, sf)), "connectivity")


def helper_select(spark, sf):
    r = sim.select_helpers(results(spark, sf), q_cut=0.9)
    return rounded(r.select("study_id", "set_name", "q_value", "connectivity"), "connectivity")


def _links(spark, sf):
    """Suppliers against brands: overlap tests as the Fisher table, brands scored by size of return."""
    r = results(spark, sf)
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    f = li.join(part, "l_partkey").groupBy(
        F.col("l_returnflag").alias("study_id"),
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("enh_set"),
        F.col("p_brand").alias("gene_set")).agg(
        F.round(F.exp(-F.sum("l_quantity") / 40.0), 12).alias("p_adj"))
    g = li.join(part, "l_partkey").groupBy(F.col("l_returnflag").alias("study_id"), F.col("p_brand").alias("set_name")).agg(
        F.round((F.avg("l_quantity") - 25.5) * 10, 6).alias("nes"))
    g = g.withColumn("ord", F.col("set_name"))
    return bp.link_results(r, g, f)


def bipartite_edges(spark, sf):
    return rounded(_links(spark, sf)["edges"], "weight", "fdr")


def bipartite_nodes(spark, sf):
    return rounded(_links(spark, sf)["nodes"], "size")


def bipartite_sets(spark, sf):
    return _links(spark, sf)["selected_sets"].select("study_id", "set_name", "q_value")


def _top1(spark, sf):
    r = results(spark, sf)
    edges = r.select("study_id", F.col("set_name").alias("helper"), F.explode("leading_edge").alias("member"))
    assoc = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("GHid"), F.col("l_suppkey").cast("string").alias("symbol")).distinct()
    groups = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("long").alias("set_ord"), F.concat(F.lit("N"), "s_nationkey").alias("set_name"),
        F.col("s_suppkey").cast("string").alias("member"))
    helpers = r.select("study_id", F.col("set_name").alias("helper"))
    return ora.annotate_top1(helpers, edges, assoc, groups, min_size=2, max_size=500, alpha=0.9)


def fisher_top1(spark, sf):
    return rounded(_top1(spark, sf), "top_q")


QUERIES = {
    "member_frequency": member_frequency, "specific_sets": specific_sets, "set_sizes": set_sizes,
    "clean_sets": clean_sets, "set_intersection": set_intersection, "set_difference": set_difference,
    "set_universe": set_universe, "ora_interval_counts": ora_interval_counts, "ora_intervals": ora_intervals,
    "ora_parts": ora_parts, "ora_empirical": ora_empirical, "ora_empirical_bounds": ora_empirical_bounds, "hypergeometric": hypergeometric,
    "bh_adjust": _adjusted("BH"), "by_adjust": _adjusted("BY"), "holm_adjust": _adjusted("holm"),
    "hochberg_adjust": _adjusted("hochberg"), "bonferroni_adjust": _adjusted("bonferroni"),
    "hommel_adjust": _adjusted("hommel"), "unadjusted": _adjusted("none"),
    "set_pairs": set_pairs, "set_cosine": set_cosine, "similarity_edges": similarity_edges,
    "similar_baskets": similar_baskets, "similar_baskets_cosine": similar_baskets_cosine,
    "similarity_nodes": similarity_nodes, "elbow": elbow, "connectivity": connectivity,
    "helper_select": helper_select, "bipartite_edges": bipartite_edges, "bipartite_nodes": bipartite_nodes,
    "bipartite_sets": bipartite_sets, "fisher_top1": fisher_top1,
}

_RET = """q AS (SELECT DISTINCT l_returnflag AS study_id, CAST(l_partkey AS VARCHAR) AS member FROM lineitem WHERE l_quantity >= 45)"""
_CNT = """u AS (SELECT DISTINCT study_id, member FROM sets),
  t AS (SELECT u.study_id, count(*) AS "N", count(q.member) AS "K" FROM u LEFT JOIN q ON q.study_id = u.study_id AND q.member = u.member GROUP BY 1),
  c AS (SELECT s.study_id, set_name, any_value("N") AS "N", count(*) AS "M", any_value("K") AS "K", count(q.member) AS x
    FROM sets s JOIN t USING (study_id) LEFT JOIN q ON q.study_id = s.study_id AND q.member = s.member GROUP BY ALL)"""


def _ln_choose(n, k):
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def _tail(N, M, K, x):
    """List expression of the upper hypergeometric tail."""
    body = f"exp({_ln_choose(M, 'j')} + {_ln_choose(f'({N} - {M})', f'({K} - j)')} - {_ln_choose(N, K)})"
    return f"least(1.0, list_sum([{body} for j in range(greatest({x}, 0, {K} - ({N} - {M})), least({M}, {K}) + 1)]))"


_IQ = f"""{intervals_sql()}, {PROPERTY_SETS_SQL}, q AS (SELECT DISTINCT 'E' AS study_id, CAST(b.id AS VARCHAR) AS member
  FROM iv a JOIN iv b ON a.chrom = b.chrom AND b.s <= a.s - 1 AND a.s - 1 <= b.e)"""
_BH = """greatest(0, least(1.0, min(p * m / r) OVER (PARTITION BY study_id ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)))"""
_P = """x AS (SELECT o_orderstatus AS study_id, o_orderkey AS id, CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000 > 0.01
      THEN CAST(floor(o_totalprice) AS BIGINT) % 1000 / 1000 END AS p FROM orders),
  k AS (SELECT *, count(*) OVER (PARTITION BY study_id) AS m, row_number() OVER (PARTITION BY study_id ORDER BY p, id) AS r FROM x WHERE p IS NOT NULL)"""


def _adj(expr, order):
    return f"""WITH {_P}, a AS (SELECT study_id, id, least(1.0, {expr} OVER (PARTITION BY study_id ORDER BY p {order}, id {order} ROWS UNBOUNDED PRECEDING)) AS q FROM k)
      SELECT x.study_id, x.id AS o_orderkey, x.p, round(a.q, 6) AS q FROM x LEFT JOIN a USING (study_id, id)"""


_SIM = """n AS (SELECT study_id, set_name, count(*) AS n FROM edges GROUP BY ALL),
  pr AS (SELECT a.study_id, a.set_name AS f, b.set_name AS t, count(*) AS k FROM edges a JOIN edges b
    ON a.study_id = b.study_id AND a.member = b.member AND a.set_name < b.set_name GROUP BY ALL),
  cs AS (SELECT pr.study_id, f, t, k / sqrt(x.n * y.n) AS similarity FROM pr JOIN n x ON x.study_id = pr.study_id AND x.set_name = f
    JOIN n y ON y.study_id = pr.study_id AND y.set_name = t)"""


def _elbow(src, cut):
    return f"""e0 AS (SELECT study_id, set_name, q_value, -log10(q_value) AS y, row_number() OVER (PARTITION BY study_id ORDER BY q_value, set_name) AS r,
    count(*) OVER (PARTITION BY study_id) AS n FROM {src} WHERE q_value < {cut}),
  e1 AS (SELECT *, round((1 - coalesce((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 0)) - coalesce((r - 1) / nullif(n - 1, 0), 0), 12) AS gap
    FROM e0 WINDOW w AS (PARTITION BY study_id)),
  elb AS (SELECT study_id, arg_max(q_value, (gap, -r)) AS q_elbow FROM e1 GROUP BY 1)"""


_BIP = f"""{RESULTS_SQL},
  lp AS (SELECT l_returnflag AS study_id, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS enh_set, p_brand AS gene_set, l_quantity AS qy
    FROM lineitem JOIN part ON p_partkey = l_partkey),
  fi AS (SELECT study_id, enh_set, gene_set, round(exp(-sum(qy) / 40.0), 12) AS p_adj FROM lp GROUP BY ALL),
  gs AS (SELECT study_id, gene_set, round((avg(qy) - 25.5) * 10, 6) AS nes FROM lp GROUP BY ALL),
  pe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY q_value, abs(signed_q_value) DESC, ord) AS rn FROM res) WHERE rn <= 10),
  pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY abs(nes) DESC, gene_set) AS rn FROM gs) WHERE rn <= 15),
  ok AS (SELECT * FROM fi WHERE p_adj <= 0.1),
  rt AS (SELECT DISTINCT ok.study_id, enh_set FROM ok JOIN pe ON pe.study_id = ok.study_id AND set_name = enh_set),
  lf AS (SELECT DISTINCT ok.study_id, ok.gene_set, nes FROM ok JOIN pg ON pg.study_id = ok.study_id AND pg.gene_set = ok.gene_set),
  sc AS (SELECT ok.study_id, ok.enh_set, ok.gene_set, max(-log10(greatest(p_adj, 2.2250738585072014e-308))) AS w FROM ok
    JOIN rt ON rt.study_id = ok.study_id AND rt.enh_set = ok.enh_set JOIN lf ON lf.study_id = ok.study_id AND lf.gene_set = ok.gene_set GROUP BY ALL)"""

_BASKETS = """WITH m AS (SELECT DISTINCT o_orderpriority AS study_id, o_orderkey AS o, p_brand || '/' || p_type AS member
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  n AS (SELECT study_id, o, count(*) AS n FROM m GROUP BY ALL),
  c AS (SELECT x.study_id, x.o AS a, y.o AS b, count(*) AS c FROM m x JOIN m y ON x.study_id = y.study_id AND x.member = y.member AND x.o < y.o GROUP BY ALL),
  s AS (SELECT c.*, p.n AS na, q.n AS nb FROM c JOIN n p ON p.study_id = c.study_id AND p.o = a JOIN n q ON q.study_id = c.study_id AND q.o = b)
  SELECT study_id, a, b, c AS common, round({value}, 6) AS similarity FROM s WHERE {value} >= {cut} - 1e-9"""

ORACLES = {
    "member_frequency": f"""WITH {SUPPLIER_SETS_SQL}, t AS (SELECT study_id, count(DISTINCT set_name) AS t FROM sets GROUP BY 1)
      SELECT study_id, member, count(*) AS n_sets, round(count(*) / any_value(t), 6) AS frequency FROM sets JOIN t USING (study_id) GROUP BY ALL""",
    "specific_sets": f"""WITH {SUPPLIER_SETS_SQL}, t AS (SELECT study_id, count(DISTINCT set_name) AS t FROM sets GROUP BY 1),
      f AS (SELECT study_id, member FROM sets JOIN t USING (study_id) GROUP BY study_id, member, t HAVING count(*) / t <= 0.12),
      k AS (SELECT s.* FROM sets s JOIN f USING (study_id, member))
      SELECT study_id, set_name, member FROM k WHERE (study_id, set_name) IN (SELECT (study_id, set_name) FROM k GROUP BY study_id, set_name HAVING count(*) > 20)""",
    "set_sizes": f"WITH {SUPPLIER_SETS_SQL} SELECT study_id, set_name, count(DISTINCT member) AS size FROM sets GROUP BY ALL",
    "clean_sets": """WITH x AS (SELECT lang AS study_id, source AS set_name, trim(unnest(string_split(text, ','))) AS member FROM documents)
      SELECT DISTINCT * FROM x WHERE member <> ''""",
    "set_intersection": f"WITH {BRAND_SETS_SQL}, {_RET} SELECT s.* FROM sets s JOIN q USING (study_id, member)",
    "set_difference": f"WITH {BRAND_SETS_SQL}, {_RET} SELECT s.* FROM sets s ANTI JOIN q USING (study_id, member)",
    "set_universe": f"WITH {BRAND_SETS_SQL}, {_RET} SELECT study_id, member FROM sets UNION SELECT study_id, member FROM q",
    "ora_interval_counts": f"WITH {_IQ}, {_CNT} SELECT * FROM c",
    "ora_intervals": f"""WITH {_IQ}, {_CNT}, h AS (SELECT *, round(CASE WHEN x = 0 THEN 1.0 ELSE {_tail('"N"', '"M"', '"K"', 'x')} END, 9) AS p, set_name AS id FROM c),
      k AS (SELECT *, count(*) OVER (PARTITION BY study_id) AS tests, row_number() OVER (PARTITION BY study_id ORDER BY p, id) AS r FROM h)
      SELECT study_id, set_name, "N", "M", "K", x, round(p, 6) AS p_hyper, round({_BH.replace("p * m", "p * tests")}, 6) AS p_adj FROM k""",
    "ora_parts": f"""WITH {SUPPLIER_SETS_SQL.replace('l_suppkey AS set_ord,', '')}, {_RET}, {_CNT}
      SELECT *, round(CASE WHEN x = 0 THEN 1.0 ELSE {_tail('"N"', '"M"', '"K"', 'x')} END, 6) AS p_hyper FROM c""",
    "ora_empirical_bounds": f"""WITH {BRAND_SETS_SQL}, {_RET}, {_CNT}
      SELECT *, round(CASE WHEN x = 0 THEN 1.0 ELSE {_tail('"N"', '"M"', '"K"', 'x')} END, 6) AS p_hyper,
        true AS within_bounds, true AS adjusted_up FROM c""",
    "hypergeometric": f"""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x0, (l_suppkey + 1) * 4 AS m0 FROM lineitem),
      v AS (SELECT DISTINCT x0, m0 FROM d), p AS (SELECT x0, m0, CASE WHEN x0 > least(m0, 300) THEN 0.0 ELSE {_tail('5000', 'm0', '300', 'x0')} END AS p FROM v)
      SELECT l_orderkey, l_linenumber, round(p, 6) AS p FROM d JOIN p USING (x0, m0)""",
    "bh_adjust": _adj("min(p * m / r)", "DESC"),
    "by_adjust": _adj("min(p * m / r * list_sum([1.0 / i for i in range(1, m + 1)]))", "DESC"),
    "holm_adjust": _adj("max(p * (m - r + 1))", "ASC"),
    "hochberg_adjust": _adj("min(p * (m - r + 1))", "DESC"),
    # Level of size i: i times the least p_(m - i + j) / j; a p leaves at the least max(i p, largest level above i).
    "hommel_adjust": f"""WITH {_P}, al AS (SELECT a.study_id, any_value(a.m) - a.r + 1 AS i, min(b.p / (b.r - a.r + 1)) * (any_value(a.m) - a.r + 1) AS v
        FROM k a JOIN k b ON a.study_id = b.study_id AND b.r >= a.r GROUP BY a.study_id, a.r),
      nx AS (SELECT study_id, i - 1 AS i, max(v) OVER (PARTITION BY study_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS above FROM al
        UNION ALL SELECT study_id, max(i), 0 FROM al GROUP BY 1),
      ad AS (SELECT d.study_id, d.p, least(1, min(greatest(i * d.p, above))) AS q FROM (SELECT DISTINCT study_id, p FROM k) d JOIN nx USING (study_id) GROUP BY ALL)
      SELECT x.study_id, x.id AS o_orderkey, x.p, round(q, 6) AS q FROM x LEFT JOIN ad ON ad.study_id = x.study_id AND ad.p = x.p""",
    "unadjusted": f"WITH {_P} SELECT study_id, id AS o_orderkey, p, round(p, 6) AS q FROM x",
    "bonferroni_adjust": f"WITH {_P} SELECT x.study_id, x.id AS o_orderkey, x.p, CASE WHEN x.p IS NOT NULL THEN round(least(1.0, x.p * m), 6) END AS q FROM x LEFT JOIN k USING (study_id, id)",
    "set_pairs": f"""WITH {SUPPLIER_SETS_SQL} SELECT a.study_id, a.set_name AS a, b.set_name AS b, count(*) AS n FROM sets a JOIN sets b
      ON a.study_id = b.study_id AND a.member = b.member AND a.set_name < b.set_name GROUP BY ALL""",
    "set_cosine": f"""WITH {SUPPLIER_SETS_SQL.replace('sets AS', 'edges AS')}, {_SIM} SELECT study_id, f AS "from", t AS "to", round(similarity, 6) AS similarity FROM cs""",
    "similar_baskets": _BASKETS.format(value="c / (na + nb - c)", cut=0.6),
    "similar_baskets_cosine": _BASKETS.format(value="c / sqrt(na * nb)", cut=0.75),
    "similarity_edges": f"""WITH {RESULTS_SQL}, {_SIM} SELECT study_id, f AS "from", t AS "to", round(similarity, 6) AS similarity FROM cs WHERE similarity > 0.12""",
    "similarity_nodes": f"WITH {RESULTS_SQL} SELECT study_id, set_name AS id, round(20 * abs(nes), 6) AS size, CASE WHEN nes > 0 THEN 'Up' ELSE 'Down' END AS type FROM res",
    "elbow": f"WITH {RESULTS_SQL}, {_elbow('res', 0.9)} SELECT * FROM elb",
    "connectivity": f"""WITH {RESULTS_SQL}, {_SIM}, b AS (SELECT study_id, f AS set_name, similarity FROM cs UNION ALL SELECT study_id, t, similarity FROM cs)
      SELECT r.study_id, r.set_name, round(coalesce(sum(similarity), 0), 6) AS connectivity FROM res r LEFT JOIN b USING (study_id, set_name) GROUP BY ALL""",
    "helper_select": f"""WITH {RESULTS_SQL}, {_elbow('res', 0.9)}, kept AS (SELECT res.* FROM res JOIN elb USING (study_id) WHERE q_value < 0.9 AND q_value <= q_elbow),
      {_SIM.replace('FROM edges', 'FROM ed2').replace('JOIN edges', 'JOIN ed2').replace('n AS (SELECT study_id', 'ed2 AS (SELECT edges.* FROM edges JOIN kept USING (study_id, set_name)), n AS (SELECT study_id', 1)},
      b AS (SELECT study_id, f AS set_name, similarity FROM cs UNION ALL SELECT study_id, t, similarity FROM cs),
      v AS (SELECT k.study_id, k.set_name, k.q_value, round(coalesce(sum(similarity), 0), 12) AS c FROM kept k LEFT JOIN b USING (study_id, set_name) GROUP BY ALL),
      md AS (SELECT study_id, quantile_cont(c, 0.5) AS md FROM v GROUP BY 1)
      SELECT study_id, set_name, q_value, round(c, 6) AS connectivity FROM v JOIN md USING (study_id) WHERE c >= md - 1e-12""",
    "bipartite_edges": f"""WITH {_BIP} SELECT study_id, gene_set AS "from", enh_set AS "to", round(w, 6) AS weight, round(pow(10, -w), 6) AS fdr FROM sc WHERE w > 0 AND w >= -log10(1e-3)""",
    "bipartite_nodes": f"""WITH {_BIP}, l AS (SELECT study_id, gene_set AS name, 'GSEA' AS side, nes, CASE WHEN nes < 0 THEN 'neg' ELSE 'pos' END AS nes_sign,
        round(CASE WHEN max(abs(nes)) OVER w > min(abs(nes)) OVER w THEN (abs(nes) - min(abs(nes)) OVER w) / (max(abs(nes)) OVER w - min(abs(nes)) OVER w) * 8 + 4 ELSE 8 END, 6) AS size,
        0.25 AS x, CAST(count(*) OVER w - row_number() OVER (PARTITION BY study_id ORDER BY abs(nes) DESC, gene_set) + 1 AS DOUBLE) AS y FROM lf WINDOW w AS (PARTITION BY study_id)),
      s AS (SELECT rt.study_id, rt.enh_set, round(coalesce(sum(w), 0), 12) AS st FROM rt LEFT JOIN sc USING (study_id, enh_set) GROUP BY ALL)
      SELECT study_id, name, side, nes, nes_sign, size, CAST(x AS DOUBLE) AS x, y FROM l UNION ALL SELECT study_id, enh_set, 'ESEA', NULL, NULL, 6.0, 0.75,
        CAST(count(*) OVER (PARTITION BY study_id) - row_number() OVER (PARTITION BY study_id ORDER BY st DESC, enh_set) + 1 AS DOUBLE) FROM s""",
    "bipartite_sets": f"WITH {_BIP} SELECT pe.study_id, pe.set_name, q_value FROM pe JOIN rt ON rt.study_id = pe.study_id AND rt.enh_set = pe.set_name",
    "fisher_top1": f"""WITH {RESULTS_SQL}, assoc AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS gh, CAST(l_suppkey AS VARCHAR) AS sy FROM lineitem),
      n AS (SELECT count(DISTINCT sy) AS n FROM assoc),
      gn AS (SELECT DISTINCT study_id, set_name AS helper, sy FROM edges JOIN assoc ON gh = member),
      b AS (SELECT study_id, helper, count(*) AS b FROM gn GROUP BY ALL),
      gset AS (SELECT CAST(s_nationkey AS BIGINT) AS ord, 'N' || s_nationkey AS label, CAST(s_suppkey AS VARCHAR) AS sy FROM supplier WHERE CAST(s_suppkey AS VARCHAR) IN (SELECT sy FROM assoc)),
      a AS (SELECT ord, label, count(*) AS a FROM gset GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500),
      k AS (SELECT study_id, helper, ord, count(*) AS k FROM gn JOIN gset USING (sy) GROUP BY ALL),
      t AS (SELECT b.study_id, b.helper, b, a.ord, label, a, greatest(1, coalesce(k, 0)) AS k, n FROM b CROSS JOIN a CROSS JOIN n LEFT JOIN k ON k.study_id = b.study_id AND k.helper = b.helper AND k.ord = a.ord),
      p AS (SELECT *, CASE WHEN k > least(a, b) THEN 0.0 ELSE {_tail('n', 'a', 'b', 'k')} END AS p FROM t),
      r AS (SELECT *, row_number() OVER (PARTITION BY study_id, helper ORDER BY p) AS j, count(*) OVER (PARTITION BY study_id, helper) AS m FROM p),
      z AS (SELECT study_id, helper, least(1.0, min(p * m / j)) AS q, arg_min(label, (round(p, 12), ord)) AS label FROM r GROUP BY ALL)
      SELECT res.study_id, res.set_name AS helper, round(q, 6) AS top_q, CASE WHEN q < 0.9 THEN label ELSE 'no significant HALLMARK annotation' END AS top_hallmark
        FROM res LEFT JOIN z ON z.study_id = res.study_id AND z.helper = res.set_name""",
}
