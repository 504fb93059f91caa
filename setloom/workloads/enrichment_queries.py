"""Preranked enrichment, its plot tables, set disambiguation and per-sample activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import AS_241, inverse_normal, signed_q as signed_q_value, two_sided_normal
from ..operators import activity, gsea, matrix as mx, splitting
from ..session import cut_lineage
from .matrix_queries import de_counts, de_samples, two_sided_sql, _DE_COUNTS, _DE_SAMPLES, _DENSE
from .roles import (
    BRAND_SETS_SQL, COUNTS_SQL, RESULTS_SQL, SAMPLES_SQL, SUPPLIER_SETS_SQL, WEIGHTS_SQL, brand_sets, counts, results,
    rounded, samples, supplier_sets, table, weights,
)


def feature_ranks(spark, sf):
    return gsea.rank_features(weights(spark, sf))


def es_running(spark, sf):
    h = gsea.set_hits(gsea.rank_features(weights(spark, sf)), brand_sets(spark, sf))
    return rounded(h.select("study_id", "set_name", "feature_id", "rank", "i", "top", "bottom"), "top", "bottom")


def es_scores(spark, sf):
    r = gsea.enrichment_scores(gsea.rank_features(weights(spark, sf)), supplier_sets(spark, sf), 15, leading_edge=False)
    return rounded(r.drop("N"), "es")


def leading_edge(spark, sf):
    r = gsea.enrichment_scores(gsea.rank_features(weights(spark, sf)), brand_sets(spark, sf), 15)
    return rounded(r.select("study_id", "set_name", "es", F.array_join("leading_edge", ", ").alias("leading_edge")), "es")


def enrichment_curve(spark, sf):
    h = gsea.enrichment_curve(weights(spark, sf), brand_sets(spark, sf), "Brand#13")
    return rounded(h, "top", "bottom")


def gsea_table(spark, sf):
    r = gsea.run_enrichment(weights(spark, sf), brand_sets(spark, sf), min_size=15, permutations=2000)
    return r.withColumn("leading_edge", F.array_join("leading_edge", ", "))


def gsea_table_bounds(spark, sf):
    """The enrichment table: what is exact as it is, what is drawn as checks that must hold."""
    r = gsea_table(spark, sf)
    p, q = F.col("p_value"), F.col("q_value")
    return r.select(
        "study_id", "set_name", F.col("size").cast("long").alias("size"), F.round("es", 6).alias("es"), "leading_edge",
        ((p > 0) & (p <= 1) & (q >= p * (1 - 1e-12)) & (q <= 1)).alias("p_in_range"),
        (F.signum("nes") == F.signum("es")).alias("nes_follows_es"))


def _segment_weights(spark, sf):
    """Ranking of the nation x segment cells by mean account balance: few features, so small sets can be enumerated."""
    cell = F.concat(F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").groupBy(F.lit("C").alias("study_id"), cell.alias("feature_id")).agg(
        F.round((F.avg("c_acctbal") - 4500) / 1000, 6).alias("weight"))


def _triple_scores(ranked):
    """Score of every set of three features: explodes the ranks of one ranking, whose weights travel as one array."""
    whole = ranked.groupBy("study_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "aw")))["aw"].alias("w"), F.count(F.lit(1)).cast("int").alias("n"))
    t = whole.withColumn("a", F.explode(F.sequence(F.lit(1), F.col("n") - 2)))
    t = t.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.col("n") - 1)))
    t = t.withColumn("c", F.explode(F.sequence(F.col("b") + 1, F.col("n"))))
    x, y, z = (F.element_at("w", F.col(r)) for r in ("a", "b", "c"))
    t = t.select("study_id", "n", "a", "b", "c", x.alias("x"), y.alias("y"), (x + y + z).alias("s"))
    missed = [(F.col(r) - 1 - i) / (F.col("n") - 3) for i, r in enumerate(("a", "b", "c"))]
    before = [F.lit(0.0), F.col("x") / F.col("s"), (F.col("x") + F.col("y")) / F.col("s")]
    after = [*before[1:], F.lit(1.0)]
    high = F.round(F.greatest(F.lit(0.0), *[u - m for u, m in zip(after, missed, strict=True)]), 12)
    low = F.round(F.least(F.lit(0.0), *[u - m for u, m in zip(before, missed, strict=True)]), 12)
    return t.select("study_id", high.alias("mx"), low.alias("mn")).select(
        "study_id", F.when(F.col("mx") > -F.col("mn"), F.col("mx")).when(-F.col("mn") > F.col("mx"), F.col("mn")).otherwise(0.0).alias("es"))


def gsea_small_p(spark, sf):
    """Sets of three neighbours in a ranking: their exact p, and whether the estimated one is within six standard errors."""
    permutations = 2000
    ranked = cut_lineage(gsea.rank_features(_segment_weights(spark, sf)))
    sets = ranked.select("study_id", F.concat(F.lit("T"), F.floor((F.col("rank") - 1) / 3)).alias("set_name"),
                         F.col("feature_id").alias("member"))
    est = gsea.run_enrichment(_segment_weights(spark, sf), sets, min_size=3, permutations=permutations)
    null = _triple_scores(ranked).groupBy("study_id", "es").agg(F.count(F.lit(1)).alias("n"))
    share = lambda at_least: F.sum(F.when(at_least, F.col("n")).otherwise(0)) / F.sum("n")
    n = null.select("study_id", F.col("es").alias("null_es"), "n")
    extreme = F.when(F.col("es") > 0, F.col("null_es") >= F.col("es")).otherwise(F.col("null_es") <= F.col("es"))
    beside = F.when(F.col("es") > 0, F.col("null_es") >= 0).otherwise(F.col("null_es") <= 0)
    per_set = est.where("size = 3 and es <> 0").join(n, "study_id").groupBy("study_id", "set_name", "es").agg(
        F.first("p_value").alias("p"), F.first("n_more_extreme").alias("more"), share(extreme).alias("tail"), share(beside).alias("same"))
    exact = F.col("tail") / F.col("same")
    error = F.when(F.col("more") < gsea.RARE, F.sqrt(-F.log2("tail") / (splitting.RUNS * splitting.PARTICLES))).otherwise(
        F.sqrt((1 - exact) / (exact * F.col("same") * permutations)))
    return per_set.select("study_id", "set_name", F.round("es", 6).alias("es"), F.round(F.log10(exact), 6).alias("log10_p"),
                          (F.abs(F.col("p") / exact - 1) <= 6 * error).alias("within"))


def nes_scatter(spark, sf):
    rates = mx.detection_rate(counts(spark, sf), samples(spark, sf), 20.0).withColumn("feature_id", F.col("feature_id").cast("string"))
    r = results(spark, sf).withColumn("p_value", F.col("q_value"))
    return rounded(gsea.nes_scatter(r, supplier_sets(spark, sf), rates), "set_detection_rate")


def signed_q(spark, sf):
    r = results(spark, sf)
    return r.select("study_id", "set_name", F.round(signed_q_value(F.col("nes"), F.col("q_value")), 6).alias("signed_q"))


def _selected(spark, sf):
    """The brands themselves, in name order, as the short list to disambiguate."""
    from pyspark.sql import Window

    names = table(spark, sf, "part").select(F.col("p_type").alias("set_name")).distinct()
    named = names.select(F.lit("L").alias("study_id"), "set_name")
    w = Window.partitionBy("study_id").orderBy("set_name")
    return named.withColumn("set_ord", F.row_number().over(w))


def _overlapping(spark, sf):
    """Part types widened by the parts that share their first name word."""
    p = table(spark, sf, "part")
    return p.select(F.lit("L").alias("study_id"), F.explode(F.array("p_type", F.when(F.col("p_size") > 25, "ECONOMY").otherwise("PROMO"))).alias("set_name"),
                    F.col("p_partkey").cast("string").alias("member")).distinct()


def disambiguate(spark, sf):
    w = weights(spark, sf).groupBy("feature_id").agg(F.round(F.avg("weight"), 9).alias("weight")).withColumn("study_id", F.lit("L"))
    chosen = _selected(spark, sf)
    m = gsea.disambiguation_matrix(w, _overlapping(spark, sf), chosen, permutations=500)
    return gsea.disambiguate(m, chosen)


def disambiguation_greedy(spark, sf):
    """The greedy walk on a q matrix between order priorities, one study per order status."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("mo"), "o_totalprice")
    names = o.select(F.col("o_orderstatus").alias("study_id"), F.col("o_orderpriority").alias("set_name")).distinct()
    chosen = names.withColumn("set_ord", F.row_number().over(Window.partitionBy("study_id").orderBy("set_name")))
    per = o.groupBy(F.col("o_orderstatus").alias("study_id"), F.col("o_orderpriority").alias("set_name")).agg(
        F.count(F.lit(1)).alias("n"))
    both = per.select("study_id", "set_name", F.col("n").alias("a")).join(
        per.select("study_id", F.col("set_name").alias("removed_set"), F.col("n").alias("b")), "study_id")
    q = (F.col("a") * 7 + F.col("b") * 13) % 101 / 100
    return gsea.disambiguate(both.select("study_id", "set_name", "removed_set", q.alias("q_value")), chosen)


def set_activity(spark, sf):
    c = de_counts(spark, sf).withColumn("feature_id", F.col("feature_id").cast("string"))
    s = brand_sets(spark, sf).withColumn("study_id", F.lit("L")).distinct()
    return rounded(activity.set_activity(c, de_samples(spark, sf), s), "nes")


def set_activity_corrected(spark, sf):
    c = de_counts(spark, sf).withColumn("feature_id", F.col("feature_id").cast("string"))
    s = supplier_sets(spark, sf).select(F.lit("L").alias("study_id"), "set_name", "member").distinct()
    return rounded(activity.pleiotropy_corrected(c, de_samples(spark, sf), s), "nes")


def rank_scores(spark, sf):
    """Tie-averaged rank share of each cell inside its sample, and back through the normal law."""
    from ..operators.scan import average_rank

    c = counts(spark, sf)
    n = c.groupBy("study_id", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    r = average_rank(c, ["study_id", "sample_id"], "value", "r").join(n, ["study_id", "sample_id"])
    u = F.col("r") / (F.col("n") + 1)
    z = inverse_normal(u)
    back = F.when(z < 0, two_sided_normal(z) / 2).otherwise(1 - two_sided_normal(z) / 2)
    return r.select("study_id", "feature_id", "sample_id", F.round(u, 5).alias("u"), (F.abs(back - u) < 1e-6).alias("inverts"))


QUERIES = {
    "feature_ranks": feature_ranks, "es_running": es_running, "es_scores": es_scores, "leading_edge": leading_edge,
    "enrichment_curve": enrichment_curve, "gsea_table": gsea_table, "gsea_table_bounds": gsea_table_bounds, "nes_scatter": nes_scatter, "signed_q": signed_q,
    "gsea_small_p": gsea_small_p, "disambiguate": disambiguate, "disambiguation_greedy": disambiguation_greedy, "set_activity": set_activity,
    "set_activity_corrected": set_activity_corrected, "rank_scores": rank_scores,
}


def _hits(w="weights"):
    return f"""rk AS (SELECT *, abs(weight) AS aw, row_number() OVER (PARTITION BY study_id ORDER BY weight DESC, feature_id) AS rank,
    count(*) OVER (PARTITION BY study_id) AS nn FROM {w}),
  h0 AS (SELECT s.study_id, s.set_name, feature_id, rank, aw, nn FROM (SELECT DISTINCT study_id, set_name, member FROM sets) s
    JOIN rk ON rk.study_id = s.study_id AND feature_id = member),
  h1 AS (SELECT *, row_number() OVER o AS i, sum(aw) OVER o AS cw, count(*) OVER g AS k, sum(aw) OVER g AS tw FROM h0
    WINDOW g AS (PARTITION BY study_id, set_name), o AS (PARTITION BY study_id, set_name ORDER BY rank ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT *, round((CASE WHEN tw > 0 THEN cw / tw ELSE i / k END) - (rank - i) / (nn - k), 12) AS top,
    round((CASE WHEN tw > 0 THEN (cw - aw) / tw ELSE (i - 1) / k END) - (rank - i) / (nn - k), 12) AS bottom FROM h1 WHERE k < nn),
  e0 AS (SELECT study_id, set_name, any_value(k) AS size, greatest(0, max(top)) AS mx, least(0, min(bottom)) AS mn,
    arg_max(i, (top, -i)) AS peak, arg_min(i, (bottom, i)) AS dip FROM h GROUP BY ALL),
  es AS (SELECT *, CASE WHEN mx > -mn THEN mx WHEN -mn > mx THEN mn ELSE 0 END AS es FROM e0)"""


def _horner(x, coefs):
    out = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({out} * ({x}) + {c!r})"
    return out


def _inverse_normal_sql(p):
    (a, b), (c, d), (e, f) = AS_241
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    r0 = f"0.180625 - {q} * {q}"
    return f"""CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner(r0, a)} / {_horner(r0, b)}
      WHEN {r} <= 5 THEN sign({q}) * {_horner(f"{r} - 1.6", c)} / {_horner(f"{r} - 1.6", d)}
      ELSE sign({q}) * {_horner(f"{r} - 5.0", e)} / {_horner(f"{r} - 5.0", f)} END"""


# Scores of the differential counts, and the cells of a set table: study 'L', members as text.
_SCORES = f"""{_DE_COUNTS}, {_DE_SAMPLES}, {_DENSE},
  zz AS (SELECT *, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 12) AS zv FROM dense WINDOW w AS (PARTITION BY feature_id)),
  ra AS (SELECT *, (rank() OVER (PARTITION BY sample_id ORDER BY zv) + (count(*) OVER (PARTITION BY sample_id, zv) - 1) / 2.0)
    / (count(*) OVER (PARTITION BY sample_id) + 1) AS u FROM zz WHERE zv IS NOT NULL),
  sc AS (SELECT CAST(feature_id AS VARCHAR) AS feature_id, sample_id, {_inverse_normal_sql("u")} AS score FROM ra)"""
_BRANDS = "st AS (SELECT DISTINCT p_brand AS set_name, CAST(p_partkey AS VARCHAR) AS feature_id FROM lineitem JOIN part ON l_partkey = p_partkey)"
_SUPPLIERS = """st AS (SELECT DISTINCT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS set_name, CAST(l_partkey AS VARCHAR) AS feature_id FROM lineitem)"""

_CORRECTED = f"""WITH {_SCORES}, {_SUPPLIERS},
  ce AS (SELECT set_name, sample_id, feature_id, score FROM sc JOIN st USING (feature_id)),
  ba AS (SELECT set_name, sample_id, count(*) AS k, sum(score) AS s FROM ce GROUP BY ALL HAVING count(*) >= 25),
  ac AS (SELECT * FROM ba WHERE {two_sided_sql("(s / sqrt(k))")} < 0.05),
  ne AS (SELECT x.set_name AS a, y.set_name AS b FROM st x JOIN st y ON x.feature_id = y.feature_id AND x.set_name <> y.set_name
    GROUP BY ALL HAVING count(*) >= 10),
  ri AS (SELECT a, b, x.sample_id, x.s AS sa, x.k AS ka FROM ne JOIN ac x ON x.set_name = a JOIN ac y ON y.set_name = b AND y.sample_id = x.sample_id),
  sh AS (SELECT a, b, sample_id, p.feature_id FROM ri JOIN st p ON p.set_name = a JOIN st q ON q.set_name = b AND q.feature_id = p.feature_id),
  on_ AS (SELECT a, b, sample_id, count(*) AS kc, sum(score) AS s_ FROM sh JOIN sc USING (feature_id, sample_id) GROUP BY ALL),
  gp AS (SELECT *, (s_ / kc - (sa - s_) / (ka - kc)) / sqrt(1.0 / kc + 1.0 / (ka - kc)) AS g FROM on_ JOIN ri USING (a, b, sample_id) WHERE ka > kc),
  ln_ AS (SELECT a, b, sample_id, {two_sided_sql("g")} < 0.05 AND sign(g) = sign(sa) AS lean FROM gp),
  sd AS (SELECT x.a, x.b, x.sample_id FROM ln_ x LEFT JOIN ln_ y ON y.a = x.b AND y.b = x.a AND y.sample_id = x.sample_id
    WHERE x.lean AND NOT coalesce(y.lean, false)),
  pt AS (SELECT a, sample_id, count(*) AS t FROM sd GROUP BY ALL),
  li AS (SELECT a AS set_name, sample_id, feature_id, pow(20.0, -count(*) / any_value(t)) AS wt
    FROM sd JOIN sh USING (a, b, sample_id) JOIN pt USING (a, sample_id) GROUP BY ALL),
  wt AS (SELECT ce.*, coalesce(wt, 1.0) AS w FROM ce LEFT JOIN li USING (set_name, sample_id, feature_id))
  SELECT 'L' AS study_id, set_name, sample_id, count(*) AS size, round(sum(w * score) / sqrt(sum(w * w)), 6) AS nes FROM wt
  GROUP BY ALL HAVING count(*) >= 25"""

_SUP = SUPPLIER_SETS_SQL.replace("l_suppkey AS set_ord,", "")

ORACLES = {
    "feature_ranks": f"WITH {WEIGHTS_SQL} SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY weight DESC, feature_id) AS rank, abs(weight) AS aw FROM weights",
    "es_running": f"WITH {WEIGHTS_SQL}, {BRAND_SETS_SQL}, {_hits()} SELECT study_id, set_name, feature_id, rank, i, round(top, 6) AS top, round(bottom, 6) AS bottom FROM h",
    "es_scores": f"WITH {WEIGHTS_SQL}, {_SUP}, {_hits()} SELECT study_id, set_name, size, round(es, 6) AS es FROM es WHERE size >= 15",
    "leading_edge": f"""WITH {WEIGHTS_SQL}, {BRAND_SETS_SQL}, {_hits()}, le AS (SELECT h.study_id, h.set_name,
        string_agg(feature_id, ', ' ORDER BY CASE WHEN es > 0 THEN i ELSE -i END) AS leading_edge FROM h JOIN es USING (study_id, set_name)
        WHERE (es > 0 AND i <= peak) OR (es < 0 AND i >= dip) GROUP BY ALL)
      SELECT study_id, set_name, round(es, 6) AS es, coalesce(leading_edge, '') AS leading_edge FROM es LEFT JOIN le USING (study_id, set_name) WHERE size >= 15""",
    "gsea_table_bounds": f"""WITH {WEIGHTS_SQL}, {BRAND_SETS_SQL}, {_hits()}, le AS (SELECT h.study_id, h.set_name,
        string_agg(feature_id, ', ' ORDER BY CASE WHEN es > 0 THEN i ELSE -i END) AS leading_edge FROM h JOIN es USING (study_id, set_name)
        WHERE (es > 0 AND i <= peak) OR (es < 0 AND i >= dip) GROUP BY ALL)
      SELECT study_id, set_name, size, round(es, 6) AS es, coalesce(leading_edge, '') AS leading_edge, true AS p_in_range,
        true AS nes_follows_es FROM es LEFT JOIN le USING (study_id, set_name) WHERE size >= 15""",
    "gsea_small_p": """WITH w AS (SELECT c_nationkey || '_' || c_mktsegment AS f, round((avg(c_acctbal) - 4500) / 1000, 6) AS weight FROM customer GROUP BY ALL),
      rk AS (SELECT f, abs(weight) AS aw, row_number() OVER (ORDER BY weight DESC, f) AS r, count(*) OVER () AS n FROM w),
      t AS (SELECT a.n, a.r AS ra, b.r AS rb, c.r AS rc, a.aw AS x, b.aw AS y, a.aw + b.aw + c.aw AS s
        FROM rk a JOIN rk b ON a.r < b.r JOIN rk c ON b.r < c.r),
      d AS (SELECT ra, rb, rc,
        round(greatest(0, x / s - (ra - 1) / (n - 3), (x + y) / s - (rb - 2) / (n - 3), 1 - (rc - 3) / (n - 3)), 12) AS mx,
        round(least(0, -(ra - 1) / (n - 3), x / s - (rb - 2) / (n - 3), (x + y) / s - (rc - 3) / (n - 3)), 12) AS mn FROM t),
      e AS (SELECT *, CASE WHEN mx > -mn THEN mx WHEN -mn > mx THEN mn ELSE 0 END AS es FROM d),
      mine AS (SELECT 'T' || (ra - 1) // 3 AS set_name, es FROM e WHERE (ra - 1) % 3 = 0 AND rb = ra + 1 AND rc = ra + 2 AND es <> 0)
      SELECT 'C' AS study_id, set_name, round(mine.es, 6) AS es, round(log10(CASE WHEN mine.es > 0
        THEN count(*) FILTER (e.es >= mine.es) / count(*) FILTER (e.es >= 0)
        ELSE count(*) FILTER (e.es <= mine.es) / count(*) FILTER (e.es <= 0) END), 6) AS log10_p, true AS within
      FROM mine CROSS JOIN e GROUP BY set_name, mine.es""",
    "enrichment_curve": f"""WITH {WEIGHTS_SQL}, w2 AS (SELECT study_id, feature_id, (weight - min(weight) OVER g) / (max(weight) OVER g - min(weight) OVER g) AS weight
        FROM weights WINDOW g AS (PARTITION BY study_id)), {BRAND_SETS_SQL}, {_hits("w2")}
      SELECT study_id, set_name, feature_id, rank, round(top, 6) AS top, round(bottom, 6) AS bottom FROM h WHERE set_name = 'Brand#13'""",
    "nes_scatter": f"""WITH {RESULTS_SQL}, {COUNTS_SQL}, {SAMPLES_SQL}, ns AS (SELECT study_id, count(*) AS n FROM samples GROUP BY 1),
      rt AS (SELECT study_id, CAST(feature_id AS VARCHAR) AS member, count(*) FILTER (WHERE value > 20) / any_value(n) AS rate FROM counts JOIN ns USING (study_id) GROUP BY ALL),
      {_SUP}, d AS (SELECT study_id, set_name, avg(rate) AS dr FROM sets JOIN rt USING (study_id, member) GROUP BY ALL)
      SELECT study_id, set_name, nes, q_value AS p_value, round(coalesce(dr, 0), 6) AS set_detection_rate,
        CAST(row_number() OVER (PARTITION BY study_id ORDER BY nes DESC, set_name) AS INTEGER) AS x,
        row_number() OVER (PARTITION BY study_id ORDER BY nes DESC, set_name) <= 3 OR row_number() OVER (PARTITION BY study_id ORDER BY nes, set_name DESC) <= 3 AS labelled
      FROM res LEFT JOIN d USING (study_id, set_name)""",
    "signed_q": f"WITH {RESULTS_SQL} SELECT study_id, set_name, round(sign(nes) * -log10(greatest(q_value, 2.2250738585072014e-308)), 6) AS signed_q FROM res",
    "disambiguation_greedy": """WITH RECURSIVE per AS (SELECT o_orderstatus AS study_id, o_orderpriority AS set_name, count(*) AS n FROM orders GROUP BY ALL),
      pos AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY set_name) AS so FROM per),
      cells AS (SELECT a.study_id, a.set_name AS x, b.set_name AS y, ((a.n * 7 + b.n * 13) % 101) / 100 AS q, a.so AS r, b.so AS c FROM pos a JOIN pos b USING (study_id)),
      w AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY q DESC, c, r) AS k FROM cells WHERE q > 0.5 AND x <> y),
      go AS (SELECT study_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone FROM (SELECT DISTINCT study_id FROM per)
        UNION ALL SELECT go.study_id, w.k, CASE WHEN list_contains(gone, x) OR list_contains(gone, y) THEN gone ELSE list_append(gone, x) END
        FROM go JOIN w ON w.study_id = go.study_id AND w.k = go.k + 1),
      fin AS (SELECT study_id, arg_max(gone, k) AS gone FROM go GROUP BY 1)
      SELECT study_id, set_name, CAST(so AS INTEGER) AS set_ord, list_contains(gone, set_name) AS removed FROM pos JOIN fin USING (study_id)""",
    "set_activity": f"""WITH {_SCORES}, {_BRANDS} SELECT 'L' AS study_id, set_name, sample_id, count(*) AS size,
      round(avg(score) * sqrt(count(*)), 6) AS nes FROM sc JOIN st USING (feature_id) GROUP BY ALL HAVING count(*) >= 25""",
    "set_activity_corrected": _CORRECTED,
    "rank_scores": f"""WITH {COUNTS_SQL} SELECT study_id, feature_id, sample_id, round((rank() OVER (PARTITION BY study_id, sample_id ORDER BY value)
        + (count(*) OVER (PARTITION BY study_id, sample_id, value) - 1) / 2.0) / (count(*) OVER (PARTITION BY study_id, sample_id) + 1), 5) AS u, true AS inverts FROM counts""",
}
