"""Differential tests with shrunken dispersions, and the SQL that repeats every step of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import dispersion
from ..params import Contrast
from .matrix_queries import _DE_COUNTS, _DE_SAMPLES, _SF, de_counts, de_samples, two_sided_sql
from .roles import rounded, table

_CONTRAST = Contrast("grp", "O", "F")


def nb_shrunken(spark, sf):
    """Gene-wise, trend and final dispersions, fold changes, statistics, p and adjusted p of all parts."""
    r = dispersion.differential_test(de_counts(spark, sf), de_samples(spark, sf), _CONTRAST)
    return rounded(r.drop("outlier"), "base_mean", "gene_dispersion", "trend_dispersion", "dispersion", "lfc", "lfc_se",
                   "stat", "pvalue", "padj", digits=4)


def filter_rejections(spark, sf):
    """Rejections at each mean threshold, for p values that fall with the largest order of each customer."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("base_mean"), F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    p = F.when(F.col("last") % 3 == 0, F.exp(-F.col("base_mean") / 30000)).otherwise((F.col("last") % 997 + 1) / 998.0)
    tested = o.select(F.lit("O").alias("study_id"), F.col("o_custkey").alias("feature_id"), "base_mean", F.round(p, 9).alias("pvalue"))
    return rounded(dispersion.rejections(tested), "theta", "cutoff")


QUERIES = {"nb_shrunken": nb_shrunken, "filter_rejections": filter_rejections}

_LOW = repr(math.log(dispersion.LEAST))
_LAST = dispersion.GRID - 1
_TERM = """CASE WHEN a < 1e-3 THEN (1 / a + v - 0.5) * ln(1 + v * a) - v + (1 / (1 / a + v) - a) / 12 - (v + 1 / a) * ln(1 + mu * a)
      ELSE lgamma(v + 1 / a) - lgamma(1 / a) + v * ln(a) - (v + 1 / a) * ln(1 + mu * a) END"""


def _search(name: str, prior: str = "0") -> str:
    """Tables of a search for the best dispersion of each feature: ``name`` (feature_id, d)."""
    parts = [f"{name}_r0 AS (SELECT feature_id, {_LOW} AS low, (top - {_LOW}) / {_LAST} AS step FROM gene_list, tops)"]
    for k in range(dispersion.ROUNDS):
        parts.append(f"""{name}_c{k} AS (SELECT feature_id, j, low + step * j AS at_ FROM {name}_r{k}, (SELECT unnest(range({_LAST + 1})) AS j)),
  {name}_g{k} AS (SELECT feature_id, j, at_, g, sum({_TERM}) AS l, ln(sum(1 / (1 / mu + a))) AS c
    FROM (SELECT *, exp(at_) AS a FROM {name}_c{k} JOIN cells USING (feature_id)) GROUP BY ALL),
  {name}_l{k} AS (SELECT feature_id, j, at_, sum(l) - 0.5 * sum(c) AS v0 FROM {name}_g{k} GROUP BY ALL),
  {name}_v{k} AS (SELECT feature_id, j, at_, v0 - ({prior}) AS v1 FROM {name}_l{k} {"JOIN fitted USING (feature_id)" if prior != "0" else ""}),
  {name}_b{k} AS (SELECT feature_id, arg_max(at_, (v1, -j)) AS best, arg_max(j, (v1, -j)) AS j FROM {name}_v{k} GROUP BY 1),
  {name}_r{k + 1} AS (SELECT feature_id, greatest(b.best - step, {_LOW}) AS low,
    (least(b.best + step, top) - greatest(b.best - step, {_LOW})) / {_LAST} AS step FROM {name}_r{k} JOIN {name}_b{k} b USING (feature_id), tops)""")
    k = dispersion.ROUNDS - 1
    parts.append(f"""{name} AS (SELECT b.feature_id, exp(best + CASE WHEN x.v1 - 2 * y.v1 + z.v1 < 0
      THEN 0.5 * (x.v1 - z.v1) / (x.v1 - 2 * y.v1 + z.v1) * r.step ELSE 0 END) AS d
    FROM {name}_b{k} b JOIN {name}_r{k} r USING (feature_id) JOIN {name}_v{k} y ON y.feature_id = b.feature_id AND y.j = b.j
    LEFT JOIN {name}_v{k} x ON x.feature_id = b.feature_id AND x.j = b.j - 1 LEFT JOIN {name}_v{k} z ON z.feature_id = b.feature_id AND z.j = b.j + 1)""")
    return ",\n  ".join(parts)


NB_SHRUNKEN_SQL = f"""WITH RECURSIVE {_DE_COUNTS}, {_DE_SAMPLES}, used AS (SELECT * FROM counts WHERE feature_id IN
    (SELECT feature_id FROM counts GROUP BY feature_id HAVING sum(value) > 10)), {_SF},
  gene_list AS (SELECT DISTINCT feature_id FROM used),
  tops AS (SELECT ln(greatest(10, count(*))) AS top, count(*) - count(DISTINCT grp) AS freedom FROM samples),
  raw AS (SELECT f.feature_id, grp AS g, size_factor AS s, coalesce(value, 0) AS v
    FROM gene_list f CROSS JOIN (SELECT * FROM samples JOIN sf USING (study_id, sample_id)) m
    LEFT JOIN used u ON u.feature_id = f.feature_id AND u.sample_id = m.sample_id),
  means AS (SELECT feature_id, g, avg(v / s) AS q, count(*) AS k FROM raw GROUP BY ALL),
  cells AS (SELECT raw.*, greatest(q * s, 0.5) AS mu FROM raw JOIN means USING (feature_id, g)),
  {_search("gene")},
  bases AS (SELECT feature_id, avg(v / s) AS base_mean FROM raw GROUP BY 1),
  genes AS (SELECT feature_id, base_mean, d FROM gene JOIN bases USING (feature_id)),
  tr AS (SELECT 0 AS it, 0.1::DOUBLE AS a0, 1.0::DOUBLE AS a1 UNION ALL
    SELECT it + 1, greatest({dispersion.LEAST}, (t0 - b1 * s1) / s0), b1 FROM (SELECT it, s0, s1, t0,
      greatest({dispersion.LEAST}, CASE WHEN s0 * s2 - s1 * s1 > 1e-12 * s0 * s2 THEN (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) ELSE 0 END) AS b1
      FROM (SELECT it, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * d) AS t0, sum(w * x * d) AS t1
        FROM (SELECT it, d, 1 / base_mean AS x, a0 + a1 / base_mean AS f, 1 / ((a0 + a1 / base_mean) * (a0 + a1 / base_mean)) AS w
          FROM tr, genes WHERE it < {dispersion.STEPS} AND d >= {dispersion.FITTED}) WHERE d > 1e-4 * f AND d < 15 * f GROUP BY it))),
  trend AS (SELECT arg_max(a0, it) AS a0, arg_max(a1, it) AS a1 FROM tr),
  gap AS (SELECT round(ln(d) - ln(a0 + a1 / base_mean), 9) AS e FROM genes, trend WHERE d >= {dispersion.FITTED}),
  mad AS (SELECT quantile_cont(abs(e - m), 0.5) AS mad FROM gap, (SELECT quantile_cont(e, 0.5) AS m FROM gap)),
  z AS (SELECT *, pow(1.4826 * mad, 2) AS spread, freedom / 2.0 + 30 AS z0 FROM mad, tops),
  prior AS (SELECT spread, greatest(0.25, spread - (list_sum([1 / pow(freedom / 2.0 + i, 2) for i in range(30)])
    + 1 / z0 + 1 / (2 * z0 * z0) + 1 / (6 * pow(z0, 3)) - 1 / (30 * pow(z0, 5)))) AS pv FROM z),
  fitted AS (SELECT feature_id, base_mean, d, a0 + a1 / base_mean AS tr_d, spread, pv FROM genes, trend, prior),
  {_search("mode", "pow(at_ - ln(tr_d), 2) / (2 * pv)")},
  final AS (SELECT f.*, CASE WHEN ln(f.d) > ln(tr_d) + 2 * sqrt(spread) THEN f.d ELSE m.d END AS disp FROM fitted f JOIN mode m USING (feature_id)),
  gm AS (SELECT 0 AS it, feature_id, g, greatest(q, 0.5 / k) AS m FROM means UNION ALL
    SELECT it + 1, feature_id, g, greatest(any_value(m) * exp(greatest(-3, least(3, sum((v - m * s) / (1 + disp * m * s)) / sum(m * s / (1 + disp * m * s))))), 0.5 / count(*))
    FROM gm JOIN raw USING (feature_id, g) JOIN final USING (feature_id) WHERE it < 15 GROUP BY it, feature_id, g),
  info AS (SELECT feature_id, g, any_value(m) AS m, sum(m * s / (1 + disp * m * s)) AS i FROM gm JOIN raw USING (feature_id, g)
    JOIN final USING (feature_id) WHERE it = 15 GROUP BY ALL),
  wald AS (SELECT a.feature_id, log2(a.m / b.m) AS lfc, sqrt(1 / a.i + 1 / b.i) / ln(2) AS se FROM info a JOIN info b
    ON a.feature_id = b.feature_id AND a.g = 'O' AND b.g = 'F'),
  pv AS (SELECT *, lfc / se AS stat FROM wald),
  ps AS (SELECT *, {two_sided_sql("stat")} AS p FROM pv),
  adj AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw_q FROM ps),
  bh AS (SELECT *, least(1, min(raw_q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM adj)
SELECT 'L' AS study_id, feature_id, round(base_mean, 4) AS base_mean, round(d, 4) AS gene_dispersion, round(tr_d, 4) AS trend_dispersion,
  round(disp, 4) AS dispersion, round(lfc, 4) AS lfc, round(se, 4) AS lfc_se, round(stat, 4) AS stat, round(p, 4) AS pvalue,
  round(padj, 4) AS padj FROM final JOIN bh USING (feature_id)"""

ORACLES = {
    "nb_shrunken": NB_SHRUNKEN_SQL,
    "filter_rejections": f"""WITH o AS (SELECT o_custkey AS f, max(o_totalprice) AS base_mean, max(o_orderkey) AS last FROM orders GROUP BY 1),
      t AS (SELECT f, base_mean, round(CASE WHEN last % 3 = 0 THEN exp(-base_mean / 30000) ELSE (last % 997 + 1) / 998.0 END, 9) AS p FROM o),
      s AS (SELECT unnest(range({dispersion.THETAS})) AS step), zero AS (SELECT avg((base_mean = 0)::INT) AS z FROM t),
      th AS (SELECT step, z + (CASE WHEN z < 0.95 THEN 0.95 ELSE 1 END - z) * step / {dispersion.THETAS - 1} AS theta FROM s, zero),
      srt AS (SELECT list(base_mean ORDER BY base_mean) AS b FROM t),
      c AS (SELECT step, theta, b[floor(h)::BIGINT + 1] + (b[ceil(h)::BIGINT + 1] - b[floor(h)::BIGINT + 1]) * (h - floor(h)) AS cutoff
        FROM (SELECT *, (len(b) - 1) * theta AS h FROM th, srt)),
      k AS (SELECT step, p, row_number() OVER (PARTITION BY step ORDER BY p, f) AS i, count(*) OVER (PARTITION BY step) AS m
        FROM c JOIN t ON base_mean >= cutoff - 1e-12)
      SELECT 'O' AS study_id, step::INTEGER AS step, round(theta, 6) AS theta, round(cutoff, 6) AS cutoff, coalesce(n, 0)::BIGINT AS rejected
      FROM c LEFT JOIN (SELECT step, max(i) AS n FROM k WHERE p * m / i < 0.1 GROUP BY 1) USING (step)""",
}
