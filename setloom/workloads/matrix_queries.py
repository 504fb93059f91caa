"""Filtering, collapsing and normalising the part x (year, status) counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import de_weight
from ..operators import de, matrix as mx
from ..params import Contrast
from .roles import COUNTS_SQL, MAPPING_SQL, SAMPLES_SQL, brand_mapping, counts, rounded, samples, table

CELL = ["study_id", "feature_id", "sample_id"]


def _loci(spark, sf):
    return counts(spark, sf).withColumnRenamed("feature_id", "locus_id")


def _collapse(agg, trim=0.1):
    def run(spark, sf):
        return rounded(mx.group_loci(_loci(spark, sf), brand_mapping(spark, sf), agg, trim), "value")
    return run


def lengths(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") * 100).alias("length"))


def cpm(spark, sf):
    return rounded(mx.cpm(counts(spark, sf)), "value")


def tpm(spark, sf):
    return rounded(mx.tpm(counts(spark, sf), lengths(spark, sf)), "value")


def rpkm(spark, sf):
    return rounded(mx.rpkm(counts(spark, sf), lengths(spark, sf)), "value")


def detect_filter(spark, sf):
    return mx.detect_filter(counts(spark, sf), samples(spark, sf), 0.5, 30.0)


def low_count_filter(spark, sf):
    return mx.low_count_filter(counts(spark, sf), 250.0)


def round_counts(spark, sf):
    half = counts(spark, sf).withColumn("value", F.col("value") / 2)
    return mx.round_counts(half)


def filter_by_expr(spark, sf):
    return mx.expression_filter(counts(spark, sf), samples(spark, sf), min_count=20.0)


def zscore_rows(spark, sf):
    return rounded(mx.zscore(counts(spark, sf), samples(spark, sf), "row"), "value")


def zscore_both(spark, sf):
    return rounded(mx.zscore(counts(spark, sf), samples(spark, sf), "both"), "value")


def variance_filter(spark, sf):
    return mx.variance_filter(counts(spark, sf), samples(spark, sf), 0.9)


def colour_breaks(spark, sf):
    return rounded(mx.colour_breaks(mx.zscore(counts(spark, sf), samples(spark, sf), "row")), "q05", "q95")


def value_quantiles(spark, sf):
    return rounded(mx.value_quantiles(counts(spark, sf), 20), "quantile")


def detection_rate(spark, sf):
    return rounded(mx.detection_rate(counts(spark, sf), samples(spark, sf), 20.0), "rate")


def align_samples(spark, sf):
    picked = samples(spark, sf).where(F.col("grp") == "O")
    return mx.align_samples(counts(spark, sf), picked)


def keep_annotated(spark, sf):
    plain = table(spark, sf, "part").where(~F.col("p_type").rlike("(?i)promo")).select(F.col("p_partkey").alias("id"))
    return mx.keep_annotated(counts(spark, sf), plain)


def metadata_groups(spark, sf):
    meta = table(spark, sf, "orders").select(
        F.lit("S").alias("study_id"), F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("source_name"))
    return mx.filter_samples(meta, ["4-NOT SPECIFIED", "1-URGENT"]).select("study_id", "sample_id", "grp")


def _one_study(df):
    return df.withColumn("study_id", F.lit("L"))


def de_counts(spark, sf):
    """All return flags as one study, so that most cells are present."""
    return _one_study(counts(spark, sf)).groupBy(*CELL).agg(F.sum("value").alias("value"))


def de_samples(spark, sf):
    return _one_study(samples(spark, sf)).distinct()


def size_factors(spark, sf):
    return rounded(de.size_factors(de_counts(spark, sf), de_samples(spark, sf)), "size_factor")


def tmm_factors(spark, sf):
    return rounded(mx.tmm_factors(counts(spark, sf)), "norm_factor")


def tmm_cpm(spark, sf):
    c = counts(spark, sf)
    return rounded(mx.cpm(c, mx.tmm_factors(c)), "value")


def preprocess(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit("ter")).alias("regulatory_element_type"))
    out = mx.preprocess(counts(spark, sf), part, samples(spark, sf), filter_low=True, grouped=False,
                        detect_rate=0.5, detect_count=30.0)
    return out["counts"]


def _wald(spark, sf):
    return de.nb_wald(de_counts(spark, sf), de_samples(spark, sf), Contrast("grp", "O", "F"))


def nb_wald(spark, sf):
    return rounded(_wald(spark, sf).drop("pvalue", "padj"), "base_mean", "dispersion", "lfc", "lfc_se", "stat", digits=5)


def nb_wald_adjusted(spark, sf):
    return rounded(_wald(spark, sf).select("study_id", "feature_id", "pvalue", "padj"), "pvalue", "padj", digits=5)


def de_weights(spark, sf):
    """Signed weights with the price rank as p and the quantity deviation as statistic."""
    x = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("p"), (F.col("l_quantity") - 25).alias("stat"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(de_weight(F.col("stat"), F.col("p")), 6).alias("weight"))


QUERIES = {
    "collapse_sum": _collapse("sum"), "collapse_mean": _collapse("mean"),
    "collapse_trimmed": _collapse("trimmed_mean"), "collapse_median": _collapse("trimmed_mean", 0.5),
    "cpm": cpm, "tpm": tpm, "rpkm": rpkm, "detect_filter": detect_filter, "low_count_filter": low_count_filter,
    "round_counts": round_counts, "filter_by_expr": filter_by_expr, "zscore_rows": zscore_rows,
    "zscore_both": zscore_both, "variance_filter": variance_filter, "colour_breaks": colour_breaks,
    "value_quantiles": value_quantiles, "detection_rate": detection_rate, "align_samples": align_samples,
    "keep_annotated": keep_annotated, "metadata_groups": metadata_groups, "size_factors": size_factors,
    "tmm_factors": tmm_factors, "tmm_cpm": tmm_cpm, "preprocess": preprocess, "nb_wald": nb_wald,
    "nb_wald_adjusted": nb_wald_adjusted, "de_weights": de_weights,
}

_LIB = "lib AS (SELECT study_id, sample_id, sum(value) AS n FROM counts GROUP BY ALL)"
_NS = "ns AS (SELECT study_id, count(*) AS n FROM samples GROUP BY 1)"
_DENSE = """feat AS (SELECT DISTINCT study_id, feature_id FROM counts),
  dense AS (SELECT f.study_id, f.feature_id, s.sample_id, s.grp, coalesce(c.value, 0) AS value FROM feat f
    JOIN samples s ON s.study_id = f.study_id LEFT JOIN counts c
    ON c.study_id = f.study_id AND c.feature_id = f.feature_id AND c.sample_id = s.sample_id)"""
_CELLS = """sizes AS (SELECT study_id, feature_id AS gid, count(*) AS n FROM mapping GROUP BY ALL),
  grid AS (SELECT m.study_id, m.feature_id AS gid, s.sample_id, coalesce(c.value, 0) AS value, m.locus_id
    FROM mapping m JOIN samples s ON s.study_id = m.study_id LEFT JOIN counts c
      ON c.study_id = m.study_id AND c.feature_id = m.locus_id AND c.sample_id = s.sample_id),
  rk AS (SELECT g.*, n, row_number() OVER (PARTITION BY g.study_id, g.gid, sample_id ORDER BY value, locus_id) AS r
    FROM grid g JOIN sizes z ON z.study_id = g.study_id AND z.gid = g.gid)"""


def _collapse_sql(expr):
    return f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {MAPPING_SQL}, {_CELLS}
      SELECT study_id, gid AS feature_id, sample_id, round({expr}, 6) AS value FROM rk GROUP BY ALL HAVING abs({expr}) > 1e-12"""


_TRIM = "avg(CASE WHEN r > floor(0.1 * n) AND r <= n - floor(0.1 * n) THEN value END)"
_TMM = f"""{_LIB},
  nf AS (SELECT study_id, count(DISTINCT feature_id) AS nf FROM counts GROUP BY 1),
  pad AS (SELECT c.study_id, c.sample_id, value / n AS share FROM counts c JOIN lib USING (study_id, sample_id)
    UNION ALL SELECT study_id, sample_id, 0 FROM (SELECT lib.study_id, lib.sample_id, unnest(range(nf - k)) FROM lib
      JOIN nf USING (study_id) JOIN (SELECT study_id, sample_id, count(*) AS k FROM counts GROUP BY ALL) USING (study_id, sample_id))),
  uq AS (SELECT study_id, sample_id, quantile_cont(share, 0.75) AS q FROM pad GROUP BY ALL),
  ref AS (SELECT study_id, arg_min(sample_id, (round(abs(q - mid), 15), sample_id)) AS ref FROM
    (SELECT *, avg(q) OVER (PARTITION BY study_id) AS mid FROM uq) GROUP BY 1),
  obs AS (SELECT c.*, n FROM counts c JOIN lib USING (study_id, sample_id)),
  pr AS (SELECT o.study_id, o.sample_id, o.feature_id, round(log2(o.value / o.n) - log2(r.value / r.n), 12) AS m,
      round((log2(o.value / o.n) + log2(r.value / r.n)) / 2, 12) AS a,
      (o.n - o.value) / o.n / o.value + (r.n - r.value) / r.n / r.value AS v
    FROM obs o JOIN ref ON ref.study_id = o.study_id JOIN obs r
      ON r.study_id = o.study_id AND r.feature_id = o.feature_id AND r.sample_id = ref.ref),
  rk AS (SELECT *, count(*) OVER g AS n,
      rank() OVER (PARTITION BY study_id, sample_id ORDER BY m) + (count(*) OVER (PARTITION BY study_id, sample_id, m) - 1) / 2.0 AS rm,
      rank() OVER (PARTITION BY study_id, sample_id ORDER BY a) + (count(*) OVER (PARTITION BY study_id, sample_id, a) - 1) / 2.0 AS ra,
      max(abs(m)) OVER g AS flat FROM pr WINDOW g AS (PARTITION BY study_id, sample_id)),
  fac AS (SELECT study_id, sample_id, CASE WHEN max(flat) < 1e-6 THEN 0 ELSE
      sum(m / v) FILTER (WHERE keep) / sum(1 / v) FILTER (WHERE keep) END AS l2 FROM
    (SELECT *, rm >= floor(n * 0.3) + 1 AND rm <= n - floor(n * 0.3) AND ra >= floor(n * 0.05) + 1
      AND ra <= n - floor(n * 0.05) AS keep FROM rk) GROUP BY ALL),
  tmm AS (SELECT study_id, sample_id, pow(2, l2 - avg(l2) OVER (PARTITION BY study_id)) AS norm_factor FROM fac)"""

_SF = f"""{_NS},
  geo AS (SELECT study_id, feature_id, count(*) AS k, avg(ln(value)) AS lg FROM used GROUP BY ALL),
  ful AS (SELECT geo.* FROM geo JOIN ns USING (study_id) WHERE k = n),
  sf AS (SELECT u.study_id, sample_id, exp(quantile_cont(ln(value) - lg, 0.5)) AS size_factor FROM used u
    JOIN ful USING (study_id, feature_id) GROUP BY ALL)"""

_DE_COUNTS = """counts AS (SELECT 'L' AS study_id, l_partkey AS feature_id,
      CAST(year(l_shipdate) AS VARCHAR) || l_linestatus AS sample_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"""
_DE_SAMPLES = """samples AS (SELECT DISTINCT 'L' AS study_id,
      CAST(year(l_shipdate) AS VARCHAR) || l_linestatus AS sample_id, l_linestatus AS grp FROM lineitem)"""

# The published rational Chebyshev fit of erfc, lowest order first.
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_sql(stat):
    """Two-sided normal p of a statistic, by that fit."""
    t = f"(1 / (1 + 0.5 * abs({stat}) / sqrt(2)))"
    return f"least(1, {t} * exp(-{stat} * {stat} / 2 + {' + '.join(f'{c} * pow({t}, {i})' for i, c in enumerate(_ERFC))}))"


_WALD = f"""WITH {_DE_COUNTS}, {_DE_SAMPLES}, used AS (SELECT * FROM counts WHERE (study_id, feature_id) IN
        (SELECT (study_id, feature_id) FROM counts GROUP BY study_id, feature_id HAVING sum(value) > 10)), {_SF},
      meta AS (SELECT * FROM samples JOIN sf USING (study_id, sample_id)),
      feat AS (SELECT DISTINCT study_id, feature_id FROM used),
      y AS (SELECT f.study_id, f.feature_id, grp, size_factor AS s, coalesce(value, 0) / size_factor AS y FROM feat f JOIN meta m ON m.study_id = f.study_id
        LEFT JOIN used u ON u.study_id = f.study_id AND u.feature_id = f.feature_id AND u.sample_id = m.sample_id),
      g AS (SELECT study_id, feature_id, grp, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM y GROUP BY ALL),
      x AS (SELECT study_id, avg(1 / size_factor) AS xim FROM meta GROUP BY 1),
      d AS (SELECT study_id, feature_id, sum(n * m) / sum(n) AS base_mean, sum(ss) / (sum(n) - count(*)) AS v,
          max(greatest(m * n, 0.5) / n) FILTER (WHERE grp = 'O') AS mu1, max(greatest(m * n, 0.5) / n) FILTER (WHERE grp = 'F') AS mu0 FROM g GROUP BY ALL),
      a AS (SELECT d.*, greatest(1e-8, (v - xim * base_mean) / (base_mean * base_mean)) AS dispersion FROM d JOIN x USING (study_id)),
      i AS (SELECT a.study_id, a.feature_id, any_value(base_mean) AS base_mean, any_value(dispersion) AS dispersion, any_value(mu1) AS mu1, any_value(mu0) AS mu0,
          sum(s * mu1 / (1 + dispersion * s * mu1)) FILTER (WHERE grp = 'O') AS i1,
          sum(s * mu0 / (1 + dispersion * s * mu0)) FILTER (WHERE grp = 'F') AS i0 FROM a JOIN y USING (study_id, feature_id) GROUP BY ALL)"""

ORACLES = {
    "collapse_sum": _collapse_sql("sum(value)"),
    "collapse_mean": _collapse_sql("avg(value)"),
    "collapse_trimmed": _collapse_sql(_TRIM),
    "collapse_median": _collapse_sql("quantile_cont(value, 0.5)"),
    "cpm": f"WITH {COUNTS_SQL}, {_LIB} SELECT study_id, feature_id, sample_id, round(value / n * 1e6, 6) AS value FROM counts JOIN lib USING (study_id, sample_id)",
    "tpm": f"""WITH {COUNTS_SQL}, r AS (SELECT counts.*, value / (p_size * 100) AS rate FROM counts JOIN part ON p_partkey = feature_id)
      SELECT study_id, feature_id, sample_id, round(rate / sum(rate) OVER (PARTITION BY study_id, sample_id) * 1e6, 6) AS value FROM r""",
    "rpkm": f"""WITH {COUNTS_SQL}, {_LIB} SELECT study_id, feature_id, sample_id,
      round(value / (p_size * 100 / 1e3) / (n / 1e6), 6) AS value FROM counts JOIN lib USING (study_id, sample_id) JOIN part ON p_partkey = feature_id""",
    "detect_filter": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_NS} SELECT counts.* FROM counts WHERE (study_id, feature_id) IN
      (SELECT (study_id, feature_id) FROM counts JOIN ns USING (study_id) GROUP BY study_id, feature_id, n
       HAVING count(*) FILTER (WHERE value >= 30) >= greatest(1, ceil(0.5 * n)))""",
    "low_count_filter": f"""WITH {COUNTS_SQL} SELECT * FROM counts WHERE (study_id, feature_id) IN
      (SELECT (study_id, feature_id) FROM counts GROUP BY study_id, feature_id HAVING sum(value) > 250)""",
    "round_counts": f"WITH {COUNTS_SQL} SELECT study_id, feature_id, sample_id, round_even(value / 2, 0) AS value FROM counts",
    "filter_by_expr": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_LIB}, cut AS (SELECT study_id, 20 / quantile_cont(n, 0.5) * 1e6 AS cut FROM lib GROUP BY 1),
      g AS (SELECT study_id, min(k) AS need FROM (SELECT study_id, grp, count(*) AS k FROM samples GROUP BY ALL) GROUP BY 1)
      SELECT * FROM counts WHERE (study_id, feature_id) IN (SELECT (study_id, feature_id) FROM counts JOIN lib USING (study_id, sample_id)
        JOIN cut USING (study_id) JOIN g USING (study_id) GROUP BY study_id, feature_id, need
        HAVING count(*) FILTER (WHERE value / n * 1e6 >= cut) >= (CASE WHEN need > 10 THEN 10 + (need - 10) * 0.7 ELSE need END) - 1e-14 AND sum(value) >= 15 - 1e-14)""",
    "zscore_rows": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_DENSE} SELECT study_id, feature_id, sample_id,
      round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value FROM dense WINDOW w AS (PARTITION BY study_id, feature_id)""",
    "zscore_both": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_DENSE}, c AS (SELECT study_id, feature_id, sample_id,
      (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS value FROM dense WINDOW w AS (PARTITION BY study_id, sample_id))
      SELECT study_id, feature_id, sample_id, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value
      FROM c WINDOW w AS (PARTITION BY study_id, feature_id)""",
    "variance_filter": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_DENSE}, v AS (SELECT study_id, feature_id, round(var_samp(value), 9) AS v FROM dense GROUP BY ALL),
      q AS (SELECT study_id, quantile_cont(v, 0.9) AS q FROM v GROUP BY 1)
      SELECT * FROM counts WHERE (study_id, feature_id) IN (SELECT (study_id, feature_id) FROM v JOIN q USING (study_id) WHERE v >= q - 1e-12)""",
    "colour_breaks": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_DENSE}, z AS (SELECT study_id,
      (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM dense WINDOW w AS (PARTITION BY study_id, feature_id))
      SELECT study_id, round(quantile_cont(z, 0.05), 6) AS q05, round(quantile_cont(z, 0.95), 6) AS q95 FROM z GROUP BY 1""",
    "value_quantiles": f"""WITH {COUNTS_SQL}, s AS (SELECT CAST(unnest(range(21)) AS INTEGER) AS step),
      q AS (SELECT study_id, quantile_cont(value, [i / 20.0 for i in range(21)]) AS qs FROM counts GROUP BY 1)
      SELECT study_id, step, round(qs[step + 1], 6) AS quantile FROM q, s""",
    "detection_rate": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_NS} SELECT study_id, feature_id,
      round(count(*) FILTER (WHERE value > 20) / any_value(n), 6) AS rate FROM counts JOIN ns USING (study_id) GROUP BY ALL""",
    "align_samples": f"WITH {COUNTS_SQL} SELECT * FROM counts WHERE sample_id LIKE '%O'",
    "keep_annotated": f"WITH {COUNTS_SQL} SELECT counts.* FROM counts JOIN part ON p_partkey = feature_id WHERE NOT regexp_matches(p_type, '(?i)promo')",
    "metadata_groups": """SELECT 'S' AS study_id, o_orderkey AS sample_id, replace(o_orderpriority, ' ', '_') AS grp FROM orders
      WHERE o_orderpriority IN ('4-NOT SPECIFIED', '1-URGENT')""",
    "size_factors": f"WITH {_DE_COUNTS}, {_DE_SAMPLES}, used AS (SELECT * FROM counts), {_SF} SELECT study_id, sample_id, round(size_factor, 6) AS size_factor FROM sf",
    "tmm_factors": f"WITH {COUNTS_SQL}, {_TMM} SELECT study_id, sample_id, round(norm_factor, 6) AS norm_factor FROM tmm",
    "tmm_cpm": f"""WITH {COUNTS_SQL}, {_TMM} SELECT study_id, feature_id, sample_id, round(value / (n * norm_factor) * 1e6, 6) AS value
      FROM counts JOIN lib USING (study_id, sample_id) JOIN tmm USING (study_id, sample_id)""",
    "preprocess": f"""WITH {COUNTS_SQL}, {SAMPLES_SQL}, {_NS}, k AS (SELECT counts.* FROM counts JOIN part ON p_partkey = feature_id
        WHERE NOT regexp_matches(p_type || 'ter', '(?i)promoter'))
      SELECT k.* FROM k WHERE (study_id, feature_id) IN (SELECT (study_id, feature_id) FROM k JOIN ns USING (study_id) GROUP BY study_id, feature_id, n
       HAVING count(*) FILTER (WHERE value >= 30) >= greatest(1, ceil(0.5 * n)))""",
    "nb_wald": f"""{_WALD}
      SELECT study_id, feature_id, round(base_mean, 5) AS base_mean, round(dispersion, 5) AS dispersion, round(log2(mu1 / mu0), 5) AS lfc,
        round(sqrt(1 / i1 + 1 / i0) / ln(2), 5) AS lfc_se, round(log2(mu1 / mu0) / (sqrt(1 / i1 + 1 / i0) / ln(2)), 5) AS stat FROM i""",
    "nb_wald_adjusted": f"""{_WALD},
      st AS (SELECT study_id, feature_id, log2(mu1 / mu0) / (sqrt(1 / i1 + 1 / i0) / ln(2)) AS z FROM i),
      pv AS (SELECT *, {two_sided_sql("z")} AS p FROM st),
      ad AS (SELECT *, p * count(*) OVER (PARTITION BY study_id) / row_number() OVER (PARTITION BY study_id ORDER BY p) AS raw FROM pv)
      SELECT study_id, feature_id, round(p, 5) AS pvalue,
        round(least(1, min(raw) OVER (PARTITION BY study_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 5) AS padj FROM ad""",
    "de_weights": """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax > 0 THEN
      sign(l_quantity - 25) * -log10(greatest(l_tax, 2.2250738585072014e-308)) ELSE 0 END, 6) AS weight FROM lineitem""",
}
