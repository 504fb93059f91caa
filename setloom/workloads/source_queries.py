"""The text formats: lines and text columns made from the test tables go through the same parsers as files do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.prefilter import normalise_helpers
from ..sources import gmt, tables
from ..streaming import incremental
from .roles import table


def _part_lines(spark, sf):
    """One line of a set file per part: name, description and the orders that hold it; two files, some odd lines."""
    held = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.array_sort(F.collect_set(F.col("l_orderkey"))).alias("orders"))
    p = table(spark, sf, "part").join(held, "p_partkey").select(
        "p_partkey", "p_type", F.concat("p_brand", F.lit(":"), "p_partkey").alias("name"),
        F.array_join(F.transform("orders", lambda o: o.cast("string")), "\t").alias("m"))
    odd = F.when(F.col("p_partkey") % 7 == 0, F.lit("# ")).when(F.col("p_partkey") % 11 == 0, F.lit("é")).otherwise("")
    end = F.when(F.col("p_partkey") % 5 == 0, F.lit("\t")).otherwise("")
    value = F.concat(odd, "name", F.lit("\t"), F.when(F.col("p_partkey") % 13 != 0, F.concat("p_type", F.lit("\t"), "m", end)).otherwise("x"))
    return p.select(F.concat(F.lit("/d/f"), F.col("p_partkey") % 2, F.lit(".gmt")).alias("file"), F.lit(0).cast("long").alias("_block"),
                    F.col("p_partkey").alias("_seq"), value.alias("value"))


def set_file(spark, sf):
    """Set files: order, first-line comments, folded letters, minimum size."""
    return gmt.parse_sets(_part_lines(spark, sf), 20).withColumn("member_ord", F.col("member_ord").cast("int"))


def set_file_lines(spark, sf):
    """Sets written as lines, the name cut at its last colon."""
    s = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("set_ord"), F.concat(F.lit("a:S"), "l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, ":even").otherwise("")).alias("set_name"),
        F.col("l_partkey").cast("string").alias("member"), F.col("l_partkey").alias("member_ord")).distinct()
    return gmt.set_lines(s)


def library_file(spark, sf):
    """Audit libraries: term, source, description, size and first twenty members."""
    return gmt.parse_library(_part_lines(spark, sf)).withColumn("leading_edge", F.array_join("leading_edge", ","))


def count_table(spark, sf):
    """A wide count matrix as text, unfolded without its zeros."""
    q = table(spark, sf, "lineitem").groupBy("l_partkey")
    wide = q.agg(*[F.coalesce(F.sum(F.when(F.year("l_shipdate") == y, F.col("l_quantity"))), F.lit(0.0)).cast("string").alias(f"y.{y}")
                   for y in range(1993, 1998)])
    return tables.long_counts(wide.withColumn("l_partkey", F.col("l_partkey").cast("string")), "L")


def sample_table(spark, sf):
    """Sample metadata in and out: columns by name, the first one is the sample."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("run"), F.col("c_mktsegment").alias("source_name"), F.col("c_nationkey").cast("string").alias("group"))
    return tables.sample_export(tables.sample_rows(c))


def exon_table(spark, sf):
    """Gene annotation lines: exons only, attributes unfolded."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("chrom"), F.lit("t").alias("source"), F.when(F.col("event_id") % 3 == 0, "gene").otherwise("exon").alias("type"),
        F.col("event_id").alias("start"), (F.col("event_id") + F.col("user_id")).alias("end"), F.lit(".").alias("score"), F.lit("+").alias("strand"), F.lit(".").alias("frame"),
        F.concat(F.lit('gene_id "g'), "user_id", F.lit('"; tag "a"; tag "b"; '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('exon_id "e'), "event_id", F.lit('";'))).otherwise("")).alias("attrs"))
    return tables.exon_rows(e).select("chrom", "start", "end", "strand", "gene_id", "exon_id", F.try_element_at("attributes", F.lit("tag")).alias("tag"))


def region_table(spark, sf):
    """Region lines, half open and 0-based, as closed intervals."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("c1"), F.col("event_id").cast("string").alias("c2"),
                                          (F.col("event_id") + F.col("user_id") % 4).cast("string").alias("c3"), F.concat(F.lit("r"), "event_id").alias("c4"))
    return tables.region_rows(e).drop("ord")


def annotation_table(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.lit("GH"), "p_partkey").alias("GHid"), F.when(F.col("p_size") > 25, F.concat(F.lit("chr"), "p_size")).otherwise(F.col("p_size").cast("string")).alias("chr"),
        F.col("p_partkey").cast("string").alias("element_start"), (F.col("p_partkey") + F.col("p_size")).cast("string").alias("element_end"),
        F.concat("p_type", F.lit("  ")).alias("regulatory_element_type"))
    return tables.annotation_rows(p, "chr")


def association_table(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.concat(F.lit("GH"), "l_partkey").alias("GHid"), F.concat(F.lit("G"), "l_suppkey").alias("symbol"), "l_tax").distinct()
    return tables.association_rows(pairs)


def _names(spark, sf):
    n = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 9 == 0, F.lit("# note")).when(F.col("s_suppkey") % 10 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" TF"), F.col("s_suppkey") % 40, F.lit("\textra"))).alias("value"))
    return tables.parse_tf_names(n)


def factor_names(spark, sf):
    """Factor names: first fields, lower case, once each."""
    return _names(spark, sf)


def helper_classes(spark, sf):
    """Helper rows whose class is missing are factors where the list of names holds them."""
    raw = table(spark, sf, "supplier").select(
        F.lit("H").alias("study_id"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("tf"), F.col("s_suppkey") % 50).alias("helper_name"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("gene")).otherwise("").alias("helper_class"),
        F.when(F.col("s_suppkey") % 2 == 0, "1.5").otherwise("-2.0").alias("nes"), F.lit("0.01").alias("q_value"), F.lit("30").alias("size"))
    return normalise_helpers(raw, _names(spark, sf)).select("study_id", "helper_name", "helper_class", "direction")


def verification_table(spark, sf):
    """Verification lines: seven fields or more, rules and headers skipped."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_ord"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("-----|--|-|-|-|-|-|")).when(
        F.col("o_orderkey") % 11 == 0, F.lit("theme | direction|a|b|c|d|e")).when(F.col("o_orderkey") % 12 == 0, F.lit("  ")).when(
        F.col("o_orderkey") % 13 == 0, F.lit("few | fields")).otherwise(F.concat_ws(" | ", "o_orderpriority", "o_orderstatus", F.lit("cell"), F.lit("support"),
        F.col("o_custkey").cast("string"), F.lit(""), F.lit("why"), F.lit("more"))).alias("value"))
    return tables.parse_verification(o)


def metric_matrix(spark, sf):
    """Per-sample metric rows joined by feature into one wide matrix; all-zero features go."""
    q = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("feature_id"), F.col("l_returnflag").alias("sample_id")).agg(
        F.sum(F.when(F.col("l_quantity") >= 40, F.col("l_quantity")).otherwise(0.0)).alias("value"))
    rows = tables.metric_rows(q, "count").unionByName(tables.metric_rows(q, "other"))
    return tables.merge_metric(rows.withColumn("value", F.col("value").cast("double")), "count", ["A", "N", "R"])


def pending(spark, sf):
    """Customers without both a fulfilled and an open order, as samples that still lack an output."""
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("metric"))
    return incremental.pending_samples(table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id")), m, ["F", "O"])


def enrichment_rows(spark, sf):
    """Result rows as written: the leading edge as text, NULL where empty."""
    r = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("set_name")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_quantity") == 50, F.col("l_partkey").cast("string")))).alias("leading_edge"))
    return tables.enrichment_csv(r)


QUERIES = {
    "set_file": set_file, "set_file_lines": set_file_lines, "library_file": library_file, "count_table": count_table,
    "sample_table": sample_table, "exon_table": exon_table, "region_table": region_table, "annotation_table": annotation_table,
    "association_table": association_table, "factor_names": factor_names, "helper_classes": helper_classes,
    "verification_table": verification_table, "metric_matrix": metric_matrix, "pending_samples": pending, "enrichment_rows": enrichment_rows,
}

_ORDERS = """ho AS (SELECT l_partkey AS pk, list_sort(list_distinct(list(l_orderkey))) AS orders FROM lineitem GROUP BY 1),
  pl AS (SELECT p_partkey AS pk, p_type, p_brand || ':' || p_partkey AS name, orders FROM part JOIN ho ON pk = p_partkey),
  ln AS (SELECT *, CASE WHEN pk % 7 = 0 THEN '# ' WHEN pk % 11 = 0 THEN 'é' ELSE '' END AS odd, pk % 2 AS f,
    row_number() OVER (PARTITION BY pk % 2 ORDER BY pk) AS nth FROM pl)"""

ORACLES = {
    "set_file": f"""WITH {_ORDERS}, k AS (SELECT *, CASE odd WHEN 'é' THEN 'e' ELSE odd END || name AS set_name FROM ln
        WHERE NOT (odd = '# ' AND nth = 1) AND pk % 13 <> 0 AND len(orders) >= 20),
      s AS (SELECT *, CAST(row_number() OVER (ORDER BY f, pk) AS INTEGER) AS set_ord FROM k)
      SELECT 'S' AS study_id, set_ord, set_name, CAST(unnest(range(len(orders))) AS INTEGER) AS member_ord, CAST(unnest(orders) AS VARCHAR) AS member FROM s""",
    "set_file_lines": """SELECT CAST(l_suppkey AS INTEGER) AS set_ord, CASE WHEN l_suppkey % 2 = 0 THEN 'a:S' || l_suppkey || chr(9) || 'even'
        ELSE 'a' || chr(9) || 'S' || l_suppkey END || chr(9) || string_agg(DISTINCT CAST(l_partkey AS VARCHAR), chr(9) ORDER BY l_partkey) AS value
      FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey""".replace("string_agg(DISTINCT ", "string_agg("),
    "library_file": f"""WITH {_ORDERS} SELECT trim(odd || name) AS term, 'f' || f AS source, CASE WHEN pk % 13 = 0 THEN 'x' ELSE p_type END AS description,
      CAST(CASE WHEN pk % 13 = 0 THEN 0 ELSE len(orders) END AS INTEGER) AS size,
      CASE WHEN pk % 13 = 0 THEN '' ELSE array_to_string(orders[1:20], ',') END AS leading_edge FROM ln""",
    "count_table": """SELECT 'L' AS study_id, CAST(l_partkey AS VARCHAR) AS feature_id, 'y.' || year(l_shipdate) AS sample_id, sum(l_quantity) AS value
      FROM lineitem WHERE year(l_shipdate) BETWEEN 1993 AND 1997 GROUP BY ALL HAVING sum(l_quantity) <> 0""",
    "sample_table": """SELECT c_name AS "Sample", c_mktsegment AS source_name, CAST(c_nationkey AS VARCHAR) AS "group" FROM customer""",
    "exon_table": """SELECT event_type AS chrom, event_id AS start, event_id + user_id AS "end", '+' AS strand, 'g' || user_id AS gene_id,
      CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS exon_id, 'a' AS tag FROM events WHERE event_id % 3 <> 0""",
    "region_table": """SELECT event_type AS chrom, event_id + 1 AS start, event_id + user_id % 4 AS "end", 'r' || event_id AS id, user_id % 4 = 0 AS "empty" FROM events""",
    "annotation_table": """SELECT 'GH' || p_partkey AS id, 'chr' || p_size AS chrom, p_partkey AS start, p_partkey + p_size AS "end", p_type AS regulatory_element_type FROM part""",
    "association_table": """SELECT "GHid", symbol FROM (SELECT DISTINCT 'GH' || l_partkey AS "GHid", 'G' || l_suppkey AS symbol, l_tax FROM lineitem)""",
    "factor_names": """SELECT DISTINCT 'tf' || (s_suppkey % 40) AS name FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 0""",
    "helper_classes": """WITH n AS (SELECT DISTINCT 'tf' || (s_suppkey % 40) AS name FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 10 <> 0)
      SELECT 'H' AS study_id, 'tf' || (s_suppkey % 50) AS helper_name, CASE WHEN name IS NOT NULL THEN 'tf_family' WHEN s_suppkey % 3 = 0 THEN 'gene' ELSE 'celltype' END AS helper_class,
        CASE WHEN s_suppkey % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM supplier LEFT JOIN n ON name = 'tf' || (s_suppkey % 50)""",
    "verification_table": """SELECT 'S' AS study_id, o_orderkey AS row_ord, o_orderpriority AS theme, o_orderstatus AS direction, 'cell' AS cell_type, 'support' AS decision,
      CAST(o_custkey AS VARCHAR) AS effect_size, '' AS q_value, 'why' AS reason FROM orders
      WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 12 <> 0 AND o_orderkey % 13 <> 0""",
    "metric_matrix": """WITH q AS (SELECT CAST(l_partkey AS VARCHAR) AS n, l_returnflag AS s, CASE WHEN l_quantity >= 40 THEN l_quantity ELSE 0 END AS v FROM lineitem)
      SELECT n AS "Name", coalesce(sum(v) FILTER (s = 'A'), 0) AS "A", coalesce(sum(v) FILTER (s = 'N'), 0) AS "N", coalesce(sum(v) FILTER (s = 'R'), 0) AS "R"
      FROM q GROUP BY n HAVING sum(v) <> 0""",
    "pending_samples": """SELECT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2)""",
    "enrichment_rows": """SELECT l_suppkey AS set_name, string_agg(p, ', ' ORDER BY p) FILTER (p IS NOT NULL) AS leading_edge
      FROM (SELECT DISTINCT l_suppkey, CASE WHEN l_quantity = 50 THEN CAST(l_partkey AS VARCHAR) END AS p FROM lineitem) GROUP BY 1""",
}
