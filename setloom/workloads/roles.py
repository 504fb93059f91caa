"""Domain roles read from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _seconds(col: str):
    """Whole seconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


# ---- intervals: every event is one interval -------------------------------------------

def intervals(spark, sf_dir, chrom: str = "event_type") -> DataFrame:
    s = _seconds("ts")
    return table(spark, sf_dir, "events").select(
        F.col(chrom).cast("string").alias("chrom"), s.alias("start"),
        (s + F.floor(F.col("value") * 60)).alias("end"),
        F.col("event_id").alias("id"), F.col("event_id").alias("ord"))


def intervals_sql(chrom: str = "event_type", name: str = "iv") -> str:
    return f"""{name} AS (SELECT CAST({chrom} AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s,
      CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS e, event_id AS id FROM events)"""


# ---- counts: part x (year, line status), one study per return flag ----------------------

def counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("study_id"), F.col("l_partkey").alias("feature_id"),
        F.concat(F.year("l_shipdate").cast("string"), F.col("l_linestatus")).alias("sample_id"),
    ).agg(F.sum("l_quantity").alias("value"))


COUNTS_SQL = """counts AS (SELECT l_returnflag AS study_id, l_partkey AS feature_id,
      CAST(year(l_shipdate) AS VARCHAR) || l_linestatus AS sample_id, sum(l_quantity) AS value
      FROM lineitem GROUP BY ALL)"""


def samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("study_id"),
        F.concat(F.year("l_shipdate").cast("string"), F.col("l_linestatus")).alias("sample_id"),
        F.col("l_linestatus").alias("grp")).distinct()


SAMPLES_SQL = """samples AS (SELECT DISTINCT l_returnflag AS study_id,
      CAST(year(l_shipdate) AS VARCHAR) || l_linestatus AS sample_id, l_linestatus AS grp FROM lineitem)"""


def brand_mapping(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("study_id"), F.col("l_partkey").alias("locus_id")).distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("locus_id"), F.col("p_brand").alias("feature_id"))
    return rows.join(parts, "locus_id").select("study_id", "locus_id", "feature_id")


MAPPING_SQL = """mapping AS (SELECT DISTINCT l_returnflag AS study_id, l_partkey AS locus_id, p_brand AS feature_id
      FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# ---- sets -----------------------------------------------------------------------------

def supplier_sets(spark, sf_dir, distinct: bool = True) -> DataFrame:
    """Overlapping sets: the parts each supplier ships, per return flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("study_id"), F.col("l_suppkey").cast("int").alias("set_ord"),
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("set_name"),
        F.col("l_partkey").cast("string").alias("member"))
    return rows.distinct() if distinct else rows


SUPPLIER_SETS_SQL = """sets AS (SELECT DISTINCT l_returnflag AS study_id, l_suppkey AS set_ord,
      'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS set_name, CAST(l_partkey AS VARCHAR) AS member FROM lineitem)"""


def brand_sets(spark, sf_dir) -> DataFrame:
    """Disjoint sets: the parts of each brand, present in every study."""
    studies = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("study_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").join(studies, "p_partkey").select(
        "study_id", F.col("p_brand").alias("set_name"), F.col("p_partkey").cast("string").alias("member"))


BRAND_SETS_SQL = """sets AS (SELECT DISTINCT l_returnflag AS study_id, p_brand AS set_name,
      CAST(p_partkey AS VARCHAR) AS member FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def property_sets(spark, sf_dir) -> DataFrame:
    """Sets of events by the number in their property document."""
    return table(spark, sf_dir, "events").select(
        F.lit("E").alias("study_id"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("set_name"),
        F.col("event_id").cast("string").alias("member"))


PROPERTY_SETS_SQL = """sets AS (SELECT 'E' AS study_id, 'k' || regexp_extract(props, '"k": *([0-9]+)', 1) AS set_name,
      CAST(event_id AS VARCHAR) AS member FROM events)"""


# ---- ranking weights: log ratio of the two line statuses per part -----------------------

def weights(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    o = F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(0.0))
    f = F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("study_id"), F.col("l_partkey").cast("string").alias("feature_id"),
    ).agg(F.round(F.log2((o + 1.0) / (f + 1.0)), 9).alias("weight"))


WEIGHTS_SQL = """weights AS (SELECT l_returnflag AS study_id, CAST(l_partkey AS VARCHAR) AS feature_id,
      round(log2((sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) + 1.0)
               / (sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) + 1.0)), 9) AS weight
      FROM lineitem GROUP BY ALL)"""


# ---- enrichment-like results per supplier -----------------------------------------------

def results(spark, sf_dir) -> DataFrame:
    """Mean-quantity z score of each supplier as NES, exp(-z^2/2) as q, large lines as leading edge."""
    nes = F.round((F.avg("l_quantity") - 25.5) / (14.43 / F.sqrt(F.count(F.lit(1)))), 6)
    edge = F.array_sort(F.collect_set(F.when(F.col("l_quantity") >= 45, F.col("l_partkey").cast("string"))))
    agg = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("study_id"), F.col("l_suppkey").alias("ord"),
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("set_name"),
    ).agg(nes.alias("nes"), edge.alias("leading_edge"), F.count(F.lit(1)).alias("size"))
    q = F.round(F.exp(-F.col("nes") * F.col("nes") / 2), 9)
    return agg.select(
        "study_id", "ord", "set_name", "nes", q.alias("q_value"),
        F.round(F.signum("nes") * -F.log10(F.greatest(q, F.lit(1e-9))), 6).alias("signed_q_value"),
        "size", "leading_edge")


RESULTS_SQL = """res0 AS (SELECT l_returnflag AS study_id, l_suppkey AS ord,
      'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS set_name,
      round((avg(l_quantity) - 25.5) / (14.43 / sqrt(count(*))), 6) AS nes, count(*) AS size
      FROM lineitem GROUP BY ALL),
    res AS (SELECT *, round(exp(-nes * nes / 2), 9) AS q_value,
      round(sign(nes) * -log10(greatest(round(exp(-nes * nes / 2), 9), 1e-9)), 6) AS signed_q_value FROM res0),
    edges AS (SELECT DISTINCT l_returnflag AS study_id, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS set_name,
      CAST(l_partkey AS VARCHAR) AS member FROM lineitem WHERE l_quantity >= 45)"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Values as compared: doubles rounded, the rest unchanged."""
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df
