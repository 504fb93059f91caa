"""Tab-separated set files: one set per line, name, description, members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import range_scan


def _lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines with their file and position: (file, line_no, value). Files are split at line ends.

    The position is the running number of the line inside its file: start offset order of
    the splits, then order inside the split.
    """
    raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").option(
        "escape", "").option("maxCharsPerColumn", "-1").option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false").schema("value string").csv(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def ascii_fold(c: Column) -> Column:
    """Latin-1 letters without their marks; what has no plain form becomes a question mark."""
    # Accented Latin-1 letters and their plain forms.
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
    plain = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
    out = F.translate(c, marked, plain)
    for letter, pair in {"ß": "ss", "Æ": "AE", "æ": "ae", "Þ": "TH", "þ": "th"}.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "?")


def read_sets(
    spark: SparkSession, paths: str | list[str], min_members: int = 5, study_id: str = "S", encoding: str = "ISO-8859-1",
) -> DataFrame:
    """Sets in file order: study_id, set_ord, set_name, member, member_ord."""
    return parse_sets(_lines(spark, paths, encoding), min_members, study_id)


def parse_sets(rows: DataFrame, min_members: int = 5, study_id: str = "S") -> DataFrame:
    """Sets of lines (file, _block, _seq, value), in the order of file, block and number.

    A comment is skipped on the first line of a file only. Rows with fewer than three fields
    or fewer than ``min_members`` members drop out; repeated members and names stay.
    """
    at = F.struct("_block", "_seq")
    lead = rows.groupBy("file").agg(F.min(at).alias("_lead"))
    body = rows.join(lead, "file").where(~((at == F.col("_lead")) & F.col("value").rlike(r"^\s*#")))
    fields = body.select("file", "_block", "_seq", F.split(F.regexp_replace(ascii_fold(F.col("value")), r"\t$", ""), "\t").alias("_f"))
    kept = fields.where((F.size("_f") >= 3) & (F.size("_f") - 2 >= min_members)).withColumn("study_id", F.lit(study_id))
    # One range sort: lines are long and all in one study.
    placed = range_scan(kept.withColumn("set_ord", F.lit(1).cast("long")), ["study_id"], ["file", "_block", "_seq"], ["set_ord"])
    sets = placed.select("study_id", F.col("set_ord").cast("int").alias("set_ord"), F.get("_f", F.lit(0)).alias("set_name"),
                         F.slice("_f", 3, 2**31 - 1).alias("_m"))
    return sets.select("study_id", "set_ord", "set_name", F.posexplode("_m").alias("member_ord", "member"))


def read_library(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sets for the rule audit: term, source (file stem), description, size, first 20 genes."""
    return parse_library(_lines(spark, paths))


def parse_library(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).where(F.col("value") != "")
    f = rows.select("file", F.split("value", "\t").alias("_f")).where(F.size("_f") >= 2)
    genes = F.slice("_f", 3, 2**31 - 1)
    return f.select(
        F.trim(F.get("_f", F.lit(0))).alias("term"), F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("source"),
        F.trim(F.get("_f", F.lit(1))).alias("description"), F.size(genes).alias("size"),
        F.slice(genes, 1, 20).alias("leading_edge"))


def set_lines(sets: DataFrame, default_desc: str = ".") -> DataFrame:
    """(set_ord, value) lines; the name is split at its last colon into name and description."""
    per = sets.groupBy("set_ord", "set_name").agg(
        F.array_sort(F.collect_list(F.struct("member_ord", "member")))["member"].alias("_m"))
    pattern = "(?s)^(.*):([^:]+)$"
    split = F.col("set_name").rlike(pattern)
    name = F.when(split, F.regexp_extract("set_name", pattern, 1)).otherwise(F.col("set_name"))
    desc = F.when(split, F.regexp_extract("set_name", pattern, 2)).otherwise(default_desc)
    return per.select("set_ord", F.concat_ws("\t", name, desc, F.array_join("_m", "\t")).alias("value"))


def write_sets(sets: DataFrame, path: str, default_desc: str = ".", header: str = "# set file") -> None:
    """Text files with a comment line in front, overwriting the folder."""
    lines = set_lines(sets, default_desc)
    top = sets.sparkSession.createDataFrame([(-1, header)], "set_ord int, value string")
    lines.unionByName(top).repartitionByRange("set_ord").sortWithinPartitions("set_ord").select("value").write.mode(
        "overwrite").text(path)
