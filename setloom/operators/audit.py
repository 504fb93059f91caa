"""Coverage audit of theme rules over gene-set libraries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, upper_tokens
from ..sources.rules import RuleBook
from .themes import match_themes

# Words of set names that never suggest a synonym.
GENERIC = [
    "HALLMARK", "SIGNALING", "PATHWAY", "MODULE", "SET", "GENE", "UP", "DN", "GO", "KEGG", "REACTOME",
    "BIOCARTA", "RESPONSE", "PROCESS", "OF", "AND", "THE", "CELL", "CELLS", "GOBP", "REGULATION",
    "POSITIVE", "NEGATIVE", "TO", "BY", "IN", "CANONICAL",
]
BARRED = ["TNFA", "TNFA_SIGNALING"]


def matched_terms(terms: DataFrame, book: RuleBook) -> DataFrame:
    """Distinct (theme, term) matches. ``terms``: term, source."""
    return match_themes(terms.select("term", "source"), book, "term", "source").where(F.col("weight") > 0)


def count_tokens(matched: DataFrame, kind: str = "token") -> DataFrame:
    """Counts of tokens or bigrams over the distinct matched terms of each theme."""
    tokens = upper_tokens(F.col("term"))
    items = tokens if kind == "token" else bigrams(tokens)
    return matched.select("theme", "term").distinct().select("theme", F.explode(items).alias("item")).groupBy(
        "theme", "item").agg(F.count(F.lit(1)).alias("n"))


def top_items(counts: DataFrame, k: int, at_least: int = 1) -> DataFrame:
    w = Window.partitionBy("theme").orderBy(F.col("n").desc(), "item")
    return counts.where(F.col("n") >= at_least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def rule_tokens(book: RuleBook) -> dict[str, list[str]]:
    """Upper-case runs of three or more letters or digits in the patterns of each theme."""
    return {
        r.name: sorted({t for p in (*r.canonical, *r.positive) for t in re.findall("[A-Z0-9]{3,}", p.regex.upper())})
        for r in book.rules}


def suggest_synonyms(matched: DataFrame, book: RuleBook, k: int = 5) -> DataFrame:
    """Frequent tokens of a theme that its patterns do not know yet."""
    per = matched.select("theme", "term").distinct().groupBy("theme").agg(F.count(F.lit(1)).alias("_terms"))
    counts = count_tokens(matched).join(per, "theme")
    known = F.lit(False)
    for name, tokens in rule_tokens(book).items():
        if tokens:
            known = F.when(F.col("theme") == name, F.col("item").isin(tokens)).otherwise(known)
    fresh = counts.where(~known & ~F.col("item").isin(GENERIC + BARRED)).where(
        F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("_terms") * 0.12)))
    return top_items(fresh.select("theme", "item", "n"), k)


def library_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("theme", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def unmatched_seeds(matched: DataFrame, book: RuleBook) -> DataFrame:
    """Seed set names of the rules that matched their theme nowhere."""
    spark = matched.sparkSession
    seeds = [(r.name, s) for r in book.rules for s in sorted(set(r.seed_sets))]
    want = spark.createDataFrame(seeds, "theme string, term string")
    return want.join(matched.select("theme", "term").distinct(), ["theme", "term"], "left_anti")


def audit(terms: DataFrame, book: RuleBook, k: int = 5) -> dict[str, DataFrame]:
    m = matched_terms(terms, book)
    return {
        "matched": m.select("theme", "term").distinct().groupBy("theme").agg(F.count(F.lit(1)).alias("matched_sets")),
        "missing_seeds": unmatched_seeds(m, book),
        "top_tokens": top_items(count_tokens(m), k),
        "top_bigrams": top_items(count_tokens(m, "bigram"), k, at_least=2),
        "suggested_synonyms": suggest_synonyms(m, book, k),
        "library_breakdown": library_counts(m),
    }
