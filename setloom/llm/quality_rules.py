"""Line-first quality rules, in column expressions alone.

Each line with a word is judged by itself:

* punctuation: it does not end in a closing mark, or more than a tenth of its word characters are symbols
  (``[#*$%&|<>]``), or more than a third of its words carry an exclamation mark (three at least);
* navigation: three or more separators stand alone between its words, a quarter of its words at least;
* boilerplate: it has one of the stock phrases of web pages.

Lines that fail are taken out. A document is rejected if it loses more than ``max_lost`` of its words, or by the base
rules: fewer than ``min_words`` words, or more than ``max_repeat_pct`` percent of its words inside repeated windows of
five words. Lines without a word are kept as they are. A null text counts as empty: it has no words and is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, own_names, sealed

# Stock phrases of web pages, in lower case.
STOCK_PHRASES = (
    "all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "we use cookies",
    "enable javascript", "click here", "read more", "sign up for", "subscribe to our", "share this", "lorem ipsum",
)
CLOSING = ".!?:;…。！？\"'”’»)]"
SEPARATORS = ("|", "›", "»", "•", "·", ">", "/", "-", "–", "—")
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("lost_words", "n_failed_lines", "base_failed", "kept")


def _word_list(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def _only(line: Column, inverse_class: str) -> Column:
    """How many characters of a line remain when all others are taken out."""
    return F.length(F.regexp_replace(line, inverse_class, ""))


def _judge(line: Column) -> Column:
    """A line (``t``), its words (``w``) and its symbols (``s``)."""
    return F.struct(line.alias("t"), _word_list(line).alias("w"), _only(line, "[^#*$%&|<>]+").alias("s"))


def _fails(x: Column) -> Column:
    words, n = x["w"], F.size(x["w"])
    last = F.right(F.element_at(words, -1), F.lit(1))
    loud = F.size(F.filter(words, lambda w: w.contains("!")))
    alone = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
    return (n > 0) & (
        ~F.contains(F.lit(CLOSING), last)
        | (x["s"] * 10 > F.length(F.regexp_replace(x["t"], SPACE, "")))
        | ((loud >= 3) & (loud * 3 > n))
        | ((alone >= 3) & (alone * 4 >= n))
        | x["t"].rlike("(?i)" + "|".join(STOCK_PHRASES)))


def _windows(words: Column) -> Column:
    """A 64-bit hash of each window of five words."""
    return F.when(F.size(words) < WINDOW + 1, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))


def _sorted_pairs(windows: str) -> Column:
    """Hashes in order with their places, so that equal ones are neighbours."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _marked(order: str) -> Column:
    """Places of the windows that occur twice or more."""
    pairs = F.col(order)
    kept = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
    return F.sort_array(F.transform(kept, lambda x: x["i"]))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` (long) and, as ``_lines``, the judged lines."""
    names = [F.col(f"`{c}`") for c in own_names(df, *COUNTS, *VERDICTS, "_lines").columns]
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = df.select(*names, F.transform(F.split(source, "\n"), _judge).alias("_judged"))
    step = step.select(*names, F.transform("_judged", lambda x: F.struct(
        x["t"].alias("t"), F.size(x["w"]).alias("n"), _fails(x).alias("f"))).alias("_lines"),
        F.flatten(F.col("_judged.w")).alias("_words"),
        F.aggregate("_judged", F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("n_symbols"))
    step = step.select("*", _windows(F.col("_words")).alias("_windows"))
    # Only a text with a repeated window pays for the sort.
    step = step.select("*", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows"))
                       .otherwise(F.array().cast("array<bigint>")).alias("_repeats"))
    step = step.select("*", _sorted_pairs("_repeats").alias("_order"))
    step = step.select("*", _marked("_order").alias("_marked"))
    worded = F.transform(F.filter("_lines", lambda x: x["n"] > 0), lambda x: x["t"])
    step = step.select("*", worded.alias("_worded"))
    return step.select(
        *names, "_lines", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        F.aggregate(
            "_marked", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("int").alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"]).alias("n_repeat_words"))


def apply_rules(df: DataFrame, text: str = "text", min_words: int = 10, max_repeat_pct: int = 20,
                max_lost: float = 0.5) -> DataFrame:
    """All rows with counts, ``base_failed``, ``kept`` and the text without its failing lines in ``text``.

    The text of a null row stays null. No row is dropped: filter on ``kept``.
    """
    step = measure(df, text)
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    lost = F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["f"], x["n"]).otherwise(0))
    failed = F.size(F.filter("_lines", lambda x: x["f"])).cast("long")
    clean = F.array_join(F.transform(F.filter("_lines", lambda x: ~x["f"]), lambda x: x["t"]), "\n")
    step = sealed(step).withColumns({"lost_words": lost, "n_failed_lines": failed, "base_failed": base})
    step = step.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * max_lost))
    return step.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), clean)).drop("_lines")
