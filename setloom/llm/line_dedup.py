"""Line dedup by site-relative frequency, in column expressions alone.

Pages are grouped by host. A line with a visible character is boilerplate of its host if at least ``min_pages`` of the
host's pages have it and these are more than ``max_ratio`` of all its pages. Boilerplate lines are dropped from the pages
of that host, except where they make up more than ``max_loss`` of a page's characters: such a page is a copy, which is not
for this operator to empty. With ``max_loss`` None no page is exempt, and copies are told by what they are: pages and lines
count once per distinct text of the host, so copies of one text are no frequency. Lines are told apart by their MD5; a line
counts once per page.

A host has at most (mean lines per page / ``max_ratio``) boilerplate lines, so they fit in one row per host. These rows
are broadcast up to ``BROADCAST_LINES`` lines in all; beyond that the pages are dealt by host and salt and joined. Counts
are aggregated before they move, so a host with a third of all pages is no hot spot.

A null text stays null and has no lines; a null host is a host of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import own_names

BROADCAST_LINES = 200_000
SALTS = 64

# Elements that begin or end a line of a web page.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "tbody", "td", "th", "thead", "title", "tr", "ul",
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")\b[^>]*>"
TAGS = r"<[^>]*>"
BLANKS = r"[ \t\r]*\n[ \t\r\n]*"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"


def html_lines(html: Column) -> Column:
    """Visible text of a page, one block element a line."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), BREAKS, "\n"), TAGS, "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(text, BLANKS, "\n")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _visible(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) != ""


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float, min_pages: int,
                distinct_texts: bool = False) -> DataFrame:
    """``_host, _bad``: the keys of each host's boilerplate lines."""
    named = (F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("_host"), F.col(f"`{host}`").isNull().alias("_no_host"))
    same = [F.xxhash64(F.col(f"`{text}`")).alias("_same")] if distinct_texts else []
    lines = pages.select(*named, *same, F.explode(
        F.array_distinct(F.filter(F.split(F.col(f"`{text}`"), "\n"), _visible))).alias("_line"))
    lines = lines.select("_host", "_no_host", *(["_same"] if same else []), F.unhex(F.md5(F.col("_line"))).alias("_key"))
    counts = pages.select(*named, *same)
    if same:
        lines, counts = lines.distinct(), counts.distinct()
    counted = lines.groupBy("_host", "_no_host", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    totals = counts.groupBy("_host", "_no_host").agg(F.count(F.lit(1)).alias("_all"))
    frequent = counted.join(totals, ["_host", "_no_host"]).where(F.col("_n") > F.col("_all") * max_ratio)
    return frequent.groupBy("_host", "_no_host").agg(F.sort_array(F.collect_list("_key")).alias("_bad"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", max_ratio: float = 0.02, min_pages: int = 5,
                     max_loss: float | None = 0.5) -> DataFrame:
    """All rows, with boilerplate lines gone from ``text``, and ``n_lines`` and ``n_dropped`` (long)."""
    kept = own_names(pages, "n_lines", "n_dropped", "_host", "_no_host", "_bad", "_lines", "_left")
    bad = cut_lineage(boilerplate(kept, host, text, max_ratio, min_pages, max_loss is None))
    size = bad.agg(F.sum(F.size("_bad"))).first()[0] or 0
    keyed = kept.withColumns({"_host": F.coalesce(F.col(f"`{host}`"), F.lit("")), "_no_host": F.col(f"`{host}`").isNull()})
    if size <= BROADCAST_LINES:
        found = keyed.join(F.broadcast(bad), ["_host", "_no_host"], "left")
    else:
        salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)).cast("int"))
        found = dealt.join(salted, ["_host", "_no_host", "_salt"], "left").drop("_salt")
    lines = F.split(F.col(f"`{text}`"), "\n")
    names = [F.col(f"`{c}`") for c in kept.columns]
    found = found.select(*names, "_bad", lines.alias("_lines"))
    left = F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(F.filter(
        "_lines", lambda x: ~_visible(x) | ~F.array_contains(F.col("_bad"), F.unhex(F.md5(x)))))
    found = found.select(*names, "_lines", left.alias("_left"))
    if max_loss is not None:
        short = F.length(F.array_join("_left", "\n")) < F.length(F.col(f"`{text}`")) * (1 - max_loss)
        found = found.select(*names, "_lines", F.when(short, F.col("_lines")).otherwise(F.col("_left")).alias("_left"))
    return found.withColumns({
        text: F.array_join("_left", "\n"), "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long"),
    }).drop("_lines", "_left")
