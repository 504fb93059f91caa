"""Text expressions: term variants, tokens, slugs, locus strings, name families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Greek capitals and the Latin letters they fold to.
GREEK_ONE = "ΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΩ"
LATIN_ONE = "ABGDEZHIKLMNXOPRSTYO"
GREEK_TWO = {"Θ": "TH", "Φ": "PH", "Χ": "CH", "Ψ": "PS"}

# Words that carry no theme.
STOPWORDS = [
    "cell", "cells", "program", "programs", "signal", "signals", "pathway", "pathways",
    "response", "responses", "additional", "theme", "regulation", "regulatory",
]

# Name prefixes of transcription-factor families, tried in this order.
FAMILY_PREFIXES = [
    ("FOX", "FOX-family"), ("GATA", "GATA-family"), ("STAT", "STAT-family"), ("IRF", "IRF-family"),
    ("ETS", "ETS-family"), ("EOMES", "T-box-family"), ("TBX", "T-box-family"),
    ("NR", "Nuclear-receptor-family"), ("PPAR", "Nuclear-receptor-family"),
    ("RXR", "Nuclear-receptor-family"), ("RAR", "Nuclear-receptor-family"),
    ("SP1", "SP/KLF-family"), ("SP2", "SP/KLF-family"), ("SP3", "SP/KLF-family"),
    ("SP4", "SP/KLF-family"), ("KLF", "SP/KLF-family"), ("JUN", "AP-1-family"),
    ("FOS", "AP-1-family"), ("ATF", "AP-1-family"), ("MAF", "AP-1-family"), ("CEBP", "C/EBP-family"),
]
# Keywords tried after the prefixes. "AP-1" cannot occur once dashes are removed.
FAMILY_KEYWORDS = [
    ("AP-1", "AP-1-family"), ("BACH", "BTB-bZIP-family"), ("SMAD", "SMAD-family"),
    ("MYC", "MYC/MAX-family"), ("MAX", "MYC/MAX-family"), ("HOX", "HOX-family"),
]


def fold_upper(c: Column) -> Column:
    """Trimmed upper case with Greek letters folded to Latin."""
    out = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), GREEK_ONE, LATIN_ONE)
    for letter, pair in GREEK_TWO.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def text_variants(term: Column, source: Column | None = None, description: Column | None = None) -> dict[str, Column]:
    """The named text forms a theme pattern may target."""

    def spaced_of(raw: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(raw, "[-–—/_]+", " "), r"\s+", " "))

    raw = fold_upper(term)
    spaced = spaced_of(raw)
    underscored = F.translate(spaced, " ", "_")
    out = {
        "raw": raw,
        "spaced": spaced,
        "underscored": underscored,
        "compact": F.translate(underscored, "_", ""),
    }
    src = fold_upper(source) if source is not None else F.lit("")
    out["source_raw"] = src
    out["source"] = spaced_of(src)
    out["combined"] = F.trim(F.concat_ws(" ", F.nullif(out["source"], F.lit("")), F.nullif(spaced, F.lit(""))))
    out["description"] = spaced_of(fold_upper(description)) if description is not None else F.lit("")
    return out


def slug(label: Column) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(label, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("theme"))


def words(c: Column, shortest: int = 3) -> Column:
    """Lower-case alphanumeric words, in order, repeated as they occur."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: F.length(w) >= shortest)


def token_set(*parts: Column) -> Column:
    return F.array_distinct(F.concat(*[words(p) for p in parts]))


def drop_stopwords(tokens: Column) -> Column:
    return F.array_except(tokens, F.array(*[F.lit(w) for w in STOPWORDS]))


def slug_tokens(label: Column) -> Column:
    return F.filter(F.split(slug(label), "-"), lambda w: w != "")


def label_keywords(label: Column) -> Column:
    return drop_stopwords(F.array_union(slug_tokens(label), words(label)))


def theme_tokens(label: Column, collection: Column, terms: Column, genes: Column) -> Column:
    """Token set of a theme: label, collection, slug, top terms, lower-cased genes."""
    base = F.array_union(
        F.array_union(token_set(label, collection), drop_stopwords(slug_tokens(label))),
        F.array_union(F.flatten(F.transform(terms, lambda t: words(t))), F.transform(genes, lambda g: F.lower(g))),
    )
    marks = F.array(F.lit("emt"), F.lit("adhesion"), F.lit("ecm"))
    extra = F.array(F.lit("mesenchymal"), F.lit("mesenchyme"))
    wide = F.when(F.arrays_overlap(base, marks), F.array_union(base, extra)).otherwise(base)
    return drop_stopwords(wide)


def upper_tokens(c: Column) -> Column:
    """Upper-case runs of letters and digits."""
    return F.regexp_extract_all(F.upper(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))


def tf_family(name: Column) -> Column:
    cleaned = F.upper(F.replace(F.translate(name, "-_", ""), F.lit("::"), F.lit("")))
    out = F.lit(None).cast("string")
    for word, family in reversed(FAMILY_KEYWORDS):
        out = F.when(F.contains(cleaned, F.lit(word)), family).otherwise(out)
    for prefix, family in reversed(FAMILY_PREFIXES):
        out = F.when(F.startswith(cleaned, F.lit(prefix)), family).otherwise(out)
    return out


def helper_class(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return (
        F.when(value.isNull() | (value == ""), "celltype")
        .when(low.isin("tf", "tfbs", "tf_family", "transcription_factor"), "tf_family")
        .when(low.isin("cell", "celltype", "cell_type", "lineage"), "celltype")
        .otherwise(low)
    )


def hallmark_phrase(hallmark: Column) -> Column:
    """Readable phrase of a hallmark set name; empty gives NULL."""
    bare = F.regexp_replace(F.nullif(hallmark, F.lit("")), "^(?i)HALLMARK_", "")
    return title_case(F.replace(bare, F.lit("_"), F.lit(" ")))


def title_case(c: Column) -> Column:
    """Capital at every start of a run of letters, lower case elsewhere."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def split_list(c: Column) -> Column:
    """Comma list -> distinct trimmed non-empty members; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def normal_label(c: Column) -> Column:
    """Lower case, dashes folded, blanks squeezed."""
    low = F.regexp_replace(F.lower(F.trim(c)), "[—–]", "-")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def bare_chrom(c: Column) -> Column:
    bare = F.regexp_replace(c, "^(?i)chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def normal_chrom(c: Column, style: str = "chr") -> Column:
    return F.concat(F.lit("chr"), bare_chrom(c)) if style == "chr" else bare_chrom(c)


def kept_chrom(c: Column, sex: bool = False) -> Column:
    pattern = "^([0-9]+|X|Y|MT)$" if sex else "^[0-9]+$"
    return bare_chrom(c).rlike(pattern)


# Fixed value: accepted locus strings, chrom:pos or chrom:start-end.
LOCUS_PATTERN = r"^(chr)?([0-9]+|X|Y|MT|M)[:_](\d+)(?:-(\d+))?$"


def parse_locus(c: Column, pattern: str = LOCUS_PATTERN) -> Column:
    """struct(chrom, start, end) of a locus string, NULL where it does not match."""
    start = F.regexp_extract(c, pattern, 3).try_cast("long")
    end = F.nullif(F.regexp_extract(c, pattern, 4), F.lit("")).try_cast("long")
    parsed = F.struct(
        F.regexp_extract(c, pattern, 2).alias("chrom"), start.alias("start"), F.coalesce(end, start).alias("end"))
    return F.when(c.rlike(pattern), parsed)


def split_locus(c: Column) -> Column:
    """struct(chrom, start, end) of a matrix row name ``chrom:start-end``; NULL if malformed."""
    parts = F.split(c, r"[:\-]")
    s, e = F.get(parts, 1).try_cast("long"), F.get(parts, 2).try_cast("long")
    ok = s.isNotNull() & e.isNotNull() & (F.get(parts, 0) != "")
    return F.when(ok, F.struct(F.get(parts, 0).alias("chrom"), s.alias("start"), e.alias("end")))


def require_locus(c: Column) -> Column:
    """As ``split_locus``; a malformed name fails the job and is named in the error."""
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.coalesce(split_locus(c), F.raise_error(F.concat(F.lit("row names must read chrom:start-end: "), c))))
