import pytest
from pyspark.sql import functions as F

from setloom.functions import text as tx
from setloom.operators import audit, themes as th
from setloom.operators.prefilter import split_directions
from setloom.params import LinkSettings
from setloom.sources.rules import parse_rules

BOOK = parse_rules({
    "defaults": {"negative_targets": ["spaced"]},
    "themes": [
        {"name": "Alpha", "priority": 80, "seed_sets": ["A_ONE", "A_TWO"],
         "patterns": {"canonical": [{"pattern": r"\\bA_ONE\\b", "targets": "underscored"}], "positive": [r"\bIFN(?:A|ALPHA)\b"], "negative": ["STOP"]}},
        {"name": "Beta", "contributions": {"secondary": [{"theme": "Alpha", "weight": 0.5}, {"theme": "Gamma", "weight": 0.25}]},
         "patterns": {"positive": [{"pattern": "BETA", "weight": 2.0}]}},
    ],
})


def test_rule_weights(spark):
    df = spark.createDataFrame([("a-one",), ("xa one ifn-alpha",), ("stop a one",), ("ifnα beta",), ("β-eta",), ("nothing",)], "term string")
    got = {}
    for r in th.match_themes(df, BOOK, "term").collect():
        got.setdefault(r["term"], {})[r["theme"]] = r["weight"]
    assert got == {
        "a-one": {"Alpha": 3.75},
        "ifnα beta": {"Alpha": 2.0, "Beta": 2.0, "Gamma": 0.5},
    }


def test_rule_documents_are_checked():
    with pytest.raises(ValueError):
        parse_rules({"themes": [{"id": "x"}]})
    with pytest.raises(ValueError):
        parse_rules({"themes": [{"name": "x", "patterns": {"positive": [3]}}]})
    assert BOOK.priority_of("Gamma") == 50 and BOOK.rules[0].canonical[0].regex == r"\bA_ONE\b"


def test_total_cap_equals_dropping_one_by_one(spark):
    cases = [(u, d, c) for u in range(0, 6) for d in range(0, 6) for c in range(1, 11)]
    rows = []
    for u, d, c in cases:
        for side, n in (("UP", u), ("DOWN", d)):
            rows += [(f"{u}_{d}_{c}", side, i, c, float((i * 7) % 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "study_id string, direction string, theme_pos int, cap int, effect double")
    for c in range(1, 11):
        got = {}
        for r in th.cap_total(df.where(F.col("cap") == c), c).collect():
            got.setdefault(r["study_id"], set()).add((r["direction"], r["theme_pos"]))
        for u, d, cc in cases:
            if cc != c:
                continue
            keep = {"UP": [(i, float((i * 7) % 4)) for i in range(u)], "DOWN": [(i, float((i * 7) % 4)) for i in range(d)]}
            while len(keep["UP"]) + len(keep["DOWN"]) > c:
                side = "UP" if len(keep["UP"]) >= len(keep["DOWN"]) and keep["UP"] else "DOWN"
                keep[side].pop(min(range(len(keep[side])), key=lambda i: keep[side][i][1]))
            assert got.get(f"{u}_{d}_{c}", set()) == {(s, i) for s in keep for i, _ in keep[s]}


def rows_of(spark, items):
    return spark.createDataFrame([("S", i, *x) for i, x in enumerate(items)],
                                 "study_id string, rec_ord long, term string, source string, nes double, q_value double, size int, leading_edge array<string>")


def test_unmatched_terms_fill_places_and_join_the_last_theme(spark):
    rows = rows_of(spark, [
        ("beta one", "K", 2.0, 0.01, 10, ["g1", "g2"]), ("beta two", None, 3.0, 0.02, 10, ["g2", "g3"]),
        ("odd five", None, 5.0, 0.01, 10, ["g9"]), ("odd four", "L", 4.0, 0.01, 10, []), ("odd six", None, 6.0, 0.01, 10, [])])
    s = LinkSettings(theme_cap=4)
    t = th.build_themes(split_directions(rows, s), BOOK, s).orderBy("theme_pos").collect()
    # Alpha ranks first by priority, then Beta and Gamma; one place is left for the best odd term.
    assert [r["label"] for r in t] == ["Alpha", "Beta", "Gamma", "Additional UP signal 1: odd six"]
    assert t[0]["theme_id"] == "up_1_alpha" and t[0]["effect"] == pytest.approx(2.5) and t[0]["q_value"] == 0.01
    assert t[0]["collection"] == "K" and t[0]["leading_edges"] == ["g2", "g3", "g1"]
    assert [p["term"] for p in t[3]["top_pathways"]] == ["odd six", "odd five", "odd four"] and t[3]["collection"] == "L"


def test_direction_back_fill(spark):
    rows = rows_of(spark, [("a", None, -1.0, 0.4, 1, []), ("b", None, -2.0, 0.3, 1, []), ("c", None, 0.0, 0.001, 1, []), ("d", None, 1.0, 0.01, 1, [])])
    got = split_directions(rows, LinkSettings(gsea_min_per_direction=1)).collect()
    assert {(r["direction"], r["term"]) for r in got} == {("DOWN", "b"), ("UP", "d")}


def test_audit_tables(spark):
    terms = spark.createDataFrame([("A_ONE", "x"), ("NEW_BETA", "x"), ("NEW_BETA_2", "y"), ("NEW_BETA", "y")], "term string, source string")
    out = audit.audit(terms, BOOK)
    assert {(r["theme"], r["term"]) for r in out["missing_seeds"].collect()} == {("Alpha", "A_TWO")}
    assert {r["theme"]: r["matched_sets"] for r in out["matched"].collect()} == {"Alpha": 3, "Beta": 2, "Gamma": 2}
    assert {(r["theme"], r["item"], r["n"]) for r in out["suggested_synonyms"].collect()} >= {("Beta", "NEW", 2)}
    assert ("Beta", "NEW BETA", 2) in {(r["theme"], r["item"], r["n"]) for r in out["top_bigrams"].collect()}
    assert {(r["theme"], r["source"], r["n"]) for r in out["library_breakdown"].collect()} >= {("Beta", "y", 2), ("Beta", "x", 1)}


def test_text_helpers(spark):
    df = spark.createDataFrame([("chr12:5-9",), ("X_7",), ("M:3",), ("chr1:x",)], "v string")
    got = [r[0] for r in df.select(tx.parse_locus(F.col("v")))  .collect()]
    assert [tuple(x) if x else None for x in got] == [("12", 5, 9), ("X", 7, 7), ("M", 3, 3), None]
    one = spark.range(1).select(
        tx.normal_chrom(F.lit("CHRm"), "nochr"), tx.normal_chrom(F.lit("M")), tx.kept_chrom(F.lit("chrX")), tx.kept_chrom(F.lit("chrX"), True),
        tx.slug(F.lit("--A b!")), tx.slug(F.lit("§§")), tx.hallmark_phrase(F.lit("hallmark_TNFA_via_NFKB2B")), tx.helper_class(F.lit(" TFBS ")),
        tx.tf_family(F.lit("nr3-c1")), tx.tf_family(F.lit("cMyc")), tx.tf_family(F.lit("zzz")),
        tx.theme_tokens(F.lit("EMT / ECM"), F.lit(None).cast("string"), F.array(F.lit("cell Cycle")), F.array(F.lit("TP53"))),
    ).collect()[0]
    assert one[0] == "m" and one[1] == "chrMT" and one[2] is False and one[3] is True
    assert one[4:7] == ("a-b", "theme", "Tnfa Via Nfkb2B") and one[7:11] == ("tf_family", "Nuclear-receptor-family", "MYC/MAX-family", None)
    assert set(one[11]) == {"emt", "ecm", "cycle", "tp53", "mesenchymal", "mesenchyme"}
