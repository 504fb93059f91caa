"""One small study through the complete run, with supplied claims, answers and reviews."""
import json

import pytest
from pyspark.sql import functions as F

from setloom.operators import linking as lk, report as rp, verify as vf
from setloom.params import LinkSettings
from setloom.plans.linking import run_linking
from setloom.sources import artefacts as art
from setloom.sources.forms import expectations, parse_forms
from setloom.sources.rules import parse_rules

BOOK = parse_rules({"themes": [
    {"name": "Cell cycle core", "priority": 80, "patterns": {"positive": [r"\bE2F\b", r"\bMYC\b"]}},
    {"name": "Interferon", "priority": 60, "patterns": {"positive": [r"\bIFN\b"]}},
    {"name": "Stress", "patterns": {"positive": [r"\bSTRESS\b"]}},
    {"name": "Adhesion", "patterns": {"positive": [r"\bADHESION\b"]}},
]})
FORM = """# form
Study ID: demo
Contrast: treated vs control
Known biology: interferon drives the change
- and more
Expected phenotypes: fewer cells
note: strange"""


@pytest.fixture(scope="module")
def inputs(spark):
    gsea = spark.createDataFrame([
        ("S", 0, "E2F targets", "H", 2.5, 0.001, 50, ["CDK1", "MCM2"]), ("S", 1, "MYC targets", None, 2.0, 0.01, 40, ["MCM2", "NPM1"]),
        ("S", 2, "IFN alpha", "H", 1.8, 0.02, 30, ["ISG15"]), ("S", 3, "stress up", None, -1.5, 0.03, 20, ["HSPA1A"]),
        ("S", 4, "adhesion", None, -2.2, 0.02, 20, ["ITGB1"]), ("S", 5, "weak", None, 1.0, 0.6, 20, [])],
        "study_id string, rec_ord long, term string, source string, nes double, q_value double, size int, leading_edge array<string>")
    helpers = spark.createDataFrame([
        ("S", 0, "Cycle cells", "celltype", None, 2.0, 0.01, "UP", 10, "HALLMARK_E2F_TARGETS"), ("S", 1, "FOXM1", "tf_family", "FOX-family", 1.5, 0.02, "UP", 10, None),
        ("S", 2, "B cell", "celltype", None, 1.2, 0.03, "UP", 10, None), ("S", 3, "Stroma", "celltype", None, -1.9, 0.01, "DOWN", 10, "HALLMARK_STRESS")],
        "study_id string, ord long, helper_name string, helper_class string, tf_family string, nes double, q_value double, direction string, size int, top_hallmark string")
    lines = spark.createDataFrame([("S", i, v) for i, v in enumerate(FORM.split("\n"))], "study_id string, line_no int, value string")
    return gsea.cache(), helpers.cache(), parse_forms(lines)


def item(batch, order, theme, helper, **more):
    base = dict(study_id="S", batch_id=batch, item_ord=order, theme_id=theme, helper_name=helper, helper_class=None, direction=None,
                function_phrases=[" drives "], rationale="because", confidence=None, helper_top_hallmark=None)
    return tuple((base | more).values())


SCHEMA = ("study_id string, batch_id int, item_ord long, theme_id string, helper_name string, helper_class string, direction string, "
          "function_phrases array<string>, rationale string, confidence string, helper_top_hallmark string")


@pytest.fixture(scope="module")
def run(spark, inputs):
    gsea, helpers, forms = inputs
    items = spark.createDataFrame([
        item(1, 0, "up_1_cell-cycle-core", "Cycle cells", confidence="HIGH"), item(1, 1, "up_9_unknown", "FOXM1"),
        item(1, 2, "up_1_cell-cycle-core", "FOXM1", direction="down"), item(1, 3, "up_1_cell-cycle-core", "B cell"),
        item(1, 4, "up_1_cell-cycle-core", "Cycle cells", rationale="a longer reason")], SCHEMA)
    answers = spark.createDataFrame([
        ("S", 0, '```json\n' + json.dumps({"claims": [{"claim_id": "claim_0", "evidence": ["one", {"text": [" two "]}], "predictions": "x", "alternative": "this would contradict it"}]}) + '\n```'),
        ("S", 1, json.dumps([{"claim_id": "claim_1", "snippets": [], "missing_or_conflicting": "none"}])), ("S", 2, "no json")],
        "study_id string, answer_ord int, body string")
    reviews = spark.createDataFrame([("S", 0, None, "up_1_cell-cycle-core", "B cell", "Supported", "fine", None, None, None)],
        "study_id string, review_ord int, claim_id string, theme_id string, helper_name string, verdict string, verdict_reason string, alternative string, gaps string, predictions array<string>")
    return run_linking(gsea, helpers, forms, BOOK, LinkSettings(), items, answers, reviews)


def test_form_lines(inputs):
    rows = [(r["key"], r["line"]) for r in inputs[2].orderBy("ord").collect()]
    assert rows == [
        ("Study_ID", "demo"), ("Contrast", "treated vs control"), ("Known_Biology", "interferon drives the change"), ("Known_Biology", "and more"),
        ("Expected_Phenotypes_or_Trends_(optional, describe expectations not mandates)", "fewer cells"),
        ("Expected_Phenotypes_or_Trends_(optional, describe expectations not mandates)", "note: strange")]
    assert expectations(inputs[2]).collect()[0]["expected"] == "fewer cells note: strange"


def test_candidate_themes(run):
    t = {r["theme_id"]: r for r in run["candidates"].collect()}
    assert set(t) == {"up_1_cell-cycle-core", "up_2_interferon", "down_1_adhesion", "down_2_stress"}
    assert t["up_1_cell-cycle-core"]["effect"] == pytest.approx(2.25) and t["up_1_cell-cycle-core"]["leading_edges"] == ["MCM2", "CDK1", "NPM1"]
    assert t["up_2_interferon"]["named_in_background"] and not t["down_2_stress"]["named_in_background"]


def test_claims_are_checked_injected_and_ordered(run):
    rows = run["evidence"].orderBy("claim_ord").collect()
    assert [(r["theme_id"], r["helper_name"], r["confidence"]) for r in rows] == [
        ("up_1_cell-cycle-core", "Cycle cells", "high"), ("up_1_cell-cycle-core", "B cell", "medium"),
        ("up_2_interferon", None, "medium"), ("down_1_adhesion", None, "medium"), ("down_2_stress", None, "medium")]
    assert [r["claim_id"] for r in rows] == [f"claim_{i}" for i in range(5)]
    first = rows[0]
    assert first["evidence_snippets"] == ["one", "two"] and first["predictions"] == ["x", "Replicate enhancer validation"]
    assert rows[1]["evidence_snippets"] == [
        "Cell cycle core UP shift tracks E2F targets, MYC targets and genes MCM2, CDK1, NPM1.",
        "Helper B cell reflects celltype activity supporting this response."] and rows[1]["used_fallback_snippets"]
    assert rows[2]["source"] == "fallback" and len(rows[2]["evidence_snippets"]) == 1


def test_conflicting_claim_is_swapped(run):
    rows = {(r["theme_id"], r["helper_name"]): r for r in run["claims"].collect()}
    swap = rows["up_1_cell-cycle-core", "FOXM1"]
    assert swap["verdict"] == "Partial" and swap["confidence"] == "low" and swap["function_phrases"] == ["tf_family program"]
    assert "Expectation: fewer cells note: strange" in swap["rationale"]
    other = rows["up_1_cell-cycle-core", "B cell"]
    assert (other["verdict"], other["verdict_reason"], other["confidence"]) == ("Supported", "fine", "high")
    note = run["notes"].collect()
    assert [(n["original_helper"], n["new_helper"], n["action"], n["reason"]) for n in note] == [
        ("Cycle cells", "FOXM1", "replacement", "background conflict")]
    assert rows["down_2_stress", None]["verdict"] == "Partial" and rows["down_2_stress", None]["confidence"] == "medium"


def test_selected_themes(run):
    t = run["themes"].orderBy("direction", "place").collect()
    assert [r["theme_id"] for r in t] == ["down_1_adhesion", "down_2_stress", "up_2_interferon", "up_1_cell-cycle-core"]
    assert [r["helper_mean_effect"] for r in t][3] == pytest.approx((1.5 + 1.2) / 2)
    thesis = {r["theme_id"]: r["thesis_place"] for r in run["thesis"].collect()}
    assert thesis == {"up_1_cell-cycle-core": 1, "up_2_interferon": 2, "down_1_adhesion": 1, "down_2_stress": 2}


def test_artefacts_come_back(spark, run, tmp_path):
    art.write_run(run, str(tmp_path))
    art.write_themes(run["candidates"], str(tmp_path))
    themes = art.read_themes(spark, str(tmp_path)).collect()
    assert len(themes) == 4 and {t["theme_id"] for t in themes} >= {"up_2_interferon"}
    claims = art.read_claims(spark, str(tmp_path))
    back = art.read_reviews(spark, str(tmp_path), claims)
    assert claims.count() == back.count() == run["claims"].count()
    box = art.evidence_box(run["claims"]).collect()
    assert all(len(r["prediction_2"]) > 0 for r in box) and {r["helper_name"] for r in box} >= {"theme_only"}


def test_figure_tables(run, inputs):
    themes, claims = run["themes"], run["claims"]
    links = rp.theme_helper_links(themes, claims, inputs[1], claims).collect()
    assert {(r["helper_name"], r["width"]) for r in links} == {("FOXM1", 2.6), ("B cell", 4.0)}
    assert [r["theme_id"] for r in rp.theme_magnitudes(themes, claims).collect()] == ["up_1_cell-cycle-core"]
    assert rp.verdict_counts(claims).collect()[0]["supported"] == 1
    assert rp.nes_consistency(themes).count() == 1
    assert sum(r["n"] for r in rp.prediction_flow(claims).collect()) == 10


def test_folded_choice_skips_used_helpers(spark, inputs):
    gsea, helpers, forms = inputs
    base = dict(study_id="S", claim_ord=0, theme_id="t", theme_label="T", helper_name="Cycle cells", helper_class="celltype", direction="UP",
                function_phrases=["p"], rationale="r", confidence="low", helper_top_hallmark=None, helper_effect=1.0, helper_q_value=0.1,
                claim_id="c", evidence_snippets=["a", "b"], alternative="opposite", gaps="", predictions=["p"], verdict="Supported", verdict_reason="v")
    rows = [base, base | {"claim_ord": 1, "helper_name": "B cell", "alternative": ""}, base | {"claim_ord": 2, "helper_name": "X"}, base | {"claim_ord": 3, "helper_name": "Y"}]
    schema = ("study_id string, claim_ord long, theme_id string, theme_label string, helper_name string, helper_class string, direction string, function_phrases array<string>, "
              "rationale string, confidence string, helper_top_hallmark string, helper_effect double, helper_q_value double, claim_id string, evidence_snippets array<string>, "
              "alternative string, gaps string, predictions array<string>, verdict string, verdict_reason string")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    themes = spark.createDataFrame([], "study_id string, theme_id string, label string, top_pathways array<struct<term:string>>, leading_edges array<string>")
    out, notes = lk.revise_claims(df, themes, helpers)
    got = [r["helper_name"] for r in out.orderBy("claim_ord").collect()]
    # 1: first unused but itself is FOXM1; 2: keeps its helper; 3: Cycle cells is free; 4: none is left.
    assert got == ["FOXM1", "B cell", "Cycle cells", None]
    assert [r["action"] for r in notes.orderBy("claim_ord").collect()] == ["replacement", "replacement", "downgraded_to_theme_only"]


def test_semantic_scores_equal_the_pairwise_sum(spark, inputs):
    helpers = inputs[1]
    themes = spark.createDataFrame([("S", "a", ["e2f", "targets", "cells"], True, -2.0), ("S", "b", ["stress"], False, 1.0)],
                                   "study_id string, theme_id string, theme_tokens array<string>, touches_background boolean, effect double")
    claims = spark.createDataFrame([("S", "a", "Cycle cells", "celltype", "HALLMARK_E2F_TARGETS"), ("S", "a", "zzz", "q", None), ("S", "a", None, "theme_only", None), ("S", "b", None, "theme_only", None)],
                                   "study_id string, theme_id string, helper_name string, helper_class string, helper_top_hallmark string")
    got = {r["theme_id"]: r["semantic_score"] for r in lk.semantic_scores(themes, claims, helpers).collect()}
    assert got["a"] == pytest.approx(10 + (3 + 1.5 * 3) + 1 + 2.5 + 3 * 3 + 0.2)
    assert got["b"] == pytest.approx(3 * 1 + 0.1)


def test_missing_theme_goes_to_the_best_overlap(spark):
    items = spark.createDataFrame([item(1, 0, None, "stress cells"), item(1, 1, None, "zzz"), item(1, 2, "kept", "x")], SCHEMA)
    batch = spark.createDataFrame([("S", 1, 1, "first", ["other"]), ("S", 1, 2, "second", ["stress"])],
                                  "study_id string, batch_id int, place int, theme_id string, theme_tokens array<string>")
    got = {r["item_ord"]: r["theme_id"] for r in lk.assign_themes(items, batch).collect()}
    assert got == {0: "second", 1: "first", 2: "kept"}


def test_support_texts(spark):
    claims = spark.createDataFrame([("S", "T", "UP", "B—Cell", None), ("S", "T", "DOWN", "b-cell", "Yes — thin"), ("S", "T", "UP", "none", None), ("S", "T", "SIDE", "b-cell", None)],
                                   "study_id string, theme string, direction string, cell_type string, background_flag string")
    effects = spark.createDataFrame([("S", 0, "B-CELL", 9.0, 0.9), ("S", 1, " b-cell ", 0.35, 0.01234)], "study_id string, ord int, cell_type string, effect_size double, q_value double")
    rows = {(r["direction"], r["cell_type"]): r for r in vf.decide(claims, effects).collect()}
    ok = rows["UP", "B—Cell"]
    assert (ok["decision"], ok["effect_size"], ok["q_value"], ok["reason"]) == ("Supported", "+0.35", "0.0123", "Effect +0.35, q=0.0123 meets thresholds.")
    bad = rows["DOWN", "b-cell"]
    assert bad["decision"] == "Refuted" and bad["reason"] == "Effect sign (+0.35) opposes DOWN with q=0.0123. Background note: thin."
    assert rows["UP", "none"]["q_value"] == "NA" and rows["SIDE", "b-cell"]["reason"] == "Unable to assess direction for claimed SIDE."


def test_support_rows_of_repeated_names_equal_their_sql(spark, tmp_path):
    """Of suppliers with one name, the later row counts in the query and in its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from setloom.workloads import claims_queries as cq

    spark.createDataFrame([(51, "Supplier#000000051", 9000.0, 1), (52, "Supplier#000000052", -7000.0, 2), (1051, "SUPPLIER#000000051", -5000.0, 3)],
                          "s_suppkey long, s_name string, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, "O", "A"), (2, "F", "R"), (3, "O", "N")], "l_suppkey long, l_linestatus string, l_returnflag string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in cq.support_rows(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(cq.ORACLES["support_rows"]).fetchall())
    assert [r[2:] for r in got if r[2].endswith("51")] == [("Supplier#000000051", "Refuted", "-0.50")]


def test_equal_labels_do_not_pair_all_claims_with_all_themes(spark):
    """Thirty thousand claims and themes of one label: a join of their words would have 1.8 billion rows."""
    n = 30_000
    themes = spark.range(n).selectExpr("'S' study_id", "1 batch_id", "id place", "concat('t', id) theme_id", "split('alpha beta', ' ') theme_tokens")
    items = spark.range(n).selectExpr("'S' study_id", "1 batch_id", "id item_ord", "if(id % 10 = 0, 'given', null) theme_id", "'beta alpha' helper_name",
                                      "if(id % 3 = 0, 'x', 'y') helper_class", "cast(null as string) helper_top_hallmark")
    got = lk.assign_themes(items, themes)
    assert got.columns == items.columns
    assert {(r[0], r[1]) for r in got.groupBy("theme_id").count().collect()} == {("given", n // 10), ("t0", n - n // 10)}


def test_claims_of_a_study_are_ordered_by_range(spark, monkeypatch):
    from setloom.operators import linking
    from setloom.workloads import claims_queries

    seen = []
    scan = linking.range_scan

    def watched(df, keys, *rest):
        seen.append(keys)
        return scan(df, keys, *rest)

    monkeypatch.setattr(linking, "range_scan", watched)
    rows = claims_queries.claim_priority(spark, "/root/testdata/sf0.001").where("helper_name is not null").collect()
    assert seen == [["study_id"]]
    by_study = {}
    for r in rows:
        by_study.setdefault(r["study_id"], []).append((r["claim_ord"], -abs(r["helper_effect"])))
    for found in by_study.values():
        found.sort()
        assert [n for n, _ in found] == list(range(1, len(found) + 1)) and [s for _, s in found] == sorted(s for _, s in found)


def test_only_claims_that_stay_look_for_helpers(spark):
    items = spark.createDataFrame([("s", 1, i, "t", "h", None, "", ["a"], None, None, None) for i in range(5)],
                                  "study_id string, batch_id int, item_ord int, theme_id string, helper_name string, helper_class string, "
                                  "direction string, function_phrases array<string>, rationale string, confidence string, helper_top_hallmark string")
    themes = spark.createDataFrame([("s", "t", "label", "UP")], "study_id string, theme_id string, label string, direction string")
    helpers = spark.createDataFrame([("s", "h", "DOWN", 1, "c", "m", 0.5, 0.1)],
                                    "study_id string, helper_name string, direction string, ord int, helper_class string, top_hallmark string, nes double, q_value double")
    out = lk.validate_claims(items, themes, helpers, 3)
    assert sorted((r.item_ord, r.helper_effect, r.helper_class) for r in out.collect()) == [(i, 0.5, "c") for i in range(3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Window [")
