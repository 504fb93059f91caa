import pytest
from pyspark.sql import functions as F

from setloom.plans import enrichment as plans
from setloom.sources import forms, gmt, tables
from setloom.streaming.incremental import pending_samples


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_set_file(spark, tmp_path):
    p = write(tmp_path / "a.gmt", "# head\r\nOne:x\td\ta\tb\tb\r\n#Two\td\tc\té\tz\r\nshort\td\ta\nfew\td\nTwo\td\tq\tr\ts\t\n", "latin1")
    rows = gmt.read_sets(spark, p, 2)
    got = {}
    for r in rows.orderBy("set_ord", "member_ord").collect():
        got.setdefault((r["set_ord"], r["set_name"]), []).append(r["member"])
    assert got == {(1, "One:x"): ["a", "b", "b"], (2, "#Two"): ["c", "e", "z"], (3, "Two"): ["q", "r", "s"]}
    lines = [r["value"] for r in gmt.set_lines(rows).orderBy("set_ord").collect()]
    assert lines[0] == "One\tx\ta\tb\tb" and lines[2] == "Two\t.\tq\tr\ts"
    gmt.write_sets(rows, str(tmp_path / "out"))
    back = gmt.read_sets(spark, str(tmp_path / "out"), 1)
    assert back.count() == rows.count()
    both = gmt.read_sets(spark, [p, write(tmp_path / "b.gmt", "New\td\ta\tb\n")], 2)
    assert [r["set_name"] for r in both.select("set_ord", "set_name").distinct().orderBy("set_ord").collect()][-1] == "New"


def test_library(spark, tmp_path):
    p = write(tmp_path / "kegg.v1.gmt", "A_SET\t desc\t" + "\t".join(f"g{i}" for i in range(30)) + "\nonly\n\nB_SET\t\n")
    rows = {r["term"]: r for r in gmt.read_library(spark, p).collect()}
    assert set(rows) == {"A_SET"} or set(rows) == {"A_SET", "B_SET"}
    assert rows["A_SET"]["source"] == "kegg.v1" and rows["A_SET"]["size"] == 30 and len(rows["A_SET"]["leading_edge"]) == 20


def test_counts_and_metadata(spark, tmp_path):
    c = tables.read_counts(spark, write(tmp_path / "c.tsv", "id\ts.1\ts2\nf1\t3\t0\nf2\t0\t7\n"))
    assert {(r["feature_id"], r["sample_id"], r["value"]) for r in c.collect()} == {("f1", "s.1", 3.0), ("f2", "s2", 7.0)}
    m = tables.read_samples(spark, write(tmp_path / "m.csv", "sample,source_name\ns.1,WT cells\ns2,KO cells\n"))
    assert {r["source_name"] for r in m.collect()} == {"WT cells", "KO cells"}
    with pytest.raises(ValueError, match="source_name"):
        tables.read_samples(spark, write(tmp_path / "bad.csv", "sample,other\na,b\n"))
    tables.write_samples(m, str(tmp_path / "meta"))
    assert spark.read.option("header", True).csv(str(tmp_path / "meta")).columns == ["Sample", "source_name", "group"]


def test_regions_and_annotation(spark, tmp_path):
    b = tables.read_regions(spark, write(tmp_path / "r.bed", "chr1\t0\t10\tg1\textra\nM\t5\t5\tg2\n")).collect()
    assert [(r["chrom"], r["start"], r["end"], r["id"], r["empty"]) for r in b] == [("chr1", 1, 10, "g1", False), ("M", 6, 5, "g2", True)]
    with pytest.raises(Exception, match="must be integers"):
        tables.read_regions(spark, write(tmp_path / "x.bed", "chr1\tx\t10\tg1\n")).collect()
    a = tables.read_annotation(spark, write(tmp_path / "a.tsv", "GHid\tchr\telement_start\telement_end\tregulatory_element_type\r\nG1\tchr1\t5\t9\tPromoter/Enhancer\r\nG2\t2\t1\t3\tEnhancer\r\n"), "chr").collect()
    assert [(r["id"], r["chrom"], r["regulatory_element_type"]) for r in a] == [("G1", "chr1", "Promoter/Enhancer"), ("G2", "chr2", "Enhancer")]
    g = tables.read_exons(spark, write(tmp_path / "g.gtf", '#!x\n1\th\tgene\t1\t9\t.\t+\t.\tgene_id "A";\n1\th\texon\t2\t5\t.\t-\t.\tgene_id "A"; exon_id "E1"; tag "u"; tag "v";\n')).collect()
    assert [(r["gene_id"], r["exon_id"], r["start"], r["end"], r["strand"]) for r in g] == [("A", "E1", 2, 5, "-")] and g[0]["attributes"]["tag"] == "u"


def test_result_tables(spark, tmp_path):
    p = write(tmp_path / "g.csv", '﻿Compare.List,NES,qValue,size,leadingEdge\n A ,1.5,0.01,10.0,"x, y,,z"\nB,NA,0.2,5,\nC,-1,,3,q\nD,2,oops,3,q\nE,-2,0.5,3,\n')
    rows = {r["term"]: r for r in tables.read_gsea(spark, p).collect()}
    assert set(rows) == {"A", "E"} and rows["A"]["leading_edge"] == ["x", "y", "z"] and rows["A"]["size"] == 10 and rows["E"]["leading_edge"] == []
    with pytest.raises(ValueError, match="size"):
        tables.read_gsea(spark, write(tmp_path / "h.csv", "term,NES,q_value\na,1,1\n"))
    names = tables.read_tf_names(spark, write(tmp_path / "tf.txt", "# c\nSTAT1\tx\n\nmyc\n"))
    h = tables.read_helpers(spark, write(tmp_path / "e.csv", "Helper,Class,score,qvalue,signed_qValue,direction\nStat1,cell,1.0,,3.5,\nb,,0,0.1,,\nc,,-1,0.2,,down\nd,,1,,,\n"), "S", names)
    got = {r["helper_name"]: r for r in h.collect()}
    assert set(got) == {"Stat1", "c"}
    assert got["Stat1"]["helper_class"] == "tf_family" and got["Stat1"]["tf_family"] == "STAT-family" and got["Stat1"]["q_from_signed"]
    assert got["c"]["direction"] == "DOWN" and got["c"]["helper_class"] == "celltype"


def test_enrichment_sink(spark, tmp_path):
    r = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "set_name string, leading_edge array<string>")
    assert {x["set_name"]: x["leading_edge"] for x in tables.enrichment_csv(r).collect()} == {"a": "x, y", "b": None}
    tables.write_enrichment(r, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2


def test_metrics_merge_by_id_and_resume(spark, tmp_path):
    root = str(tmp_path / "m")
    one = spark.createDataFrame([("s1", "f1", 1.5), ("s1", "f2", 0.0), ("s1", "f3", 2.0)], "sample_id string, feature_id string, value double")
    two = spark.createDataFrame([("s2", "f3", 4.0), ("s2", "f2", 0.0)], "sample_id string, feature_id string, value double")
    tables.write_metrics(one, root, "cpm")
    tables.write_metrics(two, root, "cpm")
    tables.write_metrics(one, root, "tpm")
    m = tables.read_metrics(spark, root)
    assert m.count() == 8
    wide = {r["Name"]: (r["s1"], r["s2"]) for r in tables.merge_metric(m, "cpm", ["s1", "s2"]).collect()}
    assert wide == {"f1": (1.5, 0.0), "f3": (2.0, 4.0)}
    todo = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    assert {r["sample_id"] for r in pending_samples(todo, m, ["cpm", "tpm"]).collect()} == {"s2", "s3"}


def test_forms_need_a_contrast(spark, tmp_path):
    write(tmp_path / "good.txt", "Contrast (case vs control): a vs b\nKey Questions:\n- why\n")
    assert {(r["study_id"], r["key"], r["line"]) for r in forms.read_forms(spark, str(tmp_path / "good.txt")).collect()} == {
        ("good", "Contrast", "a vs b"), ("good", "Key_Questions", "why")}
    write(tmp_path / "bad.txt", "Study ID: x\n")
    with pytest.raises(Exception, match="must name its contrast"):
        forms.read_forms(spark, str(tmp_path / "bad.txt")).collect()


def test_verification_table(spark, tmp_path):
    p = write(tmp_path / "v.txt", "theme | direction | cell | d | e | q | r\n---\nT | UP | B cell | Supported | +0.4 | 0.01 | ok\nshort | row\n")
    assert [(r["theme"], r["cell_type"], r["reason"]) for r in tables.read_verification(spark, p).collect()] == [("T", "B cell", "ok")]


def test_variant_inputs(spark):
    regions = spark.createDataFrame([("chr1", 1, 100, "g1", 0), ("chrX", 1, 50, "g2", 1), ("chrMT", 5, 9, "g3", 2)], "chrom string, start long, end long, id string, ord long")
    v = spark.createDataFrame([("rs5", "1", 60)], "rsid string, chrom string, pos long")
    text = spark.createDataFrame([("chr1:5",), ("1:90-120",), ("X:7",), ("M_6",), ("rs5",), ("junk",), ("",), (None,)], "input string")
    pairs = lambda df: {(r["input_id"], r["annotation_id"]) for r in df.collect()}
    assert pairs(plans.variants_to_regions(text, regions, v)) == {("chr1:5", "g1"), ("1:90-120", "g1"), ("rs5", "g1")}
    assert pairs(plans.variants_to_regions(text, regions, v, sex_chromosomes=True)) >= {("X:7", "g2"), ("M_6", "g3")}
    assert pairs(plans.variants_to_regions(text, regions, v, "rsid")) == {("rs5", "g1")}
    df = spark.createDataFrame([("chr1", 7), ("1", 500)], "CHR string, Pos long")
    assert pairs(plans.variants_to_regions(df, regions)) == {("chr1:7", "g1")}
    with pytest.raises(ValueError):
        plans.locate_variants(spark.createDataFrame([(1,)], "a int"))
    sets = spark.createDataFrame([("S", "a", "g1"), ("S", "a", "g2"), ("S", "b", "g3")], "study_id string, set_name string, member string")
    out = {r["set_name"]: (r["N"], r["M"], r["K"], r["x"]) for r in plans.variant_over_representation(text, regions, sets, v, draws=50).collect()}
    assert out == {"a": (3, 2, 1, 1), "b": (3, 1, 1, 0)}


def test_count_to_enrichment_run(spark):
    import numpy as np

    from setloom.params import Contrast

    rng = np.random.default_rng(3)
    mean = rng.integers(50, 400, 120)
    rows = []
    for j in range(6):
        lift = np.where(np.arange(120) < 20, 3.0 if j >= 3 else 1.0, 1.0)
        rows += [("S", f"f{i}", f"s{j}", float(v)) for i, v in enumerate(rng.poisson(mean * lift)) if v]
    counts = spark.createDataFrame(rows, "study_id string, feature_id string, sample_id string, value double")
    samples = spark.createDataFrame([("S", f"s{j}", "ko" if j >= 3 else "wt") for j in range(6)], "study_id string, sample_id string, grp string")
    members = [("S", 0, "up", f"f{i}") for i in range(20)] + [("S", 1, "flat", f"f{i}") for i in range(60, 90)]
    sets = spark.createDataFrame(members, "study_id string, set_ord int, set_name string, member string")
    out = plans.differential_enrichment(counts, samples, sets, Contrast("grp", "ko", "wt"), max_share=None, min_size=10, permutations=300)
    de = {r["feature_id"]: r for r in out["differential"].collect()}
    assert np.mean([de[f"f{i}"]["lfc"] for i in range(20)]) == pytest.approx(np.log2(3), abs=0.25)
    assert all(de[f"f{i}"]["padj"] < 0.01 for i in range(20)) and np.mean([de[f"f{i}"]["pvalue"] < 0.05 for i in range(20, 120)]) < 0.2
    e = {r["set_name"]: r for r in out["enrichment"].collect()}
    assert e["up"]["nes"] > 1 and e["up"]["p_value"] < 0.02 and e["up"]["p_value"] < e["flat"]["p_value"]


def test_quantification(spark):
    reads = spark.createDataFrame([("s", i, "1", 5 + i, 9 + i, "+") for i in range(4)] + [("s", 9, "1", 200, 210, "+")],
                                  "sample_id string, read_id long, chrom string, start long, end long, strand string")
    feats = spark.createDataFrame([("1", 1, 50, "f", "+"), ("1", 190, 239, "g", "+")], "chrom string, start long, end long, feature_id string, strand string")
    out = plans.quantify(reads, feats)
    tpm = {r["feature_id"]: r["value"] for r in out["unlog.tpm"].collect()}
    assert tpm == pytest.approx({"f": 8e5, "g": 2e5})
    rpkm = {r["feature_id"]: r["value"] for r in out["unlog.rpkm"].collect()}
    assert rpkm["f"] == pytest.approx(4 / 0.05 / 5e-6)


def test_lines_of_one_study_do_not_meet_in_one_window(spark, monkeypatch):
    from setloom.operators import scan
    from setloom.sources import gmt

    seen = []
    whole = scan.range_scan

    def watched(df, keys, *rest):
        seen.append(keys)
        return whole(df, keys, *rest)

    monkeypatch.setattr(gmt, "range_scan", watched)
    rows = [("/b" if i % 2 else "/a", i % 3, i, f"n{i}\td\tx{i}\ty") for i in range(200)]
    lines = spark.createDataFrame(rows, "file string, _block long, _seq long, value string").repartition(5)
    got = gmt.parse_sets(lines, 2).where("member_ord = 0").orderBy("set_ord").collect()
    assert seen == [["study_id"]]
    assert [(r["set_ord"], r["set_name"]) for r in got] == [(i + 1, f"n{s}") for i, (_, _, s, _) in enumerate(sorted(rows))]
