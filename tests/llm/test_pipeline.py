"""The stages in turn, each held against its own input."""
import corpus_pipeline
from setloom.llm import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.where("n_chars <> length(text)").count() == 0
        if name == "quality_rules":
            assert kept[0] == {r.doc_id for r in quality_rules.apply_rules(before).where("kept").collect()}
    assert kept[0] == kept[1] and kept[3] == kept[4] and kept[2] <= kept[1] and kept[3] <= kept[2]
    assert docs.where("not round_trip or n_tokens <> size(token_ids)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept[-1]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break
