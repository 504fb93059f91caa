"""The pipeline's line dedup leaves no page out, and empties no copies."""
import corpus_pipeline
from setloom.llm import line_dedup

SF = "/root/testdata/sf0.001"
MENU = "Home and all of the other sections of this site, with the imprint and the terms of use"


def test_boilerplate_goes_from_every_document(spark, documents):
    texts = [f"{MENU}\nshort {k}" for k in range(8)] + [f"{MENU}\n" + f"word{k} " * 60 for k in range(8)] + [MENU, None, ""]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate_lines(spark, documents(texts), SF).collect()}
    assert got == {k: None if t is None else t.replace(f"{MENU}\n", "").replace(MENU, "") for k, t in enumerate(texts)}


def test_copies_are_not_emptied(spark, documents):
    copy = "A text of its own.\nIt was taken twelve times.\nAnd it stays."
    texts = [copy] * 12 + [f"{MENU}\npage {k}" for k in range(6)]
    rows = line_dedup.drop_boilerplate(documents(texts), "source", max_loss=None).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [copy] * 12 + [f"page {k}" for k in range(6)]
    assert [r.n_dropped for r in rows] == [0] * 12 + [1] * 6
    assert line_dedup.drop_boilerplate(documents([]), "source", max_loss=None).count() == 0
