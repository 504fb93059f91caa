"""The operators made of column expressions: quality rules, line dedup, license scan."""
import re

import pytest
from pyspark.sql import functions as F

from setloom.llm import licenses, line_dedup, quality_rules

GOOD = "This is a sentence with some ten words or rather more."
ALSO = "Here another one goes on for about a dozen different words until its end."


def test_counts_against_plain_python(spark, documents):
    texts = [None, "", " \n\t ", "a b c d e", "one two three four five six", "x " * 40, "a#b *c\n\na#b *c\n| $ %",
             "the quick brown fox jumps over the quick brown fox jumps again", GOOD * 30, "ü é ñ \x0b z"]
    rows = quality_rules.measure(documents(texts).withColumnRenamed("lang", "N_WORDS")).drop("_lines").collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


@pytest.mark.parametrize("line", [
    "no closing mark here", "a### b$$$ c%%% d&&& e***.", "ALL!! LOUD!! WORDS!! here.", "home | news | about | more.",
    "Company 2020. All rights reserved."])
def test_failing_lines_go(spark, documents, line):
    row = quality_rules.apply_rules(documents([f"{GOOD}\n{line}\n\n{ALSO}"])).first()
    assert row.kept and row.n_failed_lines == 1 and row.text == f"{GOOD}\n\n{ALSO}"


def test_verdicts(spark, documents):
    lost = "\n".join([GOOD, *(f"junk{k} without{k} end{k} and{k} so{k} on{k}" for k in range(9))])
    rows = quality_rules.apply_rules(documents([GOOD, lost, "Too short.", None, "a b c d e f. " * 9])).orderBy("doc_id")
    assert [(r.base_failed, r.kept) for r in rows.collect()] == [
        (False, True), (False, False), (True, False), (True, False), (True, False)]
    assert rows.where("kept").count() == 1 and rows.where("text is null").count() == 1
    assert quality_rules.apply_rules(documents([])).count() == 0


def test_filters_stay_above_the_expressions(spark, documents):
    plan = quality_rules.apply_rules(documents([GOOD])).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3


@pytest.mark.parametrize("broadcast", [True, False])
def test_boilerplate(spark, documents, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    body = "page {} has a text of its own that is long enough to stay in place"
    texts = [f"Menu\n{body.format(k)}\n\nMenu" for k in range(8)] + ["Menu", None, "", body.format(99)]
    docs = documents(texts).withColumnRenamed("n_chars", "N_LINES").unionAll(
        documents([f"Menu\n{body.format(k)}" for k in range(3)], first=50, source=None).withColumnRenamed("n_chars", "N_LINES"))
    rows = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, "source", max_ratio=0.3).collect()}
    assert len(rows) == len(texts) + 3
    for k in range(8):
        assert rows[k].text == f"{body.format(k)}\n" and (rows[k].n_lines, rows[k].n_dropped) == (4, 2)
    assert rows[8].text == "Menu" and rows[8].n_dropped == 0  # nothing else would be left
    assert rows[9].text is None and rows[9].n_lines == 0 and rows[10].text == ""
    assert rows[50].text.startswith("Menu\n")  # three pages are too few
    assert line_dedup.drop_boilerplate(documents([]), "source").count() == 0


def test_html_lines(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><p>a <b>b</b></p><script>x</script>\n<!-- c --><p>d &amp; e"
    df = spark.createDataFrame([(html, "HTTPS://A.b:80/x"), (None, None)], "html string, url string")
    got = df.select(line_dedup.html_lines(F.col("html")).alias("t"), line_dedup.host_of(F.col("url")).alias("h")).collect()
    assert got[0].t.strip("\n").split("\n") == ["T", "a b", "d & e"] and got[0].h == "a.b" and got[1].t is None


def test_licenses(spark, documents):
    templates = spark.createDataFrame(licenses.TEMPLATES, "template string, body string")
    by_name = dict(licenses.TEMPLATES)
    filler = " ".join(f"word{k}" for k in range(300))
    texts = [None, "", "short one", filler] + [f"{filler} {body.upper()} {filler}" for body in by_name.values()]
    near = by_name["mit-grant"].split()
    near[20], near[45] = "changed", "too"  # 10 of 59 shingles differ
    far = near.copy()
    far[8] = far[30] = far[38] = far[52] = "other"
    texts += [f"{filler} {' '.join(near)}", f"{filler} {' '.join(far)}", texts[4]]
    docs = documents(texts).withColumnRenamed("lang", "Template")
    found = licenses.scan(docs, templates).collect()
    names = {}
    for r in found:
        names.setdefault(r.doc_id, set()).add(r.template)
    n = len(by_name)
    for k, name in enumerate(by_name):
        assert name in names[4 + k]
    assert not set(range(4)) & set(names) and "mit-grant" in names[4 + n] and 5 + n not in names and 6 + n in names
    assert all(r.containment >= 0.8 for r in found)
    assert licenses.scan(documents([]), templates).count() == 0
    assert licenses.scan(docs, templates.limit(0)).count() == 0
