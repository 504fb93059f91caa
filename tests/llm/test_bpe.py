"""Encoding against the tokenizer library, and exact round trips."""
import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(PATH, public_tokenizers.PATTERN, cut_before_space=True)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts, vocabulary=VOCABULARY):
    sizes, ids = bpe.coder(vocabulary).encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at:at + n].tolist())
        at += n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(texts):
    work = bpe.coder(VOCABULARY)
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert work.decode(ids_array(ids)) == text.encode()


def ids_array(ids):
    import numpy as np
    return np.array(ids, np.int64)


def test_equals_the_library(library):
    random.seed(3)
    alphabets = ["ab", "aaaab", "abcdefg hij\n\t", "éàü漢字 ", "0123 ", "!-= ", "  \n　", "it's we'll "]
    texts = ["".join(random.choice(random.choice(alphabets)) for _ in range(random.choice([1, 9, 70, 400])))
             for _ in range(300)]
    for vocabulary in (VOCABULARY, bpe.Vocabulary(PATH, public_tokenizers.PATTERN)):
        assert encoded(texts, vocabulary) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces(library):
    random.seed(4)
    for text in ("a" * 5000, "ab" * 3000, "".join(random.choice("etaoin") for _ in range(8000)), " " * 3000, "=-" * 999):
        assert encoded([text]) == [library.encode_ordinary(text)]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 5)
    texts = ["one two three four", "five six seven eight nine", "one two"] * 3
    assert [encoded([t])[0] for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_frames(spark, documents, library):
    texts = ["Hello, world.", "", None, "Hello, world.", "x" * 70_000]
    docs = documents(texts).withColumnRenamed("lang", "decoded")
    rows = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    assert [r.token_ids for r in rows] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r.decoded) for r in rows] == [(t or "").encode() for t in texts]
    assert bpe.encode(documents([]), VOCABULARY).count() == 0


def test_unknown_id():
    with pytest.raises(ValueError):
        bpe.coder(VOCABULARY).decode(ids_array([10 ** 6]))


def test_bytes_of_the_same_pass(spark, documents):
    docs = documents(["a few words", None, "", "x  y\n z", "é漢字" * 50, "\x00\t "] + [f"word{k} and some" for k in range(40)])
    docs = docs.withColumn("Decoded", F.lit("old"))
    both = bpe.encode(docs, VOCABULARY, raw="decoded")
    two = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert sorted(both.select("doc_id", "token_ids", "decoded").collect()) == sorted(two.select("doc_id", "token_ids", "decoded").collect())
    # One worker a task: a second one would hold a second coder.
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_memory_of_the_coder_is_bounded():
    work = bpe.Coder(VOCABULARY)
    for k in range(0, 400_000, 20_000):
        work.encode([" ".join(f"w{i}q" for i in range(k, k + 20_000))])
        assert len(work.stretches.number) <= 100_000
