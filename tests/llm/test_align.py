"""Alignment against a walk over token spans, text by text."""
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from setloom.llm import align, workloads

PAIR = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def texts_of(n, seed=6):
    random.seed(seed)
    alphabets = ["ab", "etaoin shrdlu ", "éàü漢字 ", "0123 ", "!-=' ", "  \n　\t", "<|endoftext|> <s>"]
    made = ["".join(random.choice(random.choice(alphabets)) for _ in range(random.choice([1, 9, 90, 400]))) for _ in range(n)]
    return [None, "", " ", "  a", "x▁y", "nul\x00", "<|endoftext|> <s></s> <unk>", "the the the", "the the the", "y" * 20_000,
            "some words " * 3000] + made


def spans(pieces):
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def brute(texts):
    tokenizer = Tokenizer.from_file(PAIR.a)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PAIR.b)
    letters = align.byte_letters()
    docs, count = [], collections.Counter()
    for text in texts:
        docs.append(None)
        if not text:
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        a_bytes = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
                   for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        sa, sb = spans(a_bytes), spans(b_bytes)
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            i0, j0 = i, j
            while i < len(sa) and sa[i][1] <= end:
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                j += 1
            groups.append((a[i0:i], b[j0:j]))
        links, low = [], 0
        for k, (start, end) in enumerate(sa):
            while sb[low][1] <= start:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < end:
                links.append((a[k], b[j]))
                j += 1
        count.update(links)
        docs[-1] = len(a), len(b), len(groups), links, ";".join(
            ",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    most = collections.defaultdict(int)
    for (_, q), n in count.items():
        most[q] = max(most[q], n)
    return [(0,) * 6 + ("",) if d is None else (
        d[0], d[1], d[2], len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]),
        hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


NAMES = (*align.COUNTS, "n_best", "count_sum", "groups_sha256")


def test_sums_equal_a_walk_over_spans(spark, documents, monkeypatch):
    texts = texts_of(80)
    want = brute(texts)
    assert sum(w[0] == 0 for w in want) >= 3 and sum(w[0] > w[2] for w in want) > 20
    for limit in (align.BLOCK_BYTES, 300):
        monkeypatch.setattr(align, "BLOCK_BYTES", limit)
        got = align.link_sums(documents(texts).repartition(3), PAIR).orderBy("doc_id").collect()
        assert [tuple(r[n] for n in NAMES) for r in got] == want


def test_alignment_itself(spark, documents):
    texts = texts_of(30, seed=9)
    want = brute(texts)
    for r, w in zip(align.align(documents(texts), PAIR).orderBy("doc_id").collect(), want, strict=True):
        assert (len(r.a_ids), len(r.b_ids), len(r.a_group_ends), len(r.link_a)) == w[:4] and len(r.link_b) == w[3]
        a, b, groups = 0, 0, []
        for i, j in zip(r.a_group_ends, r.b_group_ends):
            groups.append(",".join(map(str, r.a_ids[a:i])) + "|" + ",".join(map(str, r.b_ids[b:j])))
            a, b = i, j
        assert not r.a_ids or hashlib.sha256(";".join(groups).encode()).hexdigest() == w[6]


def test_links_of_wide_slices():
    a, b = np.array([2, 5, 9, 10]), np.array([3, 6, 9, 10])
    cuts = align.group_ends(a, b)
    assert [c.tolist() for c in cuts] == [[3, 4], [3, 4]]
    left, right = align.expand_links(a, b, *cuts)
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 3)]


def test_edge_rows(spark, documents):
    docs = documents(["a b", "a b", None]).unionByName(documents(["a b"]).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumn("N_Links", F.lit("old")).withColumn("key", F.lit("k"))
    out = align.link_sums(docs, PAIR).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_links, r.count_sum, r.key) for r in out) == [
        (False, 0, 2, 6, "k"), (False, 1, 2, 6, "k"), (False, 2, 0, 0, "k"), (True, 0, 2, 6, "k")]
    assert align.link_sums(documents([]), PAIR).count() == 0 and align.align(documents([]), PAIR).count() == 0


def test_query(spark, documents, tmp_path):
    texts = texts_of(30, seed=11)
    documents(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = workloads.op13_tokenizer_alignment(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in NAMES) for r in got] == brute(texts)


def test_each_stretch_is_aligned_once():
    work, seen = align.Aligner(PAIR), []

    class Told:
        def encode(self, texts, **options):
            seen.extend(texts)
            return model.encode(texts, **options)

    model, work.model = work.model, Told()
    texts = ["some words and some words", "words and  words ", "some\n words", " ", "a ", "words"]
    first = work.align(texts)
    assert len(seen) == len(set(seen)) and max(map(len, seen)) < 12
    known = len(seen)
    counts, keys, groups = work.summaries(texts)
    assert len(seen) == known and groups == [align.groups_text(x) if len(x.a) else "" for x in first]
    assert [x.tolist() for x in counts] == [[len(getattr(x, n)) for x in first] for n in ("a", "b", "a_cut", "left")]
    assert all(x.b.tolist() == model.encode(t) for x, t in zip(first, texts, strict=True))
