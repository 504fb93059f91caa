"""One query per text operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import (
    align, bpe, chat, decontaminate, licenses, line_dedup, merkle, quality_model, quality_rules, sharding, simhash, token_counts,
    toxicity)
from .text import table

VOCABULARY = bpe.Vocabulary(
    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cut_before_space=True)


def _held_out(of: int, value: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(of)) == value


def op1_bpe_round_trip(spark, sf):
    """Every document encoded and decoded again; digests of ids and bytes."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, VOCABULARY).drop("text")
    back = bpe.decode(coded, VOCABULARY)
    return back.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_decontamination(spark, sf):
    """Every document and benchmark item that it leaks."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf, "benchmark"))


def op3_simhash(spark, sf):
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_model(spark, sf):
    """Quality score of every document, learnt from the labels that are not held out."""
    described = quality_model.described_once(table(spark, sf, "documents").select("doc_id", "text"))
    labels = table(spark, sf, "labels").where(~_held_out(4, 2) & F.col("quality").isNotNull())
    training = described.join(labels.select("doc_id", "quality"), "doc_id").select(
        "features", F.col("quality").cast("double").alias("quality"))
    scored = quality_model.score(described, quality_model.fit(training))
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_best_fit_shards(spark, sf):
    """All documents in sixteen shards of near equal bytes; equal texts stay together."""
    placed = sharding.shard(table(spark, sf, "documents").select("doc_id", "text"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_license_scan(spark, sf):
    """License notices of every document, with the share of the notice's shingles that the document has."""
    templates = spark.createDataFrame(licenses.TEMPLATES, "template string, body string")
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text"), templates).select(
        "doc_id", "template", F.round("containment", 9).alias("containment"))


def op7_quality_rules(spark, sf):
    """Every document under the line rules: counts and verdict."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept", "lost_words", "n_failed_lines")


def op8_toxicity(spark, sf):
    """Toxicity score and spans of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    learnt = table(spark, sf, "labels").where(~_held_out(5, 0))
    model = toxicity.fit(toxicity.training_rows(docs, learnt))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op9_line_dedup(spark, sf):
    """Every web page's visible lines without the boilerplate of its host."""
    pages = table(spark, sf, "pages").select(
        "page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text"))
    # Read twice below: the visible lines are taken out of the pages once.
    return line_dedup.drop_boilerplate(cut_lineage(pages), "host")


def op10_chat_format(spark, sf):
    """All conversations, and one that quotes the control strings, formatted and read back."""
    quoted = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", quoted), (-1, 1, "assistant", quoted)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark, sf):
    """Every document's leaf, roots and proof; every seventh (by hash) is folded from a tampered leaf and must not verify."""
    docs = table(spark, sf, "documents").select(*MANIFEST_FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaf = merkle.leaf_digest(*[F.col(c) for c in MANIFEST_FIELDS])
    other = merkle.leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in MANIFEST_FIELDS])
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, other).alias("altered"))
    proved = merkle.manifest(leaves)
    folded = proved.withColumn("folded_root", merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof.digest", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_counts(spark, sf):
    """Bytes and tokens of every document under the byte-level BPE file."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op13_tokenizer_alignment(spark, sf):
    """Every document aligned under two tokenizers, with the corpus counts of its linked id pairs."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pair = align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.link_sums(docs, pair).select("doc_id", *align.COUNTS, "n_best", "count_sum", "groups_sha256")


# The lengths follow from the markers: two markers, two line feeds and the escapes of each turn.
CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
           SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL
           SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe,
             replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS safe_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + length(safe_role) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


_PHRASES = "|".join(quality_rules.STOCK_PHRASES)
_SEPARATORS = ", ".join(f"'{x}'" for x in quality_rules.SEPARATORS)
_CLOSING = quality_rules.CLOSING.replace("'", "''")

def _sql_word_list(text: str) -> str:
    marks = licenses.MARKS.replace("'", "''")
    return (f"list_filter(string_split_regex(regexp_replace(lower({text}), '{marks}', '', 'g'), '[\\x20\\x09-\\x0D]+'), "
            "lambda w: w <> '')")


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.TEMPLATES)

LICENSE_SQL = rf"""
WITH known AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) v(template, body)),
tw AS (SELECT template, {_sql_word_list("body")} AS w FROM known),
ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS g
       FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM tw WHERE len(w) >= 5)),
sizes AS (SELECT template, count(*) AS n FROM ts GROUP BY 1),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_sql_word_list("text")} AS w FROM documents),
ds AS (SELECT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g
       FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5))
SELECT doc_id, template, round(m * 1.0::DOUBLE / n, 9) AS containment
FROM (SELECT r, doc_id, template, count(DISTINCT g) AS m FROM ds JOIN ts USING (g) GROUP BY ALL) JOIN sizes USING (template)
WHERE m * 1.0::DOUBLE / n >= 0.8::DOUBLE
"""


def _sql_entities(text: str) -> str:
    for name, sign in line_dedup.ENTITIES:
        text = f"replace({text}, '{name}', '{sign}')"
    return text


_LINE_DEDUP_SQL = r"""
WITH pages_ AS ({source}),
cut AS (SELECT *, string_split(text, chr(10)) AS lines FROM pages_),
seen AS (SELECT host, key, count(*) AS n FROM (
           SELECT host, unnest(list_distinct(list_filter(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> ''))) AS key
           FROM cut) GROUP BY ALL),
totals AS (SELECT host, count(*) AS total FROM pages_ GROUP BY 1),
bad AS (SELECT host, list(key) AS keys FROM seen JOIN totals USING (host)
        WHERE n >= 5 AND n > total * 0.02::DOUBLE GROUP BY 1),
left_ AS (SELECT c.*, CASE WHEN b.keys IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(b.keys, x)) END AS l
          FROM cut c LEFT JOIN bad b ON c.host IS NOT DISTINCT FROM b.host),
held AS (SELECT *, CASE WHEN length(array_to_string(l, chr(10))) < length(text) * 0.5::DOUBLE THEN lines ELSE l END AS k
         FROM left_)
"""

LINE_DEDUP_SQL = _LINE_DEDUP_SQL.replace("{source}", rf"""
SELECT page_id, lower(regexp_extract(url, '{line_dedup.HOST}', 1)) AS host, regexp_replace({_sql_entities(
    f"regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup.UNSEEN}', ' ', 'g'), '{line_dedup.BREAKS}', chr(10), 'g'), "
    f"'{line_dedup.TAGS}', '', 'g')")}, '{line_dedup.BLANKS}', chr(10), 'g') AS text FROM pages""") + """
SELECT page_id, host, array_to_string(k, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines,
       coalesce(len(lines) - len(k), 0) AS n_dropped FROM held
"""

QUALITY_RULES_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM docs),
cut AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM lines),
sized AS (SELECT *, len(w) AS n, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS s,
                 len(list_filter(w, lambda x: contains(x, '!'))) AS loud,
                 len(list_filter(w, lambda x: x IN ({_SEPARATORS}))) AS alone FROM cut),
judged AS (SELECT *, n > 0 AND (NOT contains('{_CLOSING}', right(w[-1], 1))
                 OR s * 10 > length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))
                 OR (loud >= 3 AND loud * 3 > n) OR (alone >= 3 AND alone * 4 >= n)
                 OR regexp_matches(t, '(?i){_PHRASES}')) AS f FROM sized),
per_doc AS (SELECT doc_id, sum(n)::BIGINT AS n_words, sum(s)::BIGINT AS n_symbols,
                   sum(list_sum(list_transform(w, lambda x: length(x))))::BIGINT AS word_chars,
                   (count(*) FILTER (n > 0) - count(DISTINCT t) FILTER (n > 0))::BIGINT AS n_dup_lines,
                   coalesce(sum(n) FILTER (f), 0)::BIGINT AS lost_words, count(*) FILTER (f) AS n_failed_lines
            FROM judged GROUP BY 1),
one AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
grams AS (SELECT doc_id, i, w[i:i + 4] AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM one WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n
            FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY 1),
based AS (SELECT p.*, coalesce(c.n, 0) AS n_repeat_words,
                 n_words < 10 OR coalesce(c.n, 0) * 100 > n_words * 20 AS base_failed
          FROM per_doc p LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_words <= n_words * 0.5::DOUBLE AS kept, lost_words, n_failed_lines
FROM based
"""


# The CRC-32 comes from its polynomial: a table by eight shifts, then one step a character of the decimal id.
_CRC = "x"
for _ in range(8):
    _CRC = f"(SELECT xor(y >> 1, (y & 1) * 3988292384::UBIGINT) FROM (SELECT {_CRC} AS y))"


def _sql_field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


def _sql_levels(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT tree, 0 AS l, i, h, n FROM {leaves} UNION ALL
   SELECT tree, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
   FROM {name} WHERE n > 1 GROUP BY tree, l, i // 2)"""


def _sql_steps(levels: str) -> str:
    """Sibling of each node on the way up; ``odd`` where the node itself is the right one."""
    return f"""SELECT a.tree, a.l, a.i, b.h AS sibling, a.i % 2 = 1 AS odd FROM {levels} a
   LEFT JOIN {levels} b ON a.tree = b.tree AND a.l = b.l AND b.i = xor(a.i, 1) WHERE a.n > 1"""


MERKLE_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY x) AS t FROM (
   SELECT x, {_CRC} AS v FROM (SELECT unnest(range(256))::UBIGINT AS x))),
ids AS (SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
crcs AS (SELECT id, xor(list_reduce(list_prepend(4294967295::UBIGINT,
   list_transform(string_split(s, ''), lambda c: ascii(c)::UBIGINT)),
   lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS crc FROM ids, crc_table),
docs AS (SELECT row_number() OVER () AS r, d.*, coalesce(crc % 7 = 0, false) AS bad
   FROM documents d LEFT JOIN crcs ON d.doc_id = crcs.id),
hashed AS (SELECT r, doc_id, coalesce('+' || lang, '') AS tree,
   sha256({" || ".join(map(_sql_field, MANIFEST_FIELDS))}) AS h,
   CASE WHEN bad THEN sha256({" || ".join(_sql_field(f"({c} + 1)" if c == "n_chars" else c) for c in MANIFEST_FIELDS)}) END AS other
   FROM docs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, r) - 1 AS i,
   count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_sql_levels("nodes", "leaves")},
tops AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n
   FROM nodes WHERE n = 1),
{_sql_levels("upper", "tops")},
node_steps AS ({_sql_steps("nodes")}), upper_steps AS ({_sql_steps("upper")}),
steps AS (SELECT r, s.l AS k, sibling, odd FROM leaves f JOIN node_steps s ON f.tree = s.tree AND s.i = f.i >> s.l
   UNION ALL
   SELECT r, 64 + s.l, sibling, odd FROM leaves f JOIN tops t ON f.tree = t.name JOIN upper_steps s ON s.i = t.i >> s.l),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS k_, count(*) OVER (PARTITION BY r) AS m FROM steps),
fold AS (SELECT r, 1 AS k_, coalesce(other, h) AS h FROM leaves UNION ALL
   SELECT f.r, f.k_ + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN odd THEN sibling || h ELSE h || sibling END)
   FROM fold f JOIN numbered s ON f.r = s.r AND f.k_ = s.k_),
folded AS (SELECT r, arg_max(h, k_) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY k) FILTER (sibling IS NOT NULL), '')) AS p FROM steps GROUP BY r)
SELECT doc_id, f.h AS leaf, t.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root,
   coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM upper WHERE n = 1) AS verified
FROM leaves f JOIN tops t ON f.tree = t.name JOIN folded USING (r) LEFT JOIN proofs USING (r)
"""

QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_quality_model": op4_quality_model,
    "op5_best_fit_shards": op5_best_fit_shards,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES = {
    "op7_quality_rules": QUALITY_RULES_SQL,
    "op6_license_scan": LICENSE_SQL,
    "op9_line_dedup": LINE_DEDUP_SQL,
    "op10_chat_format": CHAT_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
}
