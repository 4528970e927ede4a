"""The contract's queries over the given tables: thin layers over the operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmerge.llm import chat, mixing, near, packing, pages, pii, prefixes, quality, simhash, tokenfile, toxicity, urls, variants
from docmerge.llm.common import table

#: Rules of the URL query: (host and path beginning, verdict); fixed by the contract.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def _hex(text):
    return F.sha2(text.cast("binary"), 256)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.judge(quality.ledger(table(spark, sf_dir, "documents")), "base", "base_kept"), "v1")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "n_adjacent", "n_upper", "failure_bits",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda name: F.crc32(F.col(name).cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id") != 0)
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted", "start", "end", "sentence_score")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("key")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id ends its path; that document's quality label is the page's outcome."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+|/)?\z", 1)
    shown = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return urls.judge_urls(pages, shown.join(labels, "doc_id").select("url", "good"), URL_RULES)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    formatted = chat.format_conversations(turns.unionByName(extra))
    read = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _hex(lines).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), _hex(F.col("loss")).alias("loss_sha256"), "formatted_chars",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_embedding_dedup, op3_html_text, op4_pii, op5_quality_rules, op6_toxicity, op7_simhash_dedup, op8_entropy_mix, op9_url_reputation, op10_chat_format, op11_prefix_trie, op12_token_files, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op10_chat_format": OP10_SQL, "op11_prefix_trie": OP11_SQL}


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, word, lead(word, 1) OVER a AS w1, lead(word, 2) OVER a AS w2, lead(word, 3) OVER a AS w3, lead(word, 4) OVER a AS w4,
        lag(word, 1) OVER a AS w0 FROM p WINDOW a AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, word = w0 AS adjacent, w4 IS NOT NULL AND count(*) OVER (PARTITION BY r, word, w1, w2, w3, w4) > 1 AS again FROM g),
e AS (SELECT r, adjacent, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM c),
s AS (SELECT r, count(*) FILTER (covered) AS n_repeat_words, count(*) FILTER (adjacent) AS n_adjacent FROM e GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent,
        length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper, len(ls) AS n_lines FROM w LEFT JOIN s ON w.r = s.r),
b AS (SELECT *, n_words < 10 AS b0, 100 * n_repeat_words > 20 * n_words AS b1, n_symbols > n_words * 0.2 AS b2, n_upper > word_chars * 0.5 AS b3,
        n_adjacent > n_words * 0.3 AS b4, n_dup_lines > n_lines * 0.5 AS b5, word_chars < n_words * 1.5 OR word_chars > n_words * 30.0 AS b6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed,
  NOT (b0 OR b1 OR b2 OR b3 OR b4) AS kept, n_adjacent, n_upper,
  CAST(CAST(b0 AS INT) + 2 * CAST(b1 AS INT) + 4 * CAST(b2 AS INT) + 8 * CAST(b3 AS INT) + 16 * CAST(b4 AS INT) + 32 * CAST(b5 AS INT) + 64 * CAST(b6 AS INT) AS BIGINT) AS failure_bits
FROM b
"""

OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(x)),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
  replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS erole, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS etext FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN before = role THEN 6 ELSE 15 + length(erole) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: CRC-32 bit by bit; the base of a conversation keeps its own turns.
OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT c, length(role) || ':' || role || ':' || text AS e, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256('0:' || length(role) || ':' || role || ':' || text)) AS i FROM t),
o AS (SELECT c, list(e ORDER BY i) AS es, list(w ORDER BY i) AS ws, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM e GROUP BY c),
h AS (SELECT *, c - c % 20 AS b, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(crc, 4294967295) % 4 END AS h FROM o),
r AS (SELECT x.c, x.b, x.h, least(x.h, coalesce(len(y.es), 0)) AS hh, list_concat(coalesce(y.es, [])[1:x.h], x.es[x.h + 1:]) AS es, list_concat(coalesce(y.ws, [])[1:x.h], x.ws[x.h + 1:]) AS ws
    FROM h x LEFT JOIN o y ON y.c = x.b),
m AS (SELECT *, es[1:d] AS p, CASE WHEN d = 0 THEN NULL WHEN d <= hh THEN b ELSE c END AS rc, CASE WHEN d = 0 THEN NULL WHEN d <= hh THEN d - 1 ELSE d - hh + h - 1 END AS rp
    FROM (SELECT *, unnest(range(0, len(es) + 1)) AS d FROM r)),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(ws[d]), 0) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(es) = d), '') AS ends,
    arg_min(rc, c) AS ref_conv_id, arg_min(rp, c) AS ref_pos FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
s AS (SELECT p[1:a] AS p, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256, f.ref_conv_id, f.ref_pos
FROM f JOIN s ON s.p = f.p AND s.d = f.d LEFT JOIN n u ON u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]
"""
