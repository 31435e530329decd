"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, extraction, katz, maxscore, minhash, packing, quality, secrets, shards, toxicity
from heddle.llm.common import crc_mod, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.encode(F.col("text"), BYTE_RANKS, public_tokenizers.PATTERN).alias("ids"))
    both = coded.select("doc_id", "ids", bpe.decode(F.col("ids"), BYTE_RANKS, public_tokenizers.PATTERN).alias("decoded"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per slot of the training order: its shard, byte offset and a digest of the record read back from the shard."""
    length, per_shard = 2048, 1024
    slots = shards.materialise_order(table(spark, sf_dir, "documents"), WORD_TOKENIZER, length=length, per_shard=per_shard)
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    return slots.select("slot", shard.alias("shard"), ((F.col("slot") - shard * per_shard) * (2 * length + 1)).alias("byte_offset"), F.crc32("ids").alias("ids_crc32"))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
WITH f AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM f),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
rare AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN rare USING (g) JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * k >= 85 * (p.n + q.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.judge(quality.stored(table(spark, sf_dir, "documents")), "web-1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.mask("base-1"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
t AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM m),
g AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + u.o) AS k FROM n, (SELECT unnest([0, 1, 2]) AS o) u WHERE n.k >= 2 GROUP BY doc_id),
x AS (SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.k, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda y: y[-1] = '!')) AS n_bang, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits
      FROM m LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 8 ELSE 0 END)
             + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_bang > 30 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 100 * n_digits > 30 * word_chars THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits FROM f
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extraction.main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"), path_col="source")
    return found.select("doc_id", "start", "length", "rule", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


QUERIES = {
    "op1_katz": op1_katz,
    "op2_bpe": op2_bpe,
    "op3_token_shards": op3_token_shards,
    "op4_maxscore": op4_maxscore,
    "op5_minhash": op5_minhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
}
ORACLE_SQL = {"op4_maxscore": OP4_SQL, "op5_minhash": OP5_SQL, "op6_quality_rules": OP6_SQL}
