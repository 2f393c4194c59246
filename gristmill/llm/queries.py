"""The registered queries of the training-data operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.lineage import balanced


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table; a very small one, which may be one row group, over all cores."""
    return balanced(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.warc import derive, responses_of_pages

    out = derive(responses_of_pages(table(spark, sf_dir, "pages")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("block", "record")]
    return out.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_headers", "source_digest", "block_digest", "block_length", *digests)


def op2_countmin_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("posterior")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.sharding import shard_rows

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = shard_rows(docs, "doc_id", 16, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("text_crc32"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op8_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gristmill.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_three_phase_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, q.nth, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.nth <> c.nth)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS "at" FROM w WHERE len(ws) >= 20),
firsts AS (SELECT doc_id, "at", row_number() OVER (PARTITION BY array_to_string(ws["at":"at" + 19], ' ') ORDER BY doc_id, "at") AS nth FROM windows),
words AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range("at", "at" + 20)) AS pos FROM firsts WHERE nth > 1),
judged AS (SELECT k.doc_id, k.pos, k.ws[k.pos] AS word, g.pos IS NOT NULL AS gone FROM words k LEFT JOIN gone g USING (doc_id, pos)),
sums AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN sums s USING (doc_id)
"""

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
found AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id > f.first AS gone FROM keyed k LEFT JOIN found f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SHARDING_SQL = r"""
WITH RECURSIVE crc(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
coded AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
sums AS (
  SELECT doc_id, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(pairs, lambda b: ('0x' || b)::BIGINT)),
    lambda c, b: xor(t[(xor(c & 255, b) + 1)::BIGINT], c >> 8)) AS c FROM coded, crc_table),
k0 AS (SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size, xor(c, 4294967295)::BIGINT AS text_crc32, doc_id::UHUGEINT AS x FROM sums),
k1 AS (SELECT *, xor(x, x >> 30) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS y FROM k0),
k2 AS (SELECT *, xor(y, y >> 27) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM k1),
mixed AS (SELECT doc_id, size, text_crc32, xor(z, z >> 31) AS h FROM k2),
jump(doc_id, shards, key, b, j) AS (
  SELECT doc_id, n, h, -1::BIGINT, 0::BIGINT FROM mixed, (VALUES (16), (17)) v(n) UNION ALL
  SELECT doc_id, shards, nk, j, trunc((j + 1) * (2147483648e0 / ((nk >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS nk FROM jump WHERE j < shards)),
placed AS (SELECT doc_id, shards, max(b) AS shard FROM jump GROUP BY doc_id, shards)
SELECT m.doc_id, m.size, m.text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY p.shard ORDER BY (m.h % 256 + m.text_crc32::UHUGEINT % 256) % 256, m.doc_id, m.text_crc32, m.size) - 1)::BIGINT AS slot, q.shard::INTEGER AS grown_shard
FROM mixed m JOIN placed p ON p.doc_id = m.doc_id AND p.shards = 16 JOIN placed q ON q.doc_id = m.doc_id AND q.shards = 17
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_derivatives, op2_countmin_substring_dedup, op3_weak_supervision, op4_jump_sharding, op5_simhash_blocks, op6_line_dedup, op7_best_fit_packing, op8_string_kernel_language, op9_bpe_prefix_dp, op10_three_phase_top_k)}


def oracle_sql() -> dict[str, str]:
    from gristmill.llm.quality_rules import judge_sql

    return {"op3_weak_supervision": judge_sql(), "op2_countmin_substring_dedup": SUBSTRING_SQL, "op10_three_phase_top_k": TOP_K_SQL, "op4_jump_sharding": SHARDING_SQL, "op6_line_dedup": LINE_DEDUP_SQL}
