"""Ranking queries over documents, benchmark questions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import snippet, squeeze, tokens
from gristmill.operators import retrieval as R
from gristmill.operators.lineage import cut
from gristmill.plans.base import BM25_SQL, query, table, terms_sql

TERMS = ["ontion", "the", "thering", "eren", "que"]
MORE = ["and", "tion", "der", "of"]


def _score(spark: SparkSession, sf_dir: str, *questions: list[str]) -> DataFrame:
    """BM25 scores of questions (numbered from 0) given by their terms, in one pass over the texts."""
    asked = spark.createDataFrame([(i, t) for i, terms in enumerate(questions) for t in terms], "query_id long, token string")
    return R.bm25(table(spark, sf_dir, "documents"), tokens(F.col("text")), asked, "doc_id")


_LIST = lambda ts: ", ".join(f"'{t}'" for t in ts)


@query(f"WITH {BM25_SQL}, scored AS (SELECT doc_id, round(sum(part), 6) AS score FROM part WHERE token IN ({_LIST(TERMS)}) GROUP BY doc_id)\n"
       "SELECT doc_id, score, rank::BIGINT AS rank, CASE WHEN length(flat) > 450 THEN rtrim(left(flat, 447)) || '...' ELSE flat END AS snippet\n"
       r"FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored) JOIN (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents) USING (doc_id) WHERE rank <= 30")  # fmt: skip
def bm25_topk(spark, sf_dir):
    scored = _score(spark, sf_dir, TERMS).withColumn("score", F.round("score", 6))
    best = scored.orderBy(F.desc("score"), "doc_id").limit(30)
    best = R.ranked(best, 30, ["query_id"], id_col="doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(best), "doc_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"), snippet(F.col("text")).alias("snippet"))


@query(f"WITH {BM25_SQL}, {terms_sql('benchmark', 'item_id', 'asked')}, asked1 AS (SELECT DISTINCT item_id, token FROM asked),\n"
       "scored AS (SELECT item_id AS query_id, doc_id, round(sum(part), 6) AS score FROM part JOIN asked1 USING (token) GROUP BY ALL)\n"
       "SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10")  # fmt: skip
def bm25_batch_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = R.bm25_top(table(spark, sf_dir, "documents"), tokens(F.col("text")), asked, 10, "doc_id", tokens(F.col("text")), digits=6)
    return best.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query(f"WITH {BM25_SQL} SELECT token, sum(tf)::BIGINT AS tf, count(*)::BIGINT AS df, round(any_value(idf), 6) AS idf FROM posting JOIN idf USING (token) GROUP BY token")
def term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    stats = R.postings(docs, tokens(F.col("text")), "doc_id").groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    return stats.withColumn("idf", F.round(F.log(1e0 + (F.lit(float(n)) - F.col("df") + 0.5e0) / (F.col("df") + 0.5e0)), 6))


@query("SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 40")
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.dense(vectors, asked, 40, "vec_id", "embedding", digits=5).withColumns({"score": F.round("score", 5), "rank": F.col("rank").cast("long")})


@query("WITH sims AS (SELECT q.label AS query_id, v.label AS node_id, q.vec_id AS q_token, max(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS best FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 GROUP BY ALL)\n"
       "SELECT query_id::BIGINT AS query_id, node_id::BIGINT AS node_id, round(sum(best), 5) AS score FROM sims GROUP BY ALL")  # fmt: skip
def late_interaction_maxsim(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("q_token"), F.col("embedding").alias("q"))
    scored = R.max_sim(vectors.select(F.col("label").alias("node_id"), F.col("embedding").alias("v")), asked)
    return scored.withColumn("score", F.round("score", 5))


_TWO = f"""WITH {BM25_SQL},
a AS (SELECT doc_id, round(sum(part), 6) AS score FROM part WHERE token IN ({_LIST(TERMS)}) GROUP BY doc_id),
b AS (SELECT doc_id, round(sum(part), 6) AS score FROM part WHERE token IN ({_LIST(MORE)}) GROUP BY doc_id),
ra AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a), rb AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b)"""


def _hits(scored: DataFrame, question: int, k: int, variant: str, weight: float) -> DataFrame:
    best = R.ranked(scored.where(F.col("query_id") == question), k, ["query_id"], id_col="doc_id")
    return best.select(F.lit(0).alias("query_id"), "doc_id", F.lit("bm25").alias("channel"), F.lit(variant).alias("variant"), "rank", "score", F.lit(weight).alias("weight"))


@query(_TWO + "\nSELECT doc_id, round(sum(c), 9) AS score, max(br)::BIGINT AS first_rank, max(dr)::BIGINT AS second_rank FROM (SELECT doc_id, 2e0 / (60 + rank) AS c, rank AS br, NULL AS dr FROM ra WHERE rank <= 30 UNION ALL SELECT doc_id, 5e0 / (60 + rank), NULL, rank FROM rb WHERE rank <= 60) GROUP BY doc_id")
def rrf_two_channel(spark, sf_dir):
    """Two ranked lists fused with the weights 2 and 5. Both are BM25 lists; hybrid_search fuses BM25 with dense hits."""
    scored = cut(_score(spark, sf_dir, TERMS, MORE).withColumn("score", F.round("score", 6)))
    fused = R.fuse(_hits(scored, 0, 30, "first", 2.0).unionByName(_hits(scored, 1, 60, "second", 5.0)), id_col="doc_id")
    rank = lambda c: F.col("matches")[f"bm25:{c}"]["rank"].cast("long")
    return fused.select("doc_id", F.round("score", 9).alias("score"), rank("first").alias("first_rank"), rank("second").alias("second_rank"))


@query(_TWO + "\nSELECT doc_id, round(sum(c), 9) AS score, string_agg(key || '=' || rank, ' ' ORDER BY key) AS matches FROM (SELECT doc_id, 2e0 / (60 + rank) AS c, 'bm25:original' AS key, rank FROM ra WHERE rank <= 30 UNION ALL SELECT doc_id, 2e0 * 0.85e0 / (60 + rank), 'bm25:multi_1', rank FROM rb WHERE rank <= 30\n"
       "UNION ALL SELECT doc_id, 2e0 * 0.9e0 / (60 + rank), 'bm25:sub_1', rank FROM ra WHERE rank <= 20 UNION ALL SELECT doc_id, 2e0 * 0.65e0 / (60 + rank), 'bm25:step_back', rank FROM rb WHERE rank <= 40) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 30")  # fmt: skip
def rrf_ensemble_variants(spark, sf_dir):
    """BM25 lists of four variants fused by the variants' weights; ensemble_search has three channels."""
    w, v = R.CHANNEL_WEIGHTS["bm25"], R.VARIANT_WEIGHTS
    scored = cut(_score(spark, sf_dir, TERMS, MORE).withColumn("score", F.round("score", 6)))
    lists = [(0, 30, "original", "original"), (1, 30, "multi_1", "multi"), (0, 20, "sub_1", "sub"), (1, 40, "step_back", "step_back")]
    hits = None
    for question, k, name, kind in lists:
        part = _hits(scored, question, k, name, w * v[kind])
        hits = part if hits is None else hits.unionByName(part)
    fused = R.fuse(hits, id_col="doc_id").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(R.CANDIDATES)
    shown = F.array_join(F.transform(F.map_entries("matches"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["rank"].cast("string"))), " ")
    return fused.select("doc_id", "score", shown.alias("matches"))


@query("SELECT doc_id, round(score * (CASE WHEN kind = 'visual' THEN 0.35e0 ELSE 1e0 END) * (CASE WHEN layer = 'summary' THEN 1.8e0 * 1.12e0 ELSE 1e0 END), 6) AS adjusted, round((CASE WHEN kind = 'visual' THEN 0.35e0 ELSE 1e0 END) * (CASE WHEN layer = 'summary' THEN 1.8e0 * 1.12e0 ELSE 1e0 END), 6) AS weight FROM (SELECT d.doc_id, d.n_chars::DOUBLE / 100 AS score, CASE WHEN l.toxic = 1 THEN 'visual' ELSE 'text' END AS kind, CASE WHEN l.quality = 1 THEN 'summary' ELSE 'leaf' END AS layer FROM documents d LEFT JOIN labels l USING (doc_id))")
def modality_reweight(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars").cast("double") / 100).alias("score")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    summary = F.coalesce(F.col("quality") == 1, F.lit(False))
    w = R.modality_weight(F.lit("trieu chung"), F.when(F.col("toxic") == 1, "visual").otherwise("text"), summary.cast("int"), F.when(summary, "summary").otherwise("leaf"))
    return rows.select("doc_id", F.round(R.adjusted_score(F.col("score"), w), 6).alias("adjusted"), F.round(w, 6).alias("weight"))


@query(_TWO + ", top AS (SELECT doc_id, rank AS prior FROM ra WHERE rank <= 30), head AS (SELECT doc_id, prior, (prior * 7) % 20 AS rr FROM top WHERE prior <= 20)\nSELECT doc_id, prior::BIGINT AS prior_rank, row_number() OVER (ORDER BY rr IS NULL, rr DESC, prior, doc_id)::BIGINT AS rank FROM top LEFT JOIN head USING (doc_id, prior)")
def rerank_tail_append(spark, sf_dir):
    top = R.ranked(_score(spark, sf_dir, TERMS).withColumn("score", F.round("score", 6)), 30, ["query_id"], id_col="doc_id")
    head = top.where("rank <= 20").select("query_id", "doc_id", ((F.col("rank") * 7) % 20).cast("double").alias("rerank_score"))
    out = R.rerank(top, head, "doc_id")
    return out.select("doc_id", F.col("prior_rank").cast("long").alias("prior_rank"), F.col("rank").cast("long").alias("rank"))


@query(_TWO.replace("WITH ", "WITH RECURSIVE ", 1) + """, listed AS (SELECT doc_id, rank, len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens FROM ra JOIN documents USING (doc_id) WHERE rank <= 30),
walk(rank, doc_id, tokens, used, taken) AS (SELECT rank, doc_id, tokens, tokens, true FROM listed WHERE rank = 1 UNION ALL
  SELECT l.rank, l.doc_id, l.tokens, used + CASE WHEN used < 5000 AND used + l.tokens <= 5000 THEN l.tokens ELSE 0 END, used < 5000 AND used + l.tokens <= 5000 FROM walk w JOIN listed l ON l.rank = w.rank + 1)
SELECT 0::BIGINT AS query_id, doc_id, rank::BIGINT AS rank, tokens FROM walk WHERE taken""")
def token_budget_pack(spark, sf_dir):
    ranked = R.ranked(_score(spark, sf_dir, TERMS).withColumn("score", F.round("score", 6)), 30, ["query_id"], id_col="doc_id")
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?U)\S+")).cast("long").alias("tokens"))
    return R.pack_budget(lengths.join(F.broadcast(ranked), "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "tokens"), 5000, id_col="doc_id")


@query(r"""WITH b AS (SELECT item_id, text, split_part(text, '.', 1) AS first FROM benchmark),
v AS (SELECT item_id, unnest([text, lower(text), first, '  ' || first || ' ']) AS t, unnest([0, 1, 2, 3]) AS pos FROM b),
k AS (SELECT item_id, pos, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM v)
SELECT item_id, arg_min(name, pos) AS name, arg_min(text, pos) AS text FROM (SELECT *, ['original', 'multi_1', 'multi_2', 'step_back'][pos + 1] AS name FROM k WHERE text <> '') GROUP BY item_id, lower(text)""")
def query_variant_dedup(spark, sf_dir):
    first = F.split_part("text", F.lit("."), F.lit(1))
    bundle = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("original"), F.lit(None).cast("string").alias("hyde_document"), F.array(F.lower("text"), first).alias("multi_queries"), F.lit(None).cast("array<string>").alias("sub_questions"), F.concat(F.lit("  "), first, F.lit(" ")).alias("step_back_query"))
    lexical, _ = R.variants(bundle)
    return lexical.select(F.col("query_id").alias("item_id"), "name", "text")


SYNONYMS = {"the": ["article", "determiner"], "tion": ["suffix"], "que": ["that"]}


@query(r"SELECT item_id, concat_ws(' ', q, CASE WHEN contains(q, 'the') THEN 'article determiner' END, CASE WHEN contains(q, 'tion') THEN 'suffix' END, CASE WHEN contains(q, 'que') THEN 'that' END) AS expanded FROM (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q FROM benchmark)")
def expand_query_synonyms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.expand_query(F.col("text"), SYNONYMS).alias("expanded"))


@query(f"WITH {BM25_SQL}, {terms_sql('benchmark', 'item_id', 'asked')}, asked1 AS (SELECT DISTINCT item_id, token FROM asked),\n"
       "scored AS (SELECT item_id, doc_id, round(sum(part), 6) AS score FROM part JOIN asked1 USING (token) GROUP BY ALL),\n"
       "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 5)\n"
       "SELECT item_id, string_agg('[Source ' || rank || '] ' || doc_id || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) AS contexts FROM top JOIN documents d USING (doc_id) GROUP BY item_id")  # fmt: skip
def prompt_contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    top = bm25_batch_questions(spark, sf_dir).where("rank <= 5")
    return R.context_block(top.join(docs.select("doc_id", "text"), "doc_id"), 5, id_col="doc_id").select(F.col("query_id").alias("item_id"), "contexts")


@query(r"""WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS ts FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_filter(ts, lambda t: contains(lower(d.text), t))) AS score FROM q, documents d)
SELECT item_id, doc_id, score::BIGINT AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def keyword_overlap_search(spark, sf_dir):
    """The five documents that contain most of the tokens of each question; short and repeated tokens count too."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda t: t != "").alias("ts"))
    best = R.keyword_search(table(spark, sf_dir, "documents"), asked, 5)
    return best.select(F.col("query_id").alias("item_id"), "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25_SQL}, a AS (SELECT doc_id, round(sum(part), 6) AS score FROM part WHERE token IN ({_LIST(TERMS)}) GROUP BY doc_id),\n"
       "top AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a), rel AS (SELECT doc_id FROM labels WHERE quality = 1)\n"
       "SELECT round(count(*) FILTER (rank <= 50) / 50e0, 6) AS precision, round(count(*) FILTER (rank <= 50) / (SELECT count(*) FROM rel)::DOUBLE, 6) AS recall, round(1e0 / min(rank), 6) AS reciprocal_rank FROM top JOIN rel USING (doc_id)")  # fmt: skip
def rank_metrics(spark, sf_dir):
    from gristmill.operators.evaluation import rank_metrics as metrics

    hits = R.ranked(_score(spark, sf_dir, TERMS).withColumn("score", F.round("score", 6)), 50, ["query_id"], id_col="doc_id")
    relevant = table(spark, sf_dir, "labels").where("quality = 1").select(F.lit(0).cast("long").alias("query_id"), "doc_id")
    return metrics(hits, relevant, 50, "doc_id").select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")))


@query(r"SELECT item_id, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda t, i: lower(t) <> 'the' AND i = list_position(list_transform(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: lower(x)), lower(t)))[1:8] AS items FROM benchmark")
def query_list_cleaning(spark, sf_dir):
    items = R.clean_list(F.split(squeeze(F.col("text")), " "), F.lit("The"), 8)
    return table(spark, sf_dir, "benchmark").select("item_id", items.alias("items"))
