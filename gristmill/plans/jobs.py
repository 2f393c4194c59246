"""Queries through sources, sinks, jobs and page layout, over the driver's tables in the roles of chunks, pages and nodes."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import layout as L
from gristmill.functions import text as T
from gristmill.operators import chunking as C
from gristmill.operators import documents as D
from gristmill.operators import evaluation as E
from gristmill.operators import graph as G
from gristmill.operators import index as I
from gristmill.operators import jobs as J
from gristmill.operators import knowledge as K
from gristmill.operators import providers as P
from gristmill.operators import retrieval as R
from gristmill.operators import search as S
from gristmill.operators import tree as TR
from gristmill.operators.lineage import numbered_within, scratch_path
from gristmill.plans.base import query, table
from gristmill.plans.corpus import _HEAD
from gristmill.plans.search import _DENSE, _channels
from gristmill.sources import files, store
from gristmill.streaming import ingest

_FLAT = lambda t: rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"
_CHUNKS = "chunks AS (SELECT conv_id || '-' || turn AS id, 'conv ' || conv_id AS doc_name, (turn // 2)::INTEGER AS page_number, CASE WHEN role = 'tool' THEN 'table' WHEN turn % 7 = 6 THEN 'visual' ELSE 'text' END AS chunk_type, turn::INTEGER AS chunk_index, text AS content FROM conversations)"


def _chunks(spark, sf_dir) -> DataFrame:
    """Turns of conversations as chunks."""
    kind = F.when(F.col("role") == "tool", "table").when(F.col("turn") % 7 == 6, "visual").otherwise("text")
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("doc_name"), F.floor(F.col("turn") / 2).cast("int").alias("page_number"), kind.alias("chunk_type"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content"))


@query(rf"""WITH {_CHUNKS}, t AS (SELECT *, {_FLAT('content')} AS flat FROM chunks WHERE {_FLAT('content')} <> '')
SELECT id, 'leaf_' || substr(sha1(id || '|' || doc_name || '|' || page_number || '|' || chunk_index || '|' || flat), 1, 16) AS node_id, flat AS text, greatest(1, ceil(len(regexp_extract_all(flat, '\S+')) * 1.3e0))::BIGINT AS token_estimate, doc_name AS docs, chunk_type FROM t""")
def leaf_nodes(spark, sf_dir):
    """Chunks written as JSON lines, found and read again, as leaves of a tree."""
    path = scratch_path(spark)
    files.write_jsonl(_chunks(spark, sf_dir), path)
    leaves = files.load_leaves(files.read_jsonl(spark, path, glob="*.json"))
    return leaves.select(F.col("source_chunk_id").alias("id"), "node_id", "text", "token_estimate", F.array_join("source_docs", ",").alias("docs"), "chunk_type")


@query(rf"""WITH {_CHUNKS} SELECT id AS chunk_id, doc_name, page_number::BIGINT AS page_number, left(trim(content), 6000) AS content FROM chunks WHERE chunk_type <> 'visual' AND length(trim(content)) >= 12""")
def source_chunks(spark, sf_dir):
    """Chunks for extraction: visual ones and short ones left out, bracketed contexts cut off."""
    rows = _chunks(spark, sf_dir).withColumn("content", F.concat(F.lit("[somewhere] "), F.col("content")))
    return files.load_source_chunks(rows).select("chunk_id", "doc_name", F.col("page_number").cast("long").alias("page_number"), "content")


@query(f"WITH {_CHUNKS} SELECT id, page_number::BIGINT AS page_number FROM chunks WHERE page_number <= 1")
def page_limited(spark, sf_dir):
    path = scratch_path(spark)
    files.write_jsonl(_chunks(spark, sf_dir), f"{path}/x.jsonl")
    rows = files.read_jsonl(spark, path, glob="*.json").where("_corrupt is null")
    return files.page_limit(rows, 1).select("id", F.col("page_number").cast("long").alias("page_number"))


@query(rf"""SELECT doc_id AS node_id, CASE WHEN quality = 1 THEN 'summary' ELSE 'leaf' END AS layer, source || '; ' || coalesce(lang, 'none') AS docs, len(regexp_extract_all(text, '\S+'))::BIGINT AS token_estimate FROM documents LEFT JOIN labels USING (doc_id)""")
def index_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    nodes = rows.select(F.col("doc_id").alias("node_id"), "text", (~F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_leaf"), F.array("source", F.coalesce("lang", F.lit("none"))).alias("source_docs"))
    return I.prepare_nodes(nodes).select("node_id", "layer", "docs", "token_estimate")


@query("SELECT p_partkey, p_name, p_brand, '| p_name | p_brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' AS markdown FROM part")
def sheet_sinks(spark, sf_dir):
    """A table as CSV and as Markdown, both read again."""
    path, parts = scratch_path(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    files.write_csv(parts, f"{path}/csv")
    cells = F.array(F.array(F.lit("p_name"), F.lit("p_brand")), F.array("p_name", "p_brand"))
    files.write_markdown(parts.select(T.markdown_table(cells).alias("markdown")), "markdown", f"{path}/md")
    shown = spark.read.option("lineSep", "\n\n").text(f"{path}/md").select(F.col("value").alias("markdown")).distinct()
    back = spark.read.option("header", True).schema("p_partkey long, p_name string, p_brand string").csv(f"{path}/csv")
    return back.join(shown, F.col("markdown") == T.markdown_table(cells))


@query("SELECT query_id, node_id, score, rank::BIGINT AS rank FROM (SELECT q.vec_id AS query_id, 'v' || v.vec_id AS node_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, 'v' || v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label < 5) WHERE rank <= 10")
def vector_store_search(spark, sf_dir):
    """Vectors put twice (the second time scaled; each node stays once), searched by cosine among the leaves."""
    rows = table(spark, sf_dir, "embeddings")
    vectors = store.VectorStore(spark, scratch_path(spark), 64)
    nodes = rows.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("node_id"), F.lit("").alias("text"), (F.col("label") < 5).alias("is_leaf"), F.col("embedding").alias("dense"))
    vectors.upsert(nodes)
    vectors.upsert(nodes.withColumn("dense", F.transform("dense", lambda x: x * 2)))
    found = vectors.search(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10, "is_leaf")
    return found.select("query_id", "node_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS nodes, (SELECT count(*) FROM documents)::BIGINT AS vectors, 64::BIGINT AS size, true AS built, false AS built_again, true AS built_for_new_model")
def index_job(spark, sf_dir):
    """The index with vectors of all nodes; made anew only for other texts or another model."""
    nodes, path = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "text"), scratch_path(spark)
    build = lambda model: I.build_index(nodes, T.tokens(F.col("text")), path, P.HashingEmbedder(), model)
    built = [build("a"), build("a"), build("b")]
    found = I.Index(spark, path)
    out = found.vectors().agg(F.count("*").alias("vectors"), F.max(F.size("v")).cast("long").alias("size"))
    return out.crossJoin(found.nodes().agg(F.count("*").alias("nodes"))).select("nodes", "vectors", "size", *(F.lit(b).alias(n) for b, n in zip(built, ("built", "built_again", "built_for_new_model"), strict=True)))


_BOXES = "b AS (SELECT p_partkey, p_size AS page, (p_partkey % 97)::DOUBLE AS x0, (p_partkey % 89)::DOUBLE AS y0, (p_partkey % 97 + 5 + p_size % 3)::DOUBLE AS x1, (p_partkey % 89 + 4)::DOUBLE AS y1, p_name AS text, p_brand FROM part)"


def _boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("page"), (k % 97).cast("double").alias("x0"), (k % 89).cast("double").alias("y0"), (k % 97 + 5 + F.col("p_size") % 3).cast("double").alias("x1"), (k % 89 + 4).cast("double").alias("y1"), F.col("p_name").alias("text"), "p_brand")


@query(f"""WITH {_BOXES}, t AS (SELECT * FROM b WHERE ends_with(p_brand, '2')), d AS (SELECT * FROM b WHERE NOT ends_with(p_brand, '1') AND NOT ends_with(p_brand, '2') AND (x1 - x0) * (y1 - y0) > 4 AND NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0)),
u AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM d GROUP BY page)
SELECT page::BIGINT AS page, x0, y0, x1, y1, 'image' AS kind FROM b WHERE ends_with(p_brand, '1') AND (x1 - x0) * (y1 - y0) >= 0.01 * 2600e0 UNION ALL SELECT page::BIGINT, x0, y0, x1, y1, 'diagram' FROM u WHERE n >= 5 AND (x1 - x0) * (y1 - y0) >= 0.02 * 2600e0""")
def visual_regions(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).withColumn("page_area", F.lit(2600e0))
    ends = lambda c: F.col("p_brand").endswith(c)
    return C.visual_regions(boxes.where(ends("1")), boxes.where(~ends("1") & ~ends("2")), boxes.where(ends("2")), ["page"]).withColumn("page", F.col("page").cast("long"))


@query(f"WITH {_BOXES}, c AS (SELECT *, greatest(2e0, x0 - 4) AS cx0, greatest(2e0, y0 - 4) AS cy0, least(90e0, x1 + 4) AS cx1, least(80e0, y1 + 4) AS cy1 FROM b) SELECT p_partkey, cx0, cy0, cx1, cy1, greatest(1, ceil((cx1 - cx0) * 2))::BIGINT AS width, greatest(1, ceil((cy1 - cy0) * 2))::BIGINT AS height, round(greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0), 2) AS area, 4::BIGINT AS corners FROM c")
def clipped_regions(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).withColumns({"page_x0": F.lit(2e0), "page_y0": F.lit(2e0), "page_x1": F.lit(90e0), "page_y1": F.lit(80e0)})
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return D.clip_regions(boxes).select("p_partkey", *(F.col(f"clip.{c}").alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.round(L.area(tuple(corners)), 2).alias("area"), F.size(D.rounded_box(corners)).cast("long").alias("corners"))


@query(r"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part), c AS (SELECT p_brand, i // 5 AS table_no, count(*) AS rows, string_agg(p_name || p_type || p_size, '' ORDER BY i) AS whole FROM n GROUP BY p_brand, i // 5)
SELECT p_brand, table_no::BIGINT AS table_no, 'lines' AS strategy, rows::BIGINT AS n_rows FROM c WHERE rows >= 2 AND length(whole) >= 12""")
def table_scan(spark, sf_dir):
    """Tables that two strategies found alike, accepted and kept once, by the order of the strategies."""
    parts = numbered_within(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), "p_brand", "p_partkey", "at").withColumn("at", F.col("at") - 1)
    rows = parts.groupBy("p_brand", F.floor(F.col("at") / 5).alias("table_no")).agg(F.array_sort(F.collect_list(F.struct("at", F.array("p_name", "p_type", F.col("p_size").cast("string")).alias("c")))).alias("r"))
    found = rows.select("p_brand", F.col("table_no").alias("table_index"), F.transform("r", lambda x: x["c"]).alias("rows"), F.lit(1e0).alias("width_share"), F.explode(F.array(F.struct(F.lit("text").alias("strategy"), F.lit(1).alias("strategy_order")), F.struct(F.lit("lines").alias("strategy"), F.lit(0).alias("strategy_order")))).alias("s")).select("*", "s.*")
    return D.distinct_tables(found, ["p_brand"]).select("p_brand", F.col("table_index").cast("long").alias("table_no"), "strategy", F.size("rows").cast("long").alias("n_rows"))


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text || chr(10) || 'Page 3 / 9', chr(10))) AS line, unnest(range(len(string_split(text || chr(10) || 'Page 3 / 9', chr(10))))) AS i FROM conversations),
s AS (SELECT conv_id, turn, trim(string_agg(trim(regexp_replace(line, '[ \t]+', ' ', 'g')), chr(10) ORDER BY i) FILTER (NOT regexp_matches(line, '(?i)^\s*(?:-?\s*\d+\s*-?|page 3 / 9)\s*$'))) AS text, avg(8 + length(line) % 5) AS size, count(*) AS n FROM l GROUP BY ALL)
SELECT conv_id, turn, regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g') AS text, round(size, 6) AS avg_font_size, round((SELECT median(x.size) FROM s x WHERE x.conv_id = s.conv_id AND x.text <> ''), 6) AS body_font FROM s WHERE text <> ''""")
def text_blocks(spark, sf_dir):
    """Blocks from a parser's spans, a line each, and the median size of a document; picture blocks and footers go."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.concat("text", F.lit("\nPage 3 / 9")), "\n", -1)).alias("line_index", "text"))
    spans = rows.select("conv_id", F.col("turn").alias("block_index"), F.lit(0).alias("block_type"), "line_index", F.lit(0).alias("span_index"), *(F.lit(1e0).alias(c) for c in ("x0", "y0", "x1", "y1")), "text", (8 + F.char_length("text") % 5).cast("double").alias("size"), F.lit("f").alias("font"))
    blocks = D.text_blocks(spans.unionByName(spans.withColumns({"block_type": F.lit(1), "size": F.lit(99e0)})), ["conv_id"])
    out = blocks.join(D.body_font(blocks, ["conv_id"]), "conv_id")
    return out.select("conv_id", F.col("block_index").alias("turn"), "text", F.round("avg_font_size", 6).alias("avg_font_size"), F.round("body_font", 6).alias("body_font"))


@query(f"WITH {_BOXES}, g AS (SELECT *, lag(y1) OVER (PARTITION BY page ORDER BY p_partkey) AS before FROM b) SELECT page::BIGINT AS page, string_agg(CASE WHEN y0 - before > 10 THEN chr(10) ELSE '' END || text, chr(10) ORDER BY p_partkey) AS text FROM g GROUP BY page")
def page_texts(spark, sf_dir):
    return C.page_text(_boxes(spark, sf_dir).withColumn("block_index", F.col("p_partkey")), ["page"]).select(F.col("page").cast("long").alias("page"), "text")


@query(f"""WITH {_CHUNKS}, p AS (SELECT *, CASE chunk_type WHEN 'table' THEN '**Table**' || chr(10) || chr(10) || '| ' || replace(replace(content, chr(10), '<br>'), '|', '\\|') || ' |' || chr(10) || '| --- |' WHEN 'visual' THEN '![visual](' || id || '.png)' ELSE content END AS body FROM chunks)
SELECT doc_name, page_number::BIGINT AS page_number, '# ' || doc_name || ', page ' || page_number || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY chunk_index, id) AS markdown FROM p GROUP BY doc_name, page_number""")
def page_markdown(spark, sf_dir):
    parts = _chunks(spark, sf_dir).select("doc_name", "page_number", F.col("chunk_type").alias("kind"), F.col("content").alias("text"), F.array(F.array("content")).alias("rows"), F.concat("id", F.lit(".png")).alias("asset"), F.col("chunk_index").alias("y0"), F.col("id").alias("place"))
    return D.page_markdown(parts, ["doc_name", "page_number"], "doc_name").select("doc_name", F.col("page_number").cast("long").alias("page_number"), "markdown")


@query(f"WITH {_BOXES} SELECT 'doc ' || page % 5 AS doc_name, count(*) FILTER (ends_with(p_brand, '1'))::BIGINT AS table_chunks, count(*) FILTER (ends_with(p_brand, '2'))::BIGINT AS visual_chunks, count(DISTINCT page)::BIGINT AS pages FROM b GROUP BY 1")
def document_job(spark, sf_dir):
    """Blocks, tables and pictures of pages to chunks, and the manifest."""
    boxes = _boxes(spark, sf_dir).select(F.concat(F.lit("doc "), (F.col("page") % 5).cast("string")).alias("doc_name"), F.col("page").alias("page_number"), F.col("p_partkey").alias("block_index"), F.col("p_partkey").alias("region_id"), "x0", "y0", "x1", "y1", "text", F.lit(9e0).alias("avg_font_size"), F.array(F.array(F.lit("name")), F.array("text")).alias("rows"), "p_brand")
    ends = lambda c: F.col("p_brand").endswith(c)
    _, manifest = D.process(boxes.where(~ends("1") & ~ends("2")), boxes.where(ends("1")), boxes.where(ends("2")))
    return manifest.select("doc_name", "table_chunks", "visual_chunks", "pages")


class Canned:
    """A generator whose answers follow from the prompt alone."""

    def generate(self, prompt: str, max_tokens: int) -> str:
        if prompt.startswith(J.CONTEXT_PROMPT):
            found = re.findall(r"^(\d+)\. \((conv \d+), page (\d+)\)$", prompt, re.M)
            return "Here:\n```json\n" + json.dumps({"contexts": [{"id": int(i), "context": f"About {d} page {p}."} for i, d, p in found]}) + "\n```"
        if prompt.startswith(J.OPTIMISE_PROMPT):
            q = prompt[len(J.OPTIMISE_PROMPT) :]
            if len(q) % 7 == 0:
                raise RuntimeError("no answer")
            return "Sure! " + json.dumps({"multi_queries": [f" {q}", f"about {q}", f"ABOUT {q}", f"more {q}"], "sub_questions": None, "step_back_query": f"why  {q}", "hyde_document": " "})
        if prompt.startswith(J.SUMMARY_PROMPT):
            return f"{len(prompt)} characters"
        if prompt.startswith(J.TESTSET_PROMPT):
            return json.dumps({"user_input": "What is " + prompt[len(J.TESTSET_PROMPT) :][:20].strip() + "?", "reference": "That."})
        found = re.findall(r"^\[(\d+-\d+)\]\n(\S+)", prompt, re.M)
        return json.dumps({"chunks": [{"chunk_id": i, "entities": [{"name": w, "type": "TEST"}]} for i, w in found]})


@query(f"WITH {_CHUNKS} SELECT id, CASE WHEN chunk_type = 'table' THEN 'cache' ELSE 'model' END AS origin, CASE WHEN chunk_type = 'table' THEN '[Known.]' ELSE '[About ' || doc_name || ' page ' || page_number || '.]' END || chr(10) || content AS content FROM chunks")
def enrich_contexts(spark, sf_dir):
    """Contexts before chunks: those of the cache, and a model's in batches of 20."""
    chunks = _chunks(spark, sf_dir).withColumn("headings", F.array().cast("array<string>"))
    cache = chunks.where("chunk_type = 'table'").select(J.context_key(chunks).alias("key"), F.lit("Known.").alias("context")).distinct()
    rows, _ = J.enrich(chunks.withColumnRenamed("id", "own"), cache, J.ask_contexts(Canned()), budget=None)
    return rows.select(F.col("own").alias("id"), "origin", "content")


@query(rf"""WITH q AS (SELECT item_id, {_FLAT('text')} AS q FROM benchmark), ok AS (SELECT *, length(q) % 7 <> 0 AS ok FROM q)
SELECT item_id, q AS original, CASE WHEN ok THEN 'about ' || q || ' / more ' || q ELSE '' END AS multi, CASE WHEN ok THEN 'why ' || q END AS step_back, 0::BIGINT AS sub FROM ok""")
def optimised_questions(spark, sf_dir):
    """One answer a question gives its rewritings, cleaned; a question without an answer stays alone."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = J.optimise(asked, Canned(), 2)
    return out.select(F.col("query_id").alias("item_id"), "original", F.array_join("multi_queries", " / ").alias("multi"), F.col("step_back_query").alias("step_back"), F.size("sub_questions").cast("long").alias("sub"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def lenient_json(spark, sf_dir):
    """JSON within a model's talk, found and parsed."""
    talk = F.concat(F.lit("Sure {not json}:\n```json\n"), F.col("props"), F.lit("\n``` done }"))
    rows = table(spark, sf_dir, "events").select("event_id", P.json_in_text(talk).alias("j"))
    return rows.select("event_id", F.coalesce(F.get_json_object("j", "$.k"), F.lit("")).alias("k"))


@query("""WITH t AS (SELECT label, vec_id, 'Vector ' || vec_id || ' of ' || label AS t FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lpad(vec_id::VARCHAR, 12, '0')) AS n, 6000 - coalesce(sum(length(t) + 1) OVER (PARTITION BY label ORDER BY lpad(vec_id::VARCHAR, 12, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t)
SELECT label::BIGINT AS cluster, count(*)::BIGINT AS children, (length('Summarise the following texts as one.') + 2 + length(string_agg(n || '. ' || left(t, room::INTEGER), chr(10) ORDER BY n) FILTER (room > 0))) || ' characters' AS summary FROM n GROUP BY label""")
def cluster_summaries(spark, sf_dir):
    """Prompts of numbered texts up to a limit, one request a cluster; the second run asks nothing."""
    rows = table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("node_id"), F.concat(F.lit("Vector "), F.col("vec_id").cast("string"), F.lit(" of "), F.col("label").cast("string")).alias("text"), F.col("label").cast("long").alias("cluster"))
    prompts = J.summary_prompts(rows.select("node_id", "cluster"), rows.select("node_id", "text"), 1000)
    cache = spark.createDataFrame([], "key string, summary string")
    _, new = J.summarise_clusters(prompts, cache, Canned())
    done, again = J.summarise_clusters(prompts, new, Canned())
    if not again.isEmpty():
        raise RuntimeError("a cached summary was asked for again")
    return done.select("cluster", "children", "summary")


@query("SELECT vec_id, 64::BIGINT AS size, label >= 5 AS embedded FROM embeddings")
def embedding_cache(spark, sf_dir):
    """Vectors from the cache where text and model are the same, else embedded."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), "label")
    none = spark.createDataFrame([], "mark string, v array<double>")
    _, cache = J.embed_cached(rows.where("label < 5"), none, P.HashingEmbedder(), "m", "vec_id")
    done, new = J.embed_cached(rows, cache, P.HashingEmbedder(), "m", "vec_id")
    mark = F.sha1(F.concat(F.lit("m\t"), F.col("vec_id").cast("string"), F.lit("\t"), F.col("text")))
    fresh = new.select(F.col("mark"), F.lit(True).alias("embedded"))
    return done.withColumn("mark", mark).join(fresh, "mark", "left").select("vec_id", F.size("v").cast("long").alias("size"), F.coalesce("embedded", F.lit(False)).alias("embedded"))


_SOURCES = "src AS (SELECT ['multi_hop', 'overview', 'table_visual'][conv_id % 3 + 1] AS category, conv_id AS id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id), chosen AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha1(id::VARCHAR), id) AS nth FROM src), c AS (SELECT * FROM chosen WHERE nth <= CASE category WHEN 'multi_hop' THEN 30 WHEN 'overview' THEN 20 ELSE 15 END)"


def _testset(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    category = F.element_at(F.array(*map(F.lit, ("multi_hop", "overview", "table_visual"))), (F.col("conv_id") % 3 + 1).cast("int"))
    sources = turns.groupBy(category.alias("category"), F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("contexts"))
    existing = turns.where("turn = 0 and conv_id % 5 = 0").select(F.col("conv_id").alias("id"), F.lit("Old?").alias("user_input"), F.when(F.col("conv_id") % 2 == 0, "Old.").alias("reference"))
    return J.generate_testset(sources, existing, Canned())


@query(f"WITH {_SOURCES} SELECT category, id, CASE WHEN id % 10 = 0 THEN 'Old?' ELSE 'What is ' || trim(left(whole, 20), ' ' || chr(10) || chr(9)) || '?' END AS user_input, CASE WHEN id % 10 = 0 THEN 'Old.' ELSE 'That.' END AS reference, CASE WHEN id % 10 = 0 THEN 'existing' ELSE 'generated' END AS origin FROM c")
def testset_generation(spark, sf_dir):
    """Questions for a number of sources of each category; valid ones that exist stay."""
    return _testset(spark, sf_dir)[0].select("category", "id", "user_input", "reference", "origin")


@query(f"WITH {_SOURCES} SELECT k AS category, w::BIGINT AS wanted, (SELECT count(*) FROM c WHERE c.category = k)::BIGINT AS rows FROM (VALUES ('multi_hop', 30), ('overview', 20), ('table_visual', 15)) v(k, w)")
def testset_manifest(spark, sf_dir):
    return _testset(spark, sf_dir)[1]


@query(r"""SELECT conv_id, turn, trim(text) AS user_input, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS contexts FROM conversations WHERE trim(text) <> ''""")
def evaluation_records(spark, sf_dir):
    """Records with contexts as JSON lists or as texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("user_input"), F.lit(" a ").alias("reference"), F.when(F.col("turn") % 2 == 0, F.lit('["one", " ", "two"]')).otherwise(F.lit("one text")).alias("reference_contexts"))
    return J.normalize_records(rows).select("conv_id", "turn", "user_input", F.size("reference_contexts").cast("long").alias("contexts"))


@query("SELECT doc_id, sha256(text) AS repaired, sha256(text) AS repaired_for_index FROM documents")
def mojibake_repair(spark, sf_dir):
    """Texts decoded with a wrong code page, repaired to what they were."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.repair_mojibake(wrong), 256).alias("repaired"), F.sha2(T.repair_mojibake(wrong, index=True), 256).alias("repaired_for_index"))


@query(rf"""WITH d AS (SELECT doc_id, text, regexp_replace(strip_accents(lower(left(text, 60))), '[^a-z0-9_.-]+', '_', 'g') AS n, regexp_extract_all(text, '\S+') AS ws FROM documents)
SELECT doc_id, CASE WHEN regexp_replace(n, '^[_.]+|[_.]+$', '', 'g') = '' THEN 'document' ELSE regexp_replace(n, '^[_.]+|[_.]+$', '', 'g') END AS name, array_to_string(ws[greatest(1, len(ws) - 6):], ' ') AS tail, sha256(ltrim(text, ' ' || chr(9) || chr(10) || chr(13))) AS plain, CASE WHEN doc_id % 3 = 0 THEN '?' ELSE doc_id % 7 || ', ' || doc_id % 9 END AS pages FROM d""")
def text_helpers(spark, sf_dir):
    """File names, last words, contents without their context, pages as a text."""
    pages = F.when(F.col("doc_id") % 3 != 0, F.array((F.col("doc_id") % 7).cast("int"), F.lit(None).cast("int"), (F.col("doc_id") % 9).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_filename(F.substring("text", 1, 60)).alias("name"), T.last_words(F.col("text"), 7).alias("tail"), F.sha2(T.strip_context(F.concat(F.lit(" [a context] "), F.col("text"))), 256).alias("plain"), T.join_pages(pages).alias("pages"))


@query("SELECT coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source, grouping_id(lang, source)::BIGINT AS level, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT text)::BIGINT AS texts FROM documents GROUP BY CUBE (lang, source)")
def corpus_cube(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").cube("lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("text").alias("texts"))
    return rows.withColumns({c: F.coalesce(c, F.lit("null")) for c in ("lang", "source")})


def _tree(spark, sf_dir) -> DataFrame:
    """Nations under regions under one root, as nodes."""
    none, key = F.array().cast("array<string>"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    children = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(key("n", "n_nationkey"))).alias("child_node_ids"))
    middle = region.join(children, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(key("r", "r_regionkey").alias("node_id"), F.lit(1).alias("depth"), F.coalesce("child_node_ids", none).alias("child_node_ids"))
    root = middle.groupBy().agg(F.array_sort(F.collect_list("node_id")).alias("child_node_ids")).select(F.lit("root").alias("node_id"), F.lit(2).alias("depth"), "child_node_ids")
    return nation.select(key("n", "n_nationkey").alias("node_id"), F.lit(0).alias("depth"), none.alias("child_node_ids")).unionByName(middle).unionByName(root)


@query("SELECT 'n' || n_nationkey AS node_id, 'r' || n_regionkey AS parent, 'n' || n_nationkey || ' > r' || n_regionkey || ' > root' AS path FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root', 'r' || r_regionkey || ' > root' FROM region UNION ALL SELECT 'root', 'NO_PARENT', 'root'")
def tree_parents(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    chains = TR.parent_chains(TR.edges(nodes), nodes.select("node_id"))
    return TR.nearest_parent(nodes).join(chains, "node_id").select("node_id", "parent", F.array_join("path", " > ").alias("path"))


@query("SELECT depth::BIGINT AS depth, count(*)::BIGINT AS nodes, sum(children)::BIGINT AS children, round(avg(CASE WHEN up THEN 1e0 ELSE 0e0 END), 6) AS matched FROM (SELECT 0 AS depth, 0 AS children, true AS up FROM nation UNION ALL SELECT 1, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey), true FROM region UNION ALL SELECT 2, (SELECT count(*) FROM region), false) GROUP BY depth")
def tree_inspection(spark, sf_dir):
    """Nodes, children and the share with a parent by depth."""
    nodes = _tree(spark, sf_dir)
    return TR.inspect(nodes).select(F.col("depth").cast("long").alias("depth"), "nodes", "children", F.round("matched", 6).alias("matched"))


@query("WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 10 MINUTE, ts), time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM w GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    out = ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "20 minutes", slide="10 minutes")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    out = ingest.session_counts(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", shown("start").alias("start"), shown("end").alias("stop"), "n")


@query(rf"""WITH v AS (SELECT item_id, unnest(['The answer: ' || left(text, 30), split_part(text, '.', 1), lower(split_part(text, '.', 1))]) AS t, unnest(['hyde', 'multi_1', 'sub_1']) AS name, unnest([1.1e0, 0.85e0, 0.9e0]) AS weight, unnest([0, 1, 2]) AS pos FROM benchmark),
k AS (SELECT *, {_FLAT('t')} AS text, row_number() OVER (PARTITION BY item_id, lower({_FLAT('t')}) ORDER BY pos) AS nth FROM v) SELECT item_id, name, text, weight FROM k WHERE text <> '' AND nth = 1""")
def dense_variants(spark, sf_dir):
    first = F.split_part("text", F.lit("."), F.lit(1))
    bundle = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("original"), F.concat(F.lit("The answer: "), F.substring("text", 1, 30)).alias("hyde_document"), F.array(first).alias("multi_queries"), F.array(F.lower(first)).alias("sub_questions"), F.lit(None).cast("string").alias("step_back_query"))
    return R.variants(bundle)[1].select(F.col("query_id").alias("item_id"), "name", "text", "weight")


@query("SELECT doc_id, regexp_matches(strip_accents(lower(text)), 'anh|bieu do|chart|diagram|figure|hinh|image|minh hoa|so do|visual') AS visual FROM documents")
def visual_questions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.mentions_visual(F.col("text")).alias("visual"))


@query("SELECT item_id, 'Answer only from the numbered sources and name them.' || chr(10) || chr(10) || '[Source 1] x' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM benchmark")
def answer_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", P.answer_prompt(F.col("text"), F.lit("[Source 1] x")).alias("prompt"))


@query("SELECT 'community:' || lpad((row_number() OVER (ORDER BY count(*) DESC, min('n' || n_nationkey)))::VARCHAR, 4, '0') AS community_id, n_regionkey::BIGINT AS community, count(*)::BIGINT AS size FROM nation GROUP BY n_regionkey")
def community_numbers(spark, sf_dir):
    members = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_regionkey").cast("long").alias("community"))
    return G.number_communities(members).select("community_id", "community", "size")


@query(f"WITH {_CHUNKS} SELECT id AS chunk_id, coalesce(regexp_extract(content, '^(\\S+)', 1), '') AS name FROM chunks")
def extraction_job(spark, sf_dir):
    """Entities of all chunks, asked for in batches of 20; the second run finds all in the cache."""
    chunks = _chunks(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    ask = K.extractor(Canned())
    cache = spark.createDataFrame([], "chunk_id string, reply string")
    _, new = K.extract(chunks, cache, ask, budget=None)
    done, again = K.extract(chunks, new, ask, budget=None)
    return done.select("chunk_id", F.coalesce(F.get("entities", F.lit(0))["name"], F.lit("")).alias("name"))


@query(r"SELECT item_id, least(len(regexp_extract_all(text, '\S+')), 16)::BIGINT AS tokens, 8::BIGINT AS size FROM benchmark")
def token_encoding(spark, sf_dir):
    out = S.token_matrices(table(spark, sf_dir, "benchmark"), P.HashingEmbedder(8), "item_id", most=16)
    return out.select("item_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.get("tokens", F.lit(0))).cast("long").alias("size"))


_PYWORDS = lambda t: rf"list_distinct(regexp_extract_all(lower({t}), '\S+'))"


@query(f"""WITH {_DENSE}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS prior FROM de) WHERE prior <= 15),
s AS (SELECT r.*, CASE WHEN prior <= 10 THEN len(list_intersect({_PYWORDS('b.text')}, {_PYWORDS('d.text')}))::DOUBLE / greatest(len({_PYWORDS('b.text')}), 1) END AS rr FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, round(rr, 6) AS rerank_score, row_number() OVER (PARTITION BY item_id ORDER BY rr IS NULL, rr DESC, prior, doc_id)::BIGINT AS rank FROM s""")
def cross_encoder_rerank(spark, sf_dir):
    """The head of dense hits in the order of a pair model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = _channels(docs)["dense"](asked, 15)
    out = S.rerank_by(hits, asked, docs, S.model_scorer(P.OverlapReranker()), S.RERANK_PRESETS["fast"], "doc_id")
    return out.select(F.col("query_id").alias("item_id"), "doc_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


_PATHS = _HEAD[: _HEAD.index("\nSELECT doc_id, count(*)")].replace("SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, trim(unnest(string_split(text, chr(10)))) AS t FROM documents")
_LEVEL = "CASE WHEN num THEN least(5, len(string_split(regexp_extract(t, '^([0-9]+(?:\\.[0-9]+){0,5})\\.?\\s', 1), '.'))) WHEN roman THEN 1 WHEN letter THEN 2 WHEN starts THEN 3 ELSE 2 END"
_LAST = ", ".join(f"last_value(CASE WHEN heading AND level = {n} THEN {{'s': section, 't': t}} END IGNORE NULLS) OVER w AS h{n}" for n in range(1, 6))
_PATH = ", ".join(f"CASE WHEN h{n} IS NOT NULL AND {' AND '.join(['true', *(f'coalesce(h{m}.s, -1) < h{n}.s' for m in range(1, n))])} THEN h{n}.t END" for n in range(1, 6))


@query(f"""{_PATHS}, lv AS (SELECT *, {_LEVEL} AS level, sum(heading::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM h),
la AS (SELECT *, {_LAST} FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT doc_id, section, array_to_string(list_filter(any_value([{_PATH}]), lambda x: x IS NOT NULL), ' > ') AS path, string_agg(line, chr(10) ORDER BY i) FILTER (NOT heading) AS body FROM la GROUP BY doc_id, section)
SELECT doc_id, section::BIGINT AS section, path, sha256(body) AS body FROM sec WHERE trim(body) <> ''""")
def section_paths(spark, sf_dir):
    """Sections under their running heading path."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "line"))
    return C.sections(lines, ["doc_id"]).select("doc_id", F.col("section").cast("long").alias("section"), F.array_join("headings", " > ").alias("path"), F.sha2("body", 256).alias("body"))


@query("SELECT conv_id AS doc, count(*)::BIGINT AS pages FROM (SELECT DISTINCT conv_id, turn // 2 AS page FROM conversations WHERE NOT (role = 'tool' OR turn % 7 = 6)) GROUP BY conv_id")
def evaluation_chunks(spark, sf_dir):
    """Chunks read for evaluation, as documents of a page each."""
    path = scratch_path(spark)
    files.write_jsonl(_chunks(spark, sf_dir), f"{path}/chunks.jsonl")
    pages = E.page_documents(files.load_evaluation_chunks(spark, path, "*.json"), ["doc_name", "page_number"])
    return pages.groupBy(F.regexp_extract("doc_name", r"(\d+)", 1).cast("long").alias("doc")).agg(F.count("*").alias("pages"))
