"""Queries on texts: normalisation, chunking, layout, evaluation sets, bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import layout as L
from gristmill.functions import text as T
from gristmill.operators import chunking as C
from gristmill.operators import evaluation as E
from gristmill.operators.lineage import numbered_within, scratch_path
from gristmill.plans.base import query, table, terms_sql

_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS words, greatest(1, ceil(len(regexp_extract_all(text, '\S+')) * 1.3e0))::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_words(F.col("text")).alias("words"), T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substr(sha1(source || '|' || doc_id || '|text|0|' || left(text, 120)), 1, 16) AS id, substr(sha1(coalesce(lang, 'None') || '||' || n_chars), 1, 16) AS short_id FROM documents")
def stable_chunk_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.stable_id(F.col("source"), F.col("doc_id"), F.lit("text"), F.lit(0), F.substring("text", 1, 120)).alias("id"), T.stable_id(F.col("lang"), F.col("n_chars"), separator="||").alias("short_id"))


@query("SELECT doc_id, sha256(strip_accents(lower(text))) AS folded FROM documents")
def fold_search_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query(f"SELECT doc_id, {_FLAT} AS flat, CASE WHEN length({_FLAT}) > 450 THEN rtrim(left({_FLAT}, 447)) || '...' ELSE {_FLAT} END AS snippet FROM documents")
def normalize_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("flat"), T.snippet(F.col("text")).alias("snippet"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(html, '&amp;', ' ≥ '), '</p>', '-' || chr(10)), '%%%', ' µg '), '$$$', '²'), '([²])', '^\1', 'g'), '²', '2', 'g') AS x FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(x, '≥', ' >= '), 'µ', 'micro'), '(?i)\bmicro\s*g\b', 'mcg', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS x FROM t)
SELECT page_id, sha256(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS normal FROM s""")
def normalize_symbols(spark, sf_dir):
    marked = F.col("html")
    for a, b in (("&amp;", " ≥ "), ("</p>", "-\n"), ("%%%", " µg "), ("$$$", "²")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.normalize_document(marked), 256).alias("normal"))


@query(r"SELECT doc_id, sha256(array_to_string(list_filter(string_split(text || chr(10) || 'Page 3 / 9' || chr(10) || '- 12 -' || chr(10) || '7', chr(10)), lambda l: NOT regexp_matches(l, '(?i)^\s*(?:-?\s*\d+\s*-?|/\s*\d+\s*/?|(?:page|trang)\s+\d+(?:\s*(?:/|of)\s*\d+)?)\s*$')), chr(10))) AS kept FROM documents")
def footer_removal(spark, sf_dir):
    paged = F.concat("text", F.lit("\nPage 3 / 9\n- 12 -\n7"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.remove_footers(paged), 256).alias("kept"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;:])\s+([A-ZÀ-Ỵ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS sentences FROM documents")
def sentence_split_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(f"WITH {terms_sql('documents', 'doc_id')} SELECT d.doc_id, count(token)::BIGINT AS n_terms, count(DISTINCT token)::BIGINT AS n_distinct, coalesce(min(token), '') AS first, coalesce(max(token), '') AS last FROM documents d LEFT JOIN terms USING (doc_id) GROUP BY d.doc_id")
def tokenize_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.array_min("t"), F.lit("")).alias("first"), F.coalesce(F.array_max("t"), F.lit("")).alias("last"))


_ROMAN = L.ROMAN
_HEAD = rf"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
f AS (SELECT *, len(regexp_extract_all(t, '\S+')) AS w, strip_accents(lower(t)) AS low, regexp_matches(t, '^\s*[0-9]+(?:\.[0-9]+){{0,5}}\.?\s+\S') AS num, regexp_matches(t, '(?i)^\s*[A-Z]\.\s+\S') AS letter,
  regexp_extract(t, '(?i)^\s*([IVXLCDM]+)\.?\s+\S', 1) AS head FROM l),
k AS (SELECT *, head <> '' AS romanlike, head <> '' AND regexp_full_match(upper(head), '{_ROMAN}') AS roman, low IN ({", ".join(f"'{x}'" for x, _ in L.KEYWORDS)}) OR {" OR ".join(f"starts_with(low, '{x}:')" for x, _ in L.KEYWORDS)} AS keyword, {" OR ".join(f"starts_with(low, '{x}')" for x, _ in L.KEYWORDS)} AS starts FROM f),
h AS (SELECT *, CASE WHEN t = '' OR length(t) > 160 THEN false WHEN keyword THEN true WHEN (num OR romanlike OR letter) AND NOT (romanlike AND NOT num AND NOT roman AND NOT letter) THEN w <= 16
  ELSE (ends_with(t, ':') AND starts) OR (upper(t) = t AND lower(t) <> t AND length(t) BETWEEN 5 AND 120 AND w <= 14) END AS heading FROM k)
SELECT doc_id, count(*) FILTER (heading)::BIGINT AS headings, count(*)::BIGINT AS n_lines,
  coalesce(sum(CASE WHEN NOT heading THEN 0 WHEN num THEN least(5, len(string_split(regexp_extract(t, '^([0-9]+(?:\.[0-9]+){{0,5}})\.?\s', 1), '.'))) WHEN roman THEN 1 WHEN letter THEN 2 WHEN starts THEN 3 ELSE 2 END), 0)::BIGINT AS levels FROM h GROUP BY doc_id"""


@query(_HEAD)
def heading_detect(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    marked = lines.select("doc_id", L.is_heading(F.col("line")).alias("h"), L.heading_level(F.col("line")).alias("level"))
    return marked.groupBy("doc_id").agg(F.count_if("h").alias("headings"), F.count("*").alias("n_lines"), F.sum(F.when(F.col("h"), F.col("level")).otherwise(0)).cast("long").alias("levels"))


_POS = ", ".join(f"{{'p': CASE WHEN {f'''len(regexp_extract(low, '(?s)^(.*?)\\b{k}\\b')) > 0''' if len(k) <= 3 else f'''contains(low, '{k}')'''} THEN {f'''length(regexp_extract(low, '(?s)^(.*?)\\b{k}\\b', 1)) + 1''' if len(k) <= 3 else f'''strpos(low, '{k}')'''} END, 'i': {i}, 'b': '{b}'}}" for i, (k, b) in enumerate(L.KEYWORDS))


@query(f"WITH t AS (SELECT page_id, strip_accents(lower(url || ' ' || html)) AS low FROM pages), p AS (SELECT page_id, list_filter([{_POS}], lambda x: x.p IS NOT NULL) AS found FROM t) SELECT page_id, coalesce(list_min(found).b, 'general') AS bucket FROM p")
def semantic_bucket(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", L.semantic_bucket(F.concat_ws(" ", "url", "html")).alias("bucket"))


@query()
def section_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "line"))
    return C.chunk_sections(C.sections(lines, ["doc_id"]), ["doc_id"])


@query()
def fallback_chunks(spark, sf_dir):
    return C.chunk_texts(table(spark, sf_dir, "documents"))


@query(f"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM (SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS k FROM documents) WHERE k <> '' GROUP BY k")
def dedup_signature(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = C.distinct_by_signature(docs, F.col("text"), [], "doc_id")
    keyed = lambda rows: rows.select("doc_id", F.sha1(T.squeeze(T.fold(F.col("text")))).alias("key"))
    copies = keyed(docs).groupBy("key").agg(F.count("*").alias("copies"))
    return keyed(first).join(copies, "key").select("doc_id", "copies")


@query(r"""WITH s AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(string_split(replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda x: trim(x) <> '') AS p FROM documents)),
w AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(s), '\p{L}{3,}')) AS w FROM s), f AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY ALL),
sc AS (SELECT doc_id, pos, sum(f) AS score FROM w JOIN f USING (doc_id, w) GROUP BY ALL),
r AS (SELECT doc_id, pos, s, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM s JOIN sc USING (doc_id, pos))
SELECT doc_id, left(string_agg(trim(s), ' ' ORDER BY pos), 1500) AS summary FROM r WHERE r <= 4 GROUP BY doc_id""")
def extractive_summary(spark, sf_dir):
    return E.extractive_summary(table(spark, sf_dir, "documents"))


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("page"), (F.col("p_partkey") % 97).cast("double").alias("x0"), (F.col("p_partkey") % 89).cast("double").alias("y0"), (F.col("p_partkey") % 97 + 5 + F.col("p_size") % 3).cast("double").alias("x1"), (F.col("p_partkey") % 89 + 4).cast("double").alias("y1"), F.col("p_name").alias("text"), F.col("p_brand"))


_BOXES = "b AS (SELECT p_partkey, p_size AS page, (p_partkey % 97)::DOUBLE AS x0, (p_partkey % 89)::DOUBLE AS y0, (p_partkey % 97 + 5 + p_size % 3)::DOUBLE AS x1, (p_partkey % 89 + 4)::DOUBLE AS y1, p_name AS text, p_brand FROM part)"


@query(f"WITH {_BOXES}, t AS (SELECT * FROM b WHERE ends_with(p_brand, '1')) SELECT p_partkey, page::BIGINT AS page FROM b WHERE NOT ends_with(p_brand, '1') AND NOT EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0)")
def bbox_anti_join(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return C.outside(boxes.where(~F.col("p_brand").endswith("1")), boxes.where(F.col("p_brand").endswith("1")), ["page"]).select("p_partkey", F.col("page").cast("long").alias("page"))


@query(f"WITH {_BOXES}, p AS (SELECT r.page, r.p_partkey AS region_id, b.text, row_number() OVER (PARTITION BY r.page, r.p_partkey ORDER BY CASE WHEN r.x0 < b.x1 AND r.x1 > b.x0 AND r.y0 < b.y1 AND r.y1 > b.y0 THEN 0e0 ELSE abs(r.y0 - b.y0) + abs(r.x0 - b.x0) END, b.p_partkey) AS n FROM b r JOIN b ON r.page = b.page WHERE ends_with(r.p_brand, '1') AND NOT ends_with(b.p_brand, '1'))\n"
       "SELECT region_id, left(string_agg(text, chr(10) ORDER BY n), 600) AS near FROM p WHERE n <= 4 GROUP BY region_id")  # fmt: skip
def nearest_text_k4(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).withColumn("block_index", F.col("p_partkey"))
    regions = boxes.where(F.col("p_brand").endswith("1")).select("page", F.col("p_partkey").alias("region_id"), "x0", "y0", "x1", "y1")
    return C.nearest_texts(regions, boxes.where(~F.col("p_brand").endswith("1")), ["page"]).select("region_id", "near")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, '| ' || r_name || ' | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def table_to_markdown(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    cells = F.concat(F.array(F.array(F.col("r_name"), F.lit("nation"))), F.transform("n", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select(F.col("r_regionkey").cast("long").alias("r_regionkey"), T.markdown_table(cells).alias("markdown"))


@query(r"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part),
c AS (SELECT p_brand, p, i // p AS table_no, list([p_name, p_type, p_size::VARCHAR] ORDER BY i) AS rows FROM n, (VALUES (1), (5), (9)) v(p) GROUP BY p_brand, p, i // p),
x AS (SELECT p_brand, p, table_no, rows, list_filter(flatten(rows), lambda c: trim(c) <> '') AS filled FROM c),
m AS (SELECT *, len(list_filter(filled, lambda c: regexp_full_match(c, '\p{L}{1,3}'))) / len(filled)::DOUBLE AS short, len(list_filter(rows, lambda r: len(list_filter(r, lambda c: regexp_full_match(c, '\p{L}{1,3}'))) >= 2)) / len(rows)::DOUBLE AS frag,
  len(list_filter(filled, lambda c: regexp_matches(c, '^\p{Ll}'))) / len(filled)::DOUBLE AS low, array_to_string(filled, ' ') AS whole FROM x),
l AS (SELECT *, len(rows) >= 2 AND list_sum(list_transform(filled, lambda c: length(c))) >= 12 AND len(filled) >= 4 AS lined FROM m)
SELECT p_brand, p::BIGINT AS cut, table_no::BIGINT AS table_no, len(rows)::BIGINT AS n_rows, lined,
  lined AND NOT ((short >= 0.5 AND frag >= 0.35) OR low >= 0.22 OR len(regexp_extract_all(whole, '\.\.\.')) >= 3 OR len(regexp_extract_all(whole, '\.')) / length(whole)::DOUBLE >= 0.08 OR len(rows) < 3 OR (short >= 0.4 AND frag >= 0.25)) AS aligned FROM l""")
def looks_like_table(spark, sf_dir):
    """Verdicts on tables: all parts of a brand, cut into consecutive tables of one, five and nine rows."""
    parts = numbered_within(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size"), "p_brand", "p_partkey", "at").withColumn("at", F.col("at") - 1).withColumn("cut", F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 5, 9)))))
    row = F.struct("at", F.array(F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")).alias("cells"))
    tables = parts.groupBy("p_brand", "cut", F.expr("at div cut").alias("table_no")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("cells"))
    rows = F.col("rows")
    return tables.withColumn("rows", L.clean_rows(F.col("cells"))).select("p_brand", "cut", "table_no", F.size("cells").cast("long").alias("n_rows"), L.looks_like_table(rows).alias("lined"), L.looks_like_table(rows, F.lit("text")).alias("aligned"))


def _turns(spark, sf_dir):
    """Conversations as pages: a turn is a chunk; tools make tables."""
    kind = F.when(F.col("role") == "tool", "table").when(F.col("turn") % 7 == 6, "visual").otherwise("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).cast("long").alias("page"), F.col("turn").alias("chunk_index"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("chunk_type"), F.col("text").alias("content"))


_TURNS = "turns AS (SELECT conv_id AS doc, (turn // 2)::BIGINT AS page, turn AS chunk_index, conv_id || ':' || turn AS id, CASE WHEN role = 'tool' THEN 'table' WHEN turn % 7 = 6 THEN 'visual' ELSE 'text' END AS chunk_type, text AS content FROM conversations),\npage_docs AS (SELECT doc, page, left(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id, content), 12000) AS content, string_agg(id, ' ' ORDER BY chunk_index, id, content) AS ids FROM turns WHERE chunk_type = 'text' GROUP BY ALL)"


@query(f"WITH {_TURNS} SELECT doc, page, content, ids FROM page_docs")
def page_documents(spark, sf_dir):
    return E.page_documents(_turns(spark, sf_dir), ["doc", "page"]).select("doc", "page", "content", F.array_join("chunk_ids", " ").alias("ids"))


@query("WITH p AS (SELECT DISTINCT conv_id AS doc, turn AS page FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS rn FROM p), s AS (SELECT doc, unnest(range(0, (max(rn) + 1)::BIGINT, 2)) AS start FROM n GROUP BY doc)\n"
       "SELECT doc, start::BIGINT AS start, string_agg(page, ',' ORDER BY page) AS pages FROM s JOIN n USING (doc) WHERE rn BETWEEN start AND start + 3 GROUP BY ALL HAVING count(*) >= 3")  # fmt: skip
def overview_windows(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page")).distinct()
    return E.overview_windows(pages, "doc", "page", window=4, stride=2).select("doc", F.col("start").cast("long").alias("start"), F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query(f"WITH {_TURNS} SELECT t.doc, t.page, t.id, t.chunk_type, left(p.content, 4000) AS page_text FROM turns t LEFT JOIN page_docs p USING (doc, page) WHERE chunk_type IN ('table', 'visual')")
def table_visual_context(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return E.modality_context(turns, E.page_documents(turns, ["doc", "page"]), ["doc", "page"]).select("doc", "page", "id", "chunk_type", "page_text")


@query(f"WITH {_TURNS} SELECT doc, string_agg(DISTINCT page, ',' ORDER BY page) AS pages, string_agg(DISTINCT chunk_type, ',' ORDER BY chunk_type) AS types, count(DISTINCT id)::BIGINT AS n_ids FROM turns GROUP BY doc")
def provenance_extract(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    source = F.struct(F.array("id").alias("chunk_ids"), F.array(F.col("doc").cast("string")).alias("docs"), F.array(F.col("page").cast("int")).alias("pages"), F.array("chunk_type").alias("types"))
    contexts = turns.select("doc", E.with_marker(F.col("content"), source).alias("c")).groupBy("doc").agg(F.collect_list("c").alias("contexts"))
    contexts = contexts.withColumn("contexts", F.concat("contexts", F.array(F.lit("<!-- source: {bad} -->"))))
    out = E.extract_provenance(contexts, "contexts", ["doc"])
    return out.select("doc", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), F.array_join("types", ",").alias("types"), F.size("chunk_ids").cast("long").alias("n_ids"))


@query(f"WITH {_TURNS}, d AS (SELECT doc, CASE WHEN doc % 3 = 0 THEN 'multi_hop' WHEN doc % 3 = 1 THEN 'overview' ELSE 'table_visual' END AS category, count(DISTINCT page) AS pages, bool_or(chunk_type IN ('table', 'visual')) AS shown FROM turns GROUP BY doc)\n"
       "SELECT category, count(*)::BIGINT AS rows, count(*) FILTER (NOT CASE category WHEN 'multi_hop' THEN pages >= 2 WHEN 'overview' THEN pages >= 3 ELSE shown END)::BIGINT AS bad, 30::BIGINT AS wanted, count(*) = 30 AND count(*) FILTER (NOT CASE category WHEN 'multi_hop' THEN pages >= 2 WHEN 'overview' THEN pages >= 3 ELSE shown END) = 0 AS valid FROM d GROUP BY category")  # fmt: skip
def category_validation(spark, sf_dir):
    docs = _turns(spark, sf_dir).groupBy("doc").agg(F.collect_set("page").alias("source_pages"), F.collect_set("chunk_type").alias("source_types"))
    category = F.when(F.col("doc") % 3 == 0, "multi_hop").when(F.col("doc") % 3 == 1, "overview").otherwise("table_visual")
    return E.violations(docs.withColumn("category", category), {"multi_hop": 30, "overview": 30, "table_visual": 30}).select("category", "rows", "bad", "wanted", "valid")


@query("SELECT doc_id, 'cached' AS state FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'pending' FROM documents ANTI JOIN labels USING (doc_id)")
def cache_pending(spark, sf_dir):
    from gristmill.sources.store import Table

    docs, known = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    cache = Table(spark, scratch_path(spark), "doc_id", "doc_id long, quality int")
    cache.put(known)
    return docs.join(cache.read(), "doc_id", "left_semi").withColumn("state", F.lit("cached")).unionByName(cache.pending(docs).withColumn("state", F.lit("pending")))


@query("SELECT doc_id, '[From document ' || source || ', page ' || (doc_id % 9) || CASE WHEN lang = 'en' THEN '' ELSE ', section ' || lang END || '.]' || chr(10) || text AS content FROM documents")
def context_fallback(spark, sf_dir):
    from gristmill.operators.providers import fallback_context

    docs = table(spark, sf_dir, "documents")
    heads = F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.array("lang"))
    return docs.select("doc_id", F.concat(fallback_context(F.col("source"), (F.col("doc_id") % 9).cast("int"), heads), F.lit("\n"), F.col("text")).alias("content"))


_HALVES = ", ".join(f"sum(('0x' || substr(h, {at}, 8))::BIGINT)::BIGINT AS s{i}" for i, at in enumerate((1, 9, 17, 25, 33)))


@query(f"""WITH d AS (SELECT source, sha1(coalesce(doc_id::VARCHAR, '') || chr(9) || coalesce(text, '')) AS h FROM documents), s AS (SELECT source, count(*)::BIGINT AS n, {_HALVES} FROM d GROUP BY source)
SELECT source, n, sha1(concat_ws(':', n, s0, s1, s2, s3, s4)) AS fingerprint FROM s""")
def corpus_fingerprint(spark, sf_dir):
    return T.group_fingerprints(table(spark, sf_dir, "documents"), ["source"], [F.col("doc_id"), F.col("text")])


@query(f"WITH {_TURNS}, c AS (SELECT doc, page, count(*) AS chunks, count(*) FILTER (chunk_type = 'table') AS tables, count(*) FILTER (chunk_type = 'visual') AS visuals FROM turns GROUP BY ALL)\n"
       "SELECT doc, page, chunks::BIGINT AS chunks, tables::BIGINT AS tables, visuals::BIGINT AS visuals, sum(chunks) OVER (PARTITION BY doc ORDER BY page)::BIGINT AS chunks_so_far FROM c")  # fmt: skip
def manifest_counts(spark, sf_dir):
    per_page = _turns(spark, sf_dir).groupBy("doc", "page").agg(F.count("*").alias("chunks"), F.count_if(F.col("chunk_type") == "table").alias("tables"), F.count_if(F.col("chunk_type") == "visual").alias("visuals"))
    return per_page.withColumn("chunks_so_far", F.sum("chunks").over(Window.partitionBy("doc").orderBy("page")))
