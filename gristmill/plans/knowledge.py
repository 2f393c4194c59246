"""The knowledge graph of trade between nations, end to end: an order is a chunk, its lines are what was extracted from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import knowledge as K
from gristmill.operators import graph as G
from gristmill.operators.lineage import cut, parted, scratch_path, stored
from gristmill.plans.base import query, table


def _lines(spark, sf_dir) -> DataFrame:
    """A row for each line: both nations' names, and what the extraction of it says.

    Orders find their customers first, so lines are shuffled once, by the order; nations get their names last.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap(F.lower("n_name")).alias("name"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("doc_name"), (F.col("o_orderkey") % 7).cast("int").alias("page_number"), F.col("o_orderstatus").alias("chunk_type"))
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_partkey")
    rows = parted(rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")), lines, "l_orderkey")
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    for key, name in (("s_nationkey", "sn"), ("c_nationkey", "tn")):
        joined = joined.join(F.broadcast(nation.select(F.col("n_nationkey").alias(f"__{name}"), F.col("name").alias(name))), F.col(key) == F.col(f"__{name}"))
    return joined.select("l_orderkey", "l_linenumber", "doc_name", "page_number", "chunk_type", "sn", "tn", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")


def _extractions(spark, sf_dir) -> DataFrame:
    """(chunk columns, entities, relations): suppliers' nations are mentioned (DRUG, or TEST for returns); customers' only by relations, but for status F."""
    rows = _lines(spark, sf_dir).withColumn("at", F.col("l_linenumber"))
    item = F.struct("at", "l_partkey", "l_suppkey", "sn", "tn", "l_returnflag", "l_linestatus")  # line numbers may repeat
    grouped = rows.groupBy("l_orderkey", "doc_name", "page_number", "chunk_type").agg(F.array_sort(F.collect_list(item)).alias("x"))

    def entities(x):
        kind = F.when(x["l_returnflag"] == "R", "test").otherwise("drug")
        part = F.concat(F.lit("part "), (x["l_partkey"] % 5).cast("string"))
        return F.array_compact(F.array(F.struct(x["sn"].alias("name"), kind.alias("type"), part.alias("description")), F.when(x["l_linestatus"] == "F", F.struct(x["tn"].alias("name"), F.lit("odd").alias("type"), F.lit("").alias("description")))))

    def relation(x):
        return F.struct(x["sn"].alias("source"), x["tn"].alias("target"), F.when(x["l_returnflag"] == "R", "returns to").otherwise("ships").alias("type"), F.concat(F.lit("line "), x["at"].cast("string")).alias("description"))

    return grouped.select(F.format_string("c%08d", "l_orderkey").alias("chunk_id"), "doc_name", "page_number", "chunk_type", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("content"), F.flatten(F.transform("x", entities)).alias("entities"), F.transform("x", relation).alias("relations"))


_ID = lambda n: f"'entity:' || substr(sha1(lower({n})), 1, 16)"
_KNOWN = f"""l AS (SELECT printf('c%08d', o_orderkey) AS chunk_id, o_orderpriority AS doc_name, (o_orderkey % 7)::INTEGER AS page_number, o_orderstatus AS chunk_type, 'order ' || o_orderkey AS content, l_linenumber AS ln,
    upper(s.n_name[1]) || lower(s.n_name[2:]) AS sn0, upper(c.n_name[1]) || lower(c.n_name[2:]) AS tn0, s.n_name AS sraw, c.n_name AS traw, l_returnflag AS rf, l_linestatus AS ls, 'part ' || l_partkey % 5 AS pd, l_partkey AS pk, l_suppkey AS sk
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey),
nm AS (SELECT n_name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nice FROM nation),
ll AS (SELECT l.* EXCLUDE (sn0, tn0), a.nice AS sn, b.nice AS tn FROM l JOIN nm a ON sraw = a.n_name JOIN nm b ON traw = b.n_name),
m0 AS (SELECT chunk_id, doc_name, page_number, chunk_type, content, ln, pk, sk, 0 AS side, sn AS name, CASE WHEN rf = 'R' THEN 'TEST' ELSE 'DRUG' END AS type, pd AS description FROM ll
  UNION ALL SELECT chunk_id, doc_name, page_number, chunk_type, content, ln, pk, sk, 1, tn, 'OTHER', '' FROM ll WHERE ls = 'F'),
ment AS (SELECT *, {_ID('name')} AS key, row_number() OVER (ORDER BY page_number, chunk_id, ln, pk, sk, side) AS seq FROM m0),
r0 AS (SELECT *, CASE WHEN rf = 'R' THEN 'RETURNS_TO' ELSE 'SHIPS' END AS type, 'line ' || ln AS description, {_ID('sn')} AS source, {_ID('tn')} AS target, row_number() OVER (ORDER BY page_number, chunk_id, ln, pk, sk) AS seq FROM ll WHERE lower(sn) <> lower(tn)),
ends AS (SELECT chunk_id, doc_name, page_number, chunk_type, content, seq, unnest([source, target]) AS key, unnest([sn, tn]) AS name FROM r0),
lone AS (SELECT DISTINCT ON (key) * FROM ends WHERE key NOT IN (SELECT key FROM ment) ORDER BY key, seq),
every AS (SELECT key, name, type, description, seq, chunk_id, doc_name, page_number, chunk_type, content FROM ment UNION ALL SELECT key, name, 'OTHER', '', seq, chunk_id, doc_name, page_number, chunk_type, content FROM lone),
ty AS (SELECT key, arg_max(type, n * 1000000000::HUGEINT - first) AS type FROM (SELECT key, type, count(*) AS n, min(seq) AS first FROM every GROUP BY ALL) GROUP BY key),
de AS (SELECT key, string_agg(description, ' ' ORDER BY first) AS description FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first) AS n FROM (SELECT key, description, min(seq) AS first FROM every WHERE description <> '' GROUP BY ALL)) WHERE n <= 3 GROUP BY key),
ev AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first, chunk_id) AS n FROM (SELECT key, chunk_id, min(seq) AS first, any_value(doc_name) AS doc_name, any_value(page_number) AS page_number, any_value(chunk_type) AS chunk_type, any_value(content) AS content FROM every GROUP BY key, chunk_id)),
base AS (SELECT key, arg_min(name, seq) AS name, count(DISTINCT chunk_id)::BIGINT AS mention_count FROM every GROUP BY key),
ent AS (SELECT b.key, b.name, type, coalesce(description, '') AS description, mention_count, e.chunks, e.shown, e.docs, e.pages FROM base b JOIN ty USING (key) LEFT JOIN de USING (key)
  JOIN (SELECT key, string_agg(chunk_id, ' ' ORDER BY n) AS chunks, string_agg('- ' || content, chr(10) ORDER BY n) AS shown, string_agg(DISTINCT doc_name, ',' ORDER BY doc_name) AS docs, string_agg(DISTINCT page_number, ',' ORDER BY page_number) FILTER (page_number <> 0) AS pages FROM ev WHERE n <= 5 GROUP BY key) e USING (key)),
rel AS (SELECT source, target, type, count(*)::BIGINT AS weight, count(DISTINCT chunk_id)::BIGINT AS evidence_count FROM r0 GROUP BY ALL),
rd AS (SELECT source, target, type, string_agg(description, ' ' ORDER BY first) AS description FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY first) AS n FROM (SELECT source, target, type, description, min(seq) AS first FROM r0 GROUP BY ALL)) WHERE n <= 3 GROUP BY ALL),
rv AS (SELECT source, target, type, string_agg(chunk_id, ' ' ORDER BY n) AS chunks, string_agg('- ' || content, chr(10) ORDER BY n) AS shown, string_agg(DISTINCT doc_name, ',' ORDER BY doc_name) AS docs, string_agg(DISTINCT page_number, ',' ORDER BY page_number) FILTER (page_number <> 0) AS pages
  FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY first, chunk_id) AS n FROM (SELECT source, target, type, chunk_id, min(seq) AS first, any_value(content) AS content, any_value(doc_name) AS doc_name, any_value(page_number) AS page_number FROM r0 GROUP BY source, target, type, chunk_id)) WHERE n <= 5 GROUP BY ALL)"""


def _graph(spark, sf_dir) -> dict[str, DataFrame]:
    return K.build_graph(_extractions(spark, sf_dir), communities=False)


@query(f"WITH {_KNOWN} SELECT key, name, type, description, mention_count, chunks FROM ent")
def graph_build_entities(spark, sf_dir):
    chunks = F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), " ")
    return _graph(spark, sf_dir)["entities"].select("key", "name", "type", "description", "mention_count", chunks.alias("chunks"))


@query(f"WITH {_KNOWN} SELECT r.*, rd.description, rv.chunks FROM rel r JOIN rd USING (source, target, type) JOIN rv USING (source, target, type)")
def graph_build_relations(spark, sf_dir):
    chunks = F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), " ")
    return _graph(spark, sf_dir)["relations"].select("source", "target", "type", "weight", "evidence_count", "description", chunks.alias("chunks"))


@query(f"WITH {_KNOWN} SELECT 'entity' AS kind, type AS name, count(*)::BIGINT AS n FROM ent GROUP BY type UNION ALL SELECT 'relation', type, count(*)::BIGINT FROM rel GROUP BY type")
def graph_stats(spark, sf_dir):
    return _graph(spark, sf_dir)["stats"]


_DOCS = f"""named AS (SELECT r.*, rd.description, rv.shown, rv.docs, rv.pages, rv.chunks, a.name AS sn, b.name AS tn FROM rel r JOIN rd USING (source, target, type) JOIN rv USING (source, target, type) JOIN ent a ON a.key = source JOIN ent b ON b.key = target),
side AS (SELECT *, source AS key, tn AS other FROM named UNION ALL SELECT *, target, sn FROM named),
lns AS (SELECT key, string_agg(sn || ' --' || type || '--> ' || tn, chr(10) ORDER BY n) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, sn, type, tn) AS n FROM side) WHERE n <= 20 GROUP BY key),
nr AS (SELECT key, string_agg(other, ', ' ORDER BY n) AS near FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC, other) AS n FROM (SELECT key, other, sum(weight) AS w FROM side GROUP BY ALL)) WHERE n <= 12 GROUP BY key),
gdoc AS (SELECT key AS node_id, 'entity' AS graph_kind, concat_ws(chr(10), 'Entity: ' || name, 'Type: ' || type, CASE WHEN description <> '' THEN 'Description: ' || description END, 'Relations:' || chr(10) || lines, 'Neighbours: ' || near, 'Evidence:' || chr(10) || shown) AS text, key AS entity_ids, docs, coalesce(pages, '') AS pages FROM ent LEFT JOIN lns USING (key) LEFT JOIN nr USING (key)
  UNION ALL SELECT 'relation:' || substr(sha1(source || '|' || type || '|' || target), 1, 16), 'relation', concat_ws(chr(10), sn || ' --' || type || '--> ' || tn || ' (' || weight || ')', 'Description: ' || description, 'Evidence:' || chr(10) || shown), source || ' ' || target, docs, coalesce(pages, '') FROM named)"""


@query(f"WITH {_KNOWN}, {_DOCS} SELECT node_id, graph_kind, text, entity_ids, docs, pages FROM gdoc")
def graph_index_documents(spark, sf_dir):
    """The graph written, and its documents as they are read again for an index."""
    documents = K.write_graph(_graph(spark, sf_dir), scratch_path(spark))
    joined = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep)
    return documents.select("node_id", "graph_kind", "text", joined("entity_ids", " ").alias("entity_ids"), joined("source_docs", ",").alias("docs"), joined("source_pages", ",").alias("pages"))


_HITS = "hits AS (SELECT 0 AS query_id, node_id, 1e0 / rank AS score, rank FROM (SELECT node_id, row_number() OVER (ORDER BY sha1(node_id), node_id) AS rank FROM gdoc) WHERE rank <= 6)"


def _hits(documents: DataFrame) -> DataFrame:
    """Six hits of one question in a fixed, mixed order."""
    best = documents.select("node_id").orderBy(F.sha1("node_id"), "node_id").limit(6).groupBy().agg(F.collect_list(F.struct(F.sha1("node_id").alias("h"), "node_id")).alias("r"))
    each = best.select(F.posexplode(F.array_sort("r")).alias("pos", "r"))
    return each.select(F.lit(0).alias("query_id"), "r.node_id", (F.lit(1e0) / (F.col("pos") + 1)).alias("score"), (F.col("pos") + 1).alias("rank"))


_SEEDS = "seeds AS (SELECT *, row_number() OVER (ORDER BY rank, pos, key) AS first FROM (SELECT key, max(score) AS score, min(rank) AS rank, arg_min(pos, rank * 10 + pos) AS pos FROM (SELECT h.*, unnest(string_split(entity_ids, ' ')) AS key, unnest(range(len(string_split(entity_ids, ' ')))) AS pos FROM hits h JOIN gdoc USING (node_id)) GROUP BY key) QUALIFY first <= 10)"


@query(f"WITH {_KNOWN}, {_DOCS}, {_HITS}, {_SEEDS} SELECT key, round(score, 6) AS score, first::BIGINT AS first FROM seeds")
def graph_seeds(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    documents = cut(K.graph_to_documents(graph["entities"], graph["relations"]))
    return K.seed_entities(_hits(documents), documents, 10).select("key", F.round("score", 6).alias("score"), F.col("first").cast("long").alias("first"))


@query(f"""WITH {_KNOWN}, {_DOCS}, {_HITS}, {_SEEDS},
e AS (SELECT a, b, max(f) AS f FROM (SELECT source AS a, target AS b, least(2e0, 1e0 + 0.1e0 * weight) * 0.7e0 AS f FROM rel UNION ALL SELECT target, source, least(2e0, 1e0 + 0.1e0 * weight) * 0.7e0 FROM rel) GROUP BY ALL),
s AS (SELECT key, score, 0 AS hop FROM seeds), h1 AS (SELECT b AS key, max(score * f) AS score, 1 AS hop FROM s JOIN e ON s.key = e.a GROUP BY b), h2 AS (SELECT b AS key, max(score * f) AS score, 2 AS hop FROM h1 JOIN e ON h1.key = e.a GROUP BY b),
alls AS (FROM s UNION ALL FROM h1 UNION ALL FROM h2), best AS (SELECT key, score, min(hop) AS hop FROM alls JOIN (SELECT key, max(score) AS score FROM alls GROUP BY key) USING (key, score) GROUP BY ALL),
cap AS (SELECT * FROM best QUALIFY row_number() OVER (ORDER BY hop, score DESC, key) <= 24),
u AS (SELECT node_id, score, -1 AS hop, rank FROM hits UNION ALL SELECT key, score, hop, NULL FROM cap WHERE key NOT IN (SELECT node_id FROM hits))
SELECT node_id, round(score, 6) AS score, CASE WHEN hop >= 0 THEN hop END::BIGINT AS hop, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (ORDER BY hop >= 0, rank, hop, score DESC, node_id) AS r FROM u) WHERE r <= 12""")
def graph_search(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    relations = cut(graph["relations"])
    documents = cut(K.graph_to_documents(graph["entities"], relations))
    out = K.graph_search(_hits(documents), documents, relations)
    return out.select("node_id", F.round("score", 6).alias("score"), F.col("hop").cast("long").alias("hop"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KNOWN} SELECT chunk_id, ln AS line, source AS source_key, target AS target_key FROM r0")
def relation_endpoints(spark, sf_dir):
    """Ends of relations by the names of their own chunk."""
    rows = stored(_extractions(spark, sf_dir))
    named, related = K.mentions(rows)
    out = K.resolve_names(named.select("chunk_id", "name", "key"), related.select("chunk_id", "source", "target", F.substring("description", 6, 9).cast("int").alias("line")))
    return out.select("chunk_id", "line", "source_key", "target_key")


@query("""WITH b AS (SELECT DISTINCT conv_id AS chunk_id FROM conversations), r AS (SELECT conv_id AS chunk_id, arg_max(role, turn) AS name, max(turn) AS nth FROM conversations WHERE role = 'user' OR turn % 2 = 1 GROUP BY conv_id)
SELECT b.chunk_id, coalesce(r.name, '') AS name, CASE WHEN r.name IS NULL THEN 0 ELSE 1 END::BIGINT AS entities FROM b LEFT JOIN r USING (chunk_id)""")
def extraction_replies(spark, sf_dir):
    """Replies to a batch of chunks: the last of several counts, none leaves empty lists, those to unknown chunks go."""
    turns = table(spark, sf_dir, "conversations")
    batch = turns.select(F.col("conv_id").alias("chunk_id")).distinct()
    reply = F.array(F.struct(F.col("role").alias("name"), F.lit("OTHER").alias("type"), F.lit("").alias("description")))
    replies = turns.where("role = 'user' or turn % 2 = 1").select(F.col("conv_id").alias("chunk_id"), reply.alias("entities"), F.array().cast(K.RELATIONS).alias("relations"), F.col("turn").alias("nth"))
    odd = replies.withColumn("chunk_id", -F.col("chunk_id") - 1)
    out = K.normalize_replies(batch, replies.unionByName(odd))
    return out.select("chunk_id", F.coalesce(F.get("entities", F.lit(0))["name"], F.lit("")).alias("name"), F.size("entities").cast("long").alias("entities"))


@query(f"WITH {_KNOWN} SELECT key, degree FROM (SELECT key, sum(weight)::BIGINT AS degree FROM (SELECT source AS key, weight FROM rel UNION ALL SELECT target, weight FROM rel) GROUP BY key)")
def graph_degrees(spark, sf_dir):
    return G.weighted_degree(_graph(spark, sf_dir)["relations"])
