"""Queries on graphs and trees: trade between nations, events, label clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions.text import stable_id
from gristmill.operators import graph as G
from gristmill.operators import tree as R
from gristmill.operators.lineage import parted
from gristmill.plans.base import query, table


def _trade(spark, sf_dir):
    """Rows of a graph: supplier's nation to customer's nation, a row for each line; orders are the chunks.

    Orders find their customers first, so lines are shuffled once, by the order, and stay there for what is counted by chunk.
    """
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("target"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "target")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "RETURNS").otherwise("SHIPS_TO").alias("type"))
    rows = parted(rows.join(supplier, rows.l_suppkey == supplier.s_suppkey).select("l_orderkey", "source", "type"), lines, "l_orderkey")
    joined = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
    return joined.where("source <> target").select(F.concat(F.lit("n"), F.col("source")).alias("source"), F.concat(F.lit("n"), F.col("target")).alias("target"), "type", F.col("l_orderkey").alias("chunk_id"))


_TRADE = """trade AS (SELECT 'n' || s_nationkey AS source, 'n' || c_nationkey AS target, CASE WHEN l_returnflag = 'R' THEN 'RETURNS' ELSE 'SHIPS_TO' END AS type, o_orderkey AS chunk_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey),
rel AS (SELECT source, target, type, count(*)::BIGINT AS weight, count(DISTINCT chunk_id)::BIGINT AS evidence_count FROM trade GROUP BY ALL)"""


@query(f"WITH {_TRADE} SELECT * FROM rel")
def relation_accumulate(spark, sf_dir):
    return G.accumulate_relations(_trade(spark, sf_dir))


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id AS key, arg_max(event_type, n * 1000000000 - first) AS type, any_value(b.mention_count) AS mention_count, any_value(b.aliases) AS aliases, any_value(b.name) AS name
FROM t JOIN (SELECT user_id, count(DISTINCT event_id)::BIGINT AS mention_count, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS aliases, arg_min(event_type, event_id) AS name FROM events GROUP BY user_id) b USING (user_id) GROUP BY user_id""")
def entity_accumulate(spark, sf_dir):
    mentions = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("name"), F.col("event_type").alias("type"), F.col("event_id").alias("seq"), F.col("event_id").alias("chunk_id"))
    return G.accumulate_entities(mentions).select("key", "type", "mention_count", F.array_join("aliases", " ").alias("aliases"), "name")



@query(f"WITH {_TRADE}, ends AS (SELECT source AS key, chunk_id FROM trade UNION ALL SELECT target, chunk_id FROM trade), m AS (SELECT key, count(DISTINCT chunk_id) AS mention_count FROM ends GROUP BY key), k AS (SELECT key FROM m WHERE mention_count >= 300)\n"
       "SELECT source, target, type, weight FROM rel WHERE weight >= 20 AND source IN (SELECT key FROM k) AND target IN (SELECT key FROM k)")  # fmt: skip
def mention_threshold(spark, sf_dir):
    rows = _trade(spark, sf_dir)
    entities = G.mention_counts(rows.select(F.explode(F.array("source", "target")).alias("key"), "chunk_id"))
    return G.threshold(entities, G.accumulate_relations(rows), 300, 20)[1].select("source", "target", "type", "weight")


@query(f"WITH {_TRADE} SELECT key, sum(weight)::BIGINT AS degree FROM (SELECT source AS key, weight FROM rel UNION ALL SELECT target, weight FROM rel) GROUP BY key")
def weighted_degree(spark, sf_dir):
    return G.weighted_degree(G.accumulate_relations(_trade(spark, sf_dir)))


_MEMBERS = "members AS (SELECT 'n' || n_nationkey AS key, n_regionkey::BIGINT AS community, n_name AS name FROM nation),\ninner_rel AS (SELECT a.community, a.name AS sn, b.name AS tn, r.* FROM rel r JOIN members a ON r.source = a.key JOIN members b ON r.target = b.key AND a.community = b.community)"


@query(f"""WITH {_TRADE}, {_MEMBERS},
deg AS (SELECT key, sum(weight) AS degree FROM (SELECT source AS key, weight FROM inner_rel UNION ALL SELECT target, weight FROM inner_rel) GROUP BY key),
who AS (SELECT community, name, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, name, key) AS r FROM members LEFT JOIN deg USING (key)),
lines AS (SELECT community, sn || ' --' || type || '--> ' || tn AS t, row_number() OVER (PARTITION BY community ORDER BY weight DESC, sn, type, tn) AS r FROM inner_rel),
l AS (SELECT community, string_agg(t, '; ' ORDER BY r) FILTER (r <= 12) AS lines, count(*)::BIGINT AS relation_count FROM lines GROUP BY community)
SELECT community, string_agg(name, ', ' ORDER BY r) FILTER (r <= 3) AS title, 'Main entities: ' || string_agg(name, ', ' ORDER BY r) FILTER (r <= 12) || '.' || coalesce(' Main relations: ' || any_value(lines) || '.', '') AS summary, coalesce(any_value(relation_count), 0)::BIGINT AS relation_count
FROM who LEFT JOIN l USING (community) GROUP BY community""")
def community_summary(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.col("n_regionkey").cast("long").alias("community"), F.col("n_name").alias("name"))
    return G.summarize_communities(nation.select("key", "community"), nation, G.accumulate_relations(_trade(spark, sf_dir)))


_SPARSE = "edges AS (SELECT DISTINCT o_custkey AS a, (o_custkey + 1 + o_custkey % 5)::BIGINT AS b FROM orders)"


@query(f"WITH RECURSIVE {_SPARSE}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), v AS (SELECT a AS key FROM both_ways UNION SELECT c_custkey FROM customer),\n"
       "reach(key, r) USING KEY (key) AS (SELECT key, key FROM v UNION SELECT e.b, min(reach.r) FROM reach JOIN both_ways e ON e.a = reach.key JOIN recurring.reach AS old ON old.key = e.b WHERE reach.r < old.r GROUP BY e.b)\n"
       "SELECT key, r AS component FROM reach")  # fmt: skip
def connected_components(spark, sf_dir):
    """Components of the customers, linked by all orders."""
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") + 1 + F.col("o_custkey") % 5).alias("target")).distinct()
    vertices = links.select(F.explode(F.array("source", "target")).alias("key")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()
    return G.components(vertices, links)


@query()
def louvain_communities(spark, sf_dir):
    edges = G.accumulate_relations(_trade(spark, sf_dir)).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    vertices = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"))
    found = G.communities(vertices, edges)
    return found.join(G.number_communities(found), "community")


@query(f"""WITH {_TRADE}, {_MEMBERS},
lines AS (SELECT e.key, a.name || ' --' || r.type || '--> ' || b.name AS t, row_number() OVER (PARTITION BY e.key ORDER BY r.weight DESC, a.name, r.type, b.name) AS n FROM rel r JOIN members a ON r.source = a.key JOIN members b ON r.target = b.key JOIN members e ON e.key IN (r.source, r.target)),
ent AS (SELECT m.key AS node_id, 'entity' AS graph_kind, 'Entity: ' || m.name || coalesce(chr(10) || 'Relations:' || chr(10) || string_agg(t, chr(10) ORDER BY n) FILTER (n <= 20), '') AS text FROM members m LEFT JOIN lines USING (key) GROUP BY m.key, m.name),
rels AS (SELECT 'relation:' || substr(sha1(source || '|' || type || '|' || target), 1, 16) AS node_id, 'relation' AS graph_kind, a.name || ' --' || type || '--> ' || b.name || ' (' || weight || ')' AS text FROM rel JOIN members a ON source = a.key JOIN members b ON target = b.key)
SELECT * FROM ent UNION ALL SELECT * FROM rels UNION ALL SELECT 'community:' || community, 'community', string_agg(name, ', ' ORDER BY name) FROM members GROUP BY community""")
def graph_documents(spark, sf_dir):
    relations = G.accumulate_relations(_trade(spark, sf_dir))
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("community"))
    named = relations.join(names.select(F.col("key").alias("source"), F.col("name").alias("sn")), "source").join(names.select(F.col("key").alias("target"), F.col("name").alias("tn")), "target")
    line = F.concat("sn", F.lit(" --"), "type", F.lit("--> "), "tn")
    each = named.select(F.explode(F.array("source", "target")).alias("key"), "weight", "sn", "type", "tn", line.alias("t"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "sn", "type", "tn"))).where("n <= 20")
    lines = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("lines"))
    entities = names.join(lines, "key", "left").select(F.col("key").alias("node_id"), F.lit("entity").alias("graph_kind"), F.concat(F.lit("Entity: "), "name", F.coalesce(F.concat(F.lit("\nRelations:\n"), F.col("lines")), F.lit(""))).alias("text"))
    rels = named.select(stable_id(F.col("source"), F.col("type"), F.col("target"), prefix="relation:").alias("node_id"), F.lit("relation").alias("graph_kind"), F.concat(line, F.lit(" ("), F.col("weight").cast("string"), F.lit(")")).alias("text"))
    groups = names.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("text"))
    return entities.unionByName(rels).unionByName(groups.select(F.concat(F.lit("community:"), F.col("community").cast("string")).alias("node_id"), F.lit("community").alias("graph_kind"), "text"))


@query(f"""WITH {_TRADE}, e AS (SELECT a, b, max(f) AS f FROM (SELECT source AS a, target AS b, 0.7e0 * least(2e0, 1e0 + 0.1e0 * weight) AS f FROM rel UNION ALL SELECT target, source, 0.7e0 * least(2e0, 1e0 + 0.1e0 * weight) FROM rel) GROUP BY ALL),
s AS (SELECT 'n' || n_nationkey AS key, 1e0 / (n_nationkey + 1) AS score, 0 AS hop FROM nation WHERE n_nationkey < 3),
h1 AS (SELECT b AS key, max(score * f) AS score, 1 AS hop FROM s JOIN e ON s.key = e.a GROUP BY b), h2 AS (SELECT b AS key, max(score * f) AS score, 2 AS hop FROM h1 JOIN e ON h1.key = e.a GROUP BY b),
best AS (SELECT key, max(score) AS score FROM (FROM s UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY key)
SELECT key, round(b.score, 6) AS score, min(a.hop)::BIGINT AS hop FROM best b JOIN (FROM s UNION ALL FROM h1 UNION ALL FROM h2) a USING (key, score) GROUP BY key, b.score""")
def graph_expand_2hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.lit(0).alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"), (F.lit(1e0) / (F.col("n_nationkey") + 1)).alias("score"))
    return G.expand(seeds, G.accumulate_relations(_trade(spark, sf_dir))).select("key", F.round("score", 6).alias("score"), F.col("hop").cast("long").alias("hop"))


@query("SELECT label::BIGINT AS cluster, count(*)::BIGINT AS children, sum(vec_id % 50 + 1)::BIGINT AS tokens, string_agg(DISTINCT vec_id % 7, ',' ORDER BY vec_id % 7) AS pages, CASE WHEN count(DISTINCT vec_id % 2) = 1 THEN min('t' || vec_id % 2) ELSE 'mixed' END AS chunk_type FROM embeddings GROUP BY label")
def cluster_rollup(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    nodes = vectors.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("node_id"), F.lit("").alias("text"), (F.col("vec_id") % 50 + 1).alias("tokens"), F.array((F.col("vec_id") % 7).cast("int")).alias("source_pages"), F.concat(F.lit("t"), (F.col("vec_id") % 2).cast("string")).alias("chunk_type"))
    members = vectors.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("node_id"), F.col("label").cast("long").alias("cluster"))
    up = R.roll_up(members, nodes)
    return up.select("cluster", F.size("child_node_ids").cast("long").alias("children"), F.col("children_token_estimate").alias("tokens"), F.array_join(F.transform("source_pages", lambda x: x.cast("string")), ",").alias("pages"), "chunk_type")


@query()
def tree_build(spark, sf_dir):
    leaves = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("leaf_"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("node_id"), F.concat(F.lit("Vector "), F.col("vec_id").cast("string"), F.lit(" of label "), F.col("label").cast("string"), F.lit(".")).alias("text"), F.col("embedding").alias("v"))
    nodes = R.build_tree(leaves)
    return nodes.select("node_id", "depth", "layer", "tokens", F.size("child_node_ids").alias("children"), "text")


@query("""WITH RECURSIVE links AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
hits AS (SELECT 'n' || n_nationkey AS node_id, 1e0 / (n_nationkey + 1) AS score FROM nation WHERE n_nationkey < 4),
up(node_id, score, hop) AS (SELECT node_id, score, 0 FROM hits UNION ALL SELECT parent, score, hop + 1 FROM up JOIN links ON child = node_id WHERE hop < 2)
SELECT node_id, round(max(score * CASE hop WHEN 0 THEN 1e0 WHEN 1 THEN 0.92e0 ELSE 0.92e0 * 0.92e0 END), 6) AS score, min(hop)::BIGINT AS hop FROM up GROUP BY node_id""")
def ancestor_expand(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    links = nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent")).unionByName(region.select(name("r", "r_regionkey").alias("child"), F.lit("root").alias("parent")))
    hits = nation.where("n_nationkey < 4").select(F.lit(0).alias("query_id"), name("n", "n_nationkey").alias("node_id"), (F.lit(1e0) / (F.col("n_nationkey") + 1)).alias("score"))
    return R.expand_ancestors(hits, links).select("node_id", F.round("score", 6).alias("score"), F.col("hop").cast("long").alias("hop"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(json_extract(props, '$.k'))::BIGINT AS with_k, round(sum(value), 4) AS total, count(*) FILTER (json_valid(props))::BIGINT AS valid FROM events GROUP BY event_type")
def json_props_parse(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$").alias("whole"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.round(F.sum("value"), 4).alias("total"), F.count("whole").alias("valid"))


@query("SELECT 'entity:' || substr(sha1(trim(regexp_replace(strip_accents(lower(p_name)), '[^\\p{L}\\p{N}_%+./-]+', ' ', 'g'))), 1, 16) AS key, min(p_partkey) AS first, count(*)::BIGINT AS n FROM part GROUP BY 1")
def entity_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(G.entity_id(F.col("p_name")).alias("key")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("n"))
