"""Knowledge graph: cleaning, accumulation, communities, summaries, documents, bounded expansion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import canonical_name, snippet, squeeze, stable_id
from gristmill.operators.lineage import cut, numbered

ENTITY_TYPES = ("ANATOMY", "DISEASE", "DRUG", "OTHER", "PROCEDURE", "SYMPTOM", "TEST")


def entity_id(name: Column) -> Column:
    return stable_id(canonical_name(name), prefix="entity:")


def clean_entities(rows: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """(chunk columns, name, type, description) without blank names; unknown types are OTHER."""
    kind = F.upper(F.trim(F.coalesce("type", F.lit(""))))
    return rows.withColumns({"name": squeeze(F.coalesce("name", F.lit(""))), "type": F.when(kind.isin(*types), kind).otherwise("OTHER"), "description": squeeze(F.coalesce("description", F.lit("")))}).where("name <> ''")


def clean_relations(rows: DataFrame) -> DataFrame:
    """(chunk columns, source, target, type, description) without blank ends or relations of a name with itself; types in upper snake case."""
    kind = F.regexp_replace(F.upper(F.trim(F.coalesce("type", F.lit("")))), r"(?U)[^\p{L}\p{N}]+", "_")
    out = rows.withColumns({"source": squeeze(F.coalesce("source", F.lit(""))), "target": squeeze(F.coalesce("target", F.lit(""))), "type": F.when(kind == "", "RELATED_TO").otherwise(kind)})
    return out.where("source <> '' and target <> '' and lower(source) <> lower(target)")


def evidence() -> Column:
    """Where something was found, with a snippet."""
    return F.struct("chunk_id", "doc_name", "page_number", "chunk_type", snippet(F.col("content"), 420).alias("snippet"))


def accumulate_entities(mentions: DataFrame, key: str = "key", seq: str = "seq", chunk: str = "chunk_id") -> DataFrame:
    """(key, name, aliases, type, mention_count): first name, all names, commonest type (ties: first seen), distinct chunks.

    Chunks are counted apart from the names, so that only pairs of key and chunk are shuffled for them.
    """
    types = mentions.groupBy(key, "type").agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    mode = types.groupBy(key).agg(F.min_by("type", F.struct(-F.col("n"), F.col("first"))).alias("type"))
    base = mentions.groupBy(key).agg(F.min_by("name", seq).alias("name"), F.array_sort(F.collect_set("name")).alias("aliases"))
    return base.join(mode, key).join(mention_counts(mentions, key, chunk), key)


def mention_counts(mentions: DataFrame, key: str = "key", chunk: str = "chunk_id") -> DataFrame:
    """(key, mention_count): distinct chunks. Rows that are partitioned by the chunk already stay where they are."""
    return mentions.groupBy(key, chunk).agg(F.lit(1).alias("__one")).groupBy(key).agg(F.count(chunk).alias("mention_count"))


def accumulate_relations(rows: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """(source, target, type, weight, evidence_count): weight counts rows, evidence distinct chunks. Rows that are partitioned by the chunk already stay where they are."""
    each = rows.groupBy("source", "target", "type", chunk).agg(F.count("*").alias("__n"))
    return each.groupBy("source", "target", "type").agg(F.sum("__n").alias("weight"), F.count(chunk).alias("evidence_count"))


def first_descriptions(rows: DataFrame, by: list[str], n: int = 3, seq: str = "seq") -> DataFrame:
    """(by, description): the first n different descriptions, joined. Only n rows of a group reach the last aggregate."""
    each = rows.where("description <> ''").groupBy(*by, "description").agg(F.min(seq).alias("first"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).where(F.col("n") <= n)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "description"))), lambda x: x["description"]), " ").alias("description"))


def add_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities (key, name, type) and, as OTHER, the ends of relations that are none of them."""
    ends = relations.select(F.col("source").alias("key")).union(relations.select("target")).distinct()
    missing = ends.join(entities.select("key"), "key", "left_anti").select("key", F.col("key").alias("name"), F.lit("OTHER").alias("type"))
    return entities.select("key", "name", "type").unionByName(missing)


def threshold(entities: DataFrame, relations: DataFrame, min_mentions: int, min_weight: int) -> tuple[DataFrame, DataFrame]:
    """Entities with enough mentions; relations heavy enough whose both ends are retained."""
    kept = entities.where(F.col("mention_count") >= min_mentions)
    ids = kept.select("key")
    heavy = relations.where(F.col("weight") >= min_weight)
    return kept, heavy.join(ids.withColumnRenamed("key", "source"), "source", "left_semi").join(ids.withColumnRenamed("key", "target"), "target", "left_semi")


def weighted_degree(relations: DataFrame) -> DataFrame:
    """(key, degree): the weights of both ends' relations, 0 counting as 1."""
    w = F.when(F.coalesce(F.col("weight"), F.lit(0)) == 0, 1).otherwise(F.col("weight")).cast("long")
    ends = relations.select(F.explode(F.array("source", "target")).alias("key"), w.alias("w"))
    return ends.groupBy("key").agg(F.sum("w").alias("degree"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key of the connected component, isolated vertices included.

    Labels flow along the edges and then jump to their label's label, so rounds grow with the logarithm of a chain.
    Every round cuts its lineage.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    labels = vertices.select("key", F.col("key").alias("component"))
    while True:
        near = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("component").alias("m"))
        stepped = labels.join(near, labels.key == near.a, "left").select("key", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = stepped.select(F.col("key").alias("component"), F.col("component").alias("further"))
        new = stepped.join(jump, "component", "left").select("key", F.coalesce("further", "component").alias("component"))
        new = cut(new)
        changed = new.join(labels.withColumnRenamed("component", "before"), "key").where("component <> before").limit(1).count()
        labels = new
        if not changed:
            return labels


def louvain(edges: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, str]:
    """Louvain communities of one component: node to the smallest node of its community; nodes are visited in order."""
    graph: dict[str, dict[str, float]] = {}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0) + w
        graph.setdefault(b, {})[a] = graph.setdefault(b, {}).get(a, 0) + (w if a != b else 0)
    names = {n: [n] for n in graph}
    loops = {n: graph[n].pop(n, 0.0) for n in sorted(graph)}
    total = sum(sum(x.values()) for x in graph.values()) / 2 + sum(loops.values())
    while total:
        degree = {n: sum(x.values()) + 2 * loops[n] for n, x in graph.items()}
        of, weight = {n: n for n in graph}, dict(degree)
        moved = True
        any_moved = False
        while moved:
            moved = False
            for n in sorted(graph):
                links: dict[str, float] = {}
                for m, w in graph[n].items():
                    links[of[m]] = links.get(of[m], 0) + w
                weight[of[n]] -= degree[n]
                gain = lambda c: links.get(c, 0.0) - resolution * weight[c] * degree[n] / (2 * total)  # noqa: B023, E731
                best = max(sorted({*links, of[n]}), key=lambda c: (round(gain(c), 12), c == of[n]))
                weight[best] += degree[n]
                if best != of[n]:
                    of[n], moved, any_moved = best, True, True
        if not any_moved:
            break
        merged: dict[str, list[str]] = {}
        for n in sorted(graph):
            merged.setdefault(of[n], []).extend(names[n])
        new: dict[str, dict[str, float]] = {c: {} for c in merged}
        inner = dict.fromkeys(merged, 0.0)
        for n, x in graph.items():
            inner[of[n]] += loops[n]
            for m, w in x.items():
                if of[n] == of[m]:
                    inner[of[n]] += w / 2
                else:
                    new[of[n]][of[m]] = new[of[n]].get(of[m], 0) + w
        graph, names, loops = new, merged, inner
    return {m: min(ms) for ms in names.values() for m in ms}


def communities(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(key, component, community): components of fewer than three vertices stay whole, the others are cut by Louvain.

    A component is one group of a pandas function: its edges have to fit into a worker, as Louvain needs them together.
    """
    found = components(vertices, edges)
    held = edges.join(found.withColumnRenamed("key", "source"), "source").select("component", "source", "target", F.col("weight").cast("double").alias("weight"))

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame["source"], frame["target"], frame["weight"], strict=True))
        nodes = {n for a, b, _ in rows for n in (a, b)}
        of = dict.fromkeys(nodes, min(nodes)) if len(nodes) < 3 else louvain(rows, resolution)
        return pd.DataFrame({"key": sorted(of), "community": [of[n] for n in sorted(of)]})

    kind = vertices.schema["key"].dataType.simpleString()
    inner = held.groupBy("component").applyInPandas(split, f"key {kind}, community {kind}")
    return found.join(inner, "key", "left").select("key", "component", F.coalesce("community", "key").alias("community"))


def number_communities(members: DataFrame) -> DataFrame:
    """(community, community_id, size): numbered by size, then smallest member."""
    sizes = members.groupBy("community").agg(F.count("*").alias("size"), F.min("key").alias("first"))
    return numbered(sizes, [F.desc("size"), "first"]).select("community", F.concat(F.lit("community:"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("community_id"), "size")


def summarize_communities(members: DataFrame, names: DataFrame, relations: DataFrame, top: int = 12) -> DataFrame:
    """(community, title, summary, relation_count) by a fixed template: members by degree and name, relations by weight.

    members: key, community. Ranks are cut to `top` before anything is collected, so a group is never larger.
    """
    inner = relations.join(members.select(F.col("key").alias("source"), F.col("community")), "source").join(members.select(F.col("key").alias("target"), F.col("community").alias("c2")), "target").where("community = c2")
    degree = weighted_degree(inner)
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "name", "key")
    who = members.join(names.select("key", "name"), "key").join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    joined = lambda rows, n, sep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(rows)), lambda x: x["r"] <= n), lambda x: x["t"]), sep)
    people = who.groupBy("community").agg(joined(F.struct("r", F.col("name").alias("t")), 3, ", ").alias("title"), joined(F.struct("r", F.col("name").alias("t")), top, ", ").alias("names"))
    line = F.concat(F.col("sn"), F.lit(" --"), F.col("type"), F.lit("--> "), F.col("tn"))
    edges = inner.join(names.select(F.col("key").alias("source"), F.col("name").alias("sn")), "source").join(names.select(F.col("key").alias("target"), F.col("name").alias("tn")), "target")
    counts = inner.groupBy("community").agg(F.count("*").alias("relation_count"))
    first = Window.partitionBy("community").orderBy(F.desc("weight"), "sn", "type", "tn")
    lines = edges.select("community", line.alias("t"), F.row_number().over(first).alias("r")).where(F.col("r") <= top).groupBy("community").agg(joined(F.struct("r", "t"), top, "; ").alias("lines"))
    out = people.join(counts, "community", "left").join(lines, "community", "left")
    summary = F.concat(F.lit("Main entities: "), F.col("names"), F.lit("."), F.coalesce(F.concat(F.lit(" Main relations: "), F.col("lines"), F.lit(".")), F.lit("")))
    return out.select("community", "title", summary.alias("summary"), F.coalesce("relation_count", F.lit(0)).cast("long").alias("relation_count"))


def expand(seeds: DataFrame, relations: DataFrame, hops: int = 2, decay: float = 0.7, cap: int | None = None) -> DataFrame:
    """(query_id, key, score, hop): entities within some hops of the seeds (query_id, key, score), best score each.

    Edges are walked both ways; a step multiplies by decay and min(2, 1 + weight / 10). The best score wins with its
    hop; the result is ordered by hop, then score, and cut to `cap` for each question.
    """
    w = F.when(F.coalesce(F.col("weight"), F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    factor = F.least(F.lit(2e0), F.lit(1e0) + F.lit(0.1e0) * w.cast("double")) * F.lit(decay)
    both = relations.select(F.col("source").alias("key"), F.col("target").alias("to"), factor.alias("f")).unionByName(relations.select(F.col("target").alias("key"), F.col("source").alias("to"), factor.alias("f")))
    both = both.groupBy("key", "to").agg(F.max("f").alias("f"))
    level = seeds.groupBy("query_id", "key").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0))
    found = level
    for hop in range(1, hops + 1):
        level = level.join(both, "key").groupBy("query_id", F.col("to").alias("key")).agg(F.max(F.col("score") * F.col("f")).alias("score")).withColumn("hop", F.lit(hop))
        found = found.unionByName(level)
    best = found.groupBy("query_id", "key").agg(F.max_by(F.struct("score", "hop"), F.struct(F.col("score"), -F.col("hop"))).alias("b")).select("query_id", "key", "b.score", "b.hop")
    if cap is None:
        return best
    order = Window.partitionBy("query_id").orderBy("hop", F.desc("score"), "key")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("rank")
