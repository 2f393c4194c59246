"""From chunks to a knowledge graph, its documents, and search over it; the pieces are in graph.py."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import canonical_name, snippet, stable_id
from gristmill.operators import graph as G
from gristmill.operators.lineage import cut, stored
from gristmill.operators.providers import TextGenerator, batched, first_json, with_cache

ENTITIES = "array<struct<name:string,type:string,description:string>>"
RELATIONS = "array<struct<source:string,target:string,type:string,description:string>>"
PROMPT = "List the entities and relations of each chunk as JSON: {\"chunks\": [{\"chunk_id\": ..., \"entities\": [...], \"relations\": [...]}]}\n\n"


@dataclass(frozen=True)
class GraphOptions:
    min_mentions: int = 1
    min_weight: int = 1
    resolution: float = 1.0
    evidence: int = 5
    relations: int = 20
    neighbours: int = 12
    hops: int = 2
    cap: int = 24
    seeds: int = 10
    final: int = 12

    def __post_init__(self) -> None:
        if min(self.min_mentions, self.min_weight, self.evidence, self.relations, self.neighbours, self.cap, self.seeds, self.final) < 1 or self.hops < 0:
            raise ValueError("limits must be positive")


def normalize_replies(batch: DataFrame, replies: DataFrame) -> DataFrame:
    """batch with the reply to each chunk: replies (chunk_id, entities, relations, nth) to unknown chunks are dropped, the last of several counts, none gives empty lists."""
    last = replies.groupBy("chunk_id").agg(F.max_by(F.struct("entities", "relations"), "nth").alias("r"))
    joined = batch.join(last, "chunk_id", "left")
    return joined.select(*batch.columns, F.coalesce("r.entities", F.array().cast(ENTITIES)).alias("entities"), F.coalesce("r.relations", F.array().cast(RELATIONS)).alias("relations"))


def extractor(generator: TextGenerator, attempts: int = 2, max_tokens: int = 4096) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Asks for the entities and relations of a batch (chunk_id, content); an answer that can't be read is asked for again, then the batch fails."""

    def items(found: object, names: tuple[str, ...]) -> list[dict]:
        return [{n: str(x.get(n) or "") for n in names} for x in found if isinstance(x, dict)] if isinstance(found, list) else []

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        prompt = PROMPT + "\n\n".join(f"[{k}]\n{t}" for k, t in zip(part["chunk_id"], part["content"], strict=True))
        for _ in range(attempts):
            answer = first_json(generator.generate(prompt, max_tokens))
            chunks = answer.get("chunks") if isinstance(answer, dict) else answer
            if isinstance(chunks, list):
                break
        else:
            raise ValueError("no JSON in the answer")
        known = {str(c.get("chunk_id")): c for c in chunks if isinstance(c, dict)}  # the last one of a chunk stays
        rows = []
        for k in part["chunk_id"]:
            c = known.get(str(k), {})
            rows.append((k, json.dumps({"entities": items(c.get("entities"), ("name", "type", "description")), "relations": items(c.get("relations"), ("source", "target", "type", "description"))})))
        return pd.DataFrame(rows, columns=["chunk_id", "reply"])

    return ask


def extract(chunks: DataFrame, cache: DataFrame, ask: Callable[[pd.DataFrame], pd.DataFrame], size: int = 20, budget: int | None = 40) -> tuple[DataFrame, DataFrame]:
    """chunks with entities and relations, and the new rows (chunk_id, reply) for the cache; batches that fail, and those beyond the budget of requests (None: all are asked), stay pending and have empty lists."""
    done, new = with_cache(chunks, cache, "chunk_id", "reply", lambda pending: batched(pending, ["chunk_id", "content"], size, ask, "chunk_id string, reply string", ["chunk_id"], budget))
    parsed = F.from_json("reply", f"entities {ENTITIES}, relations {RELATIONS}")
    rows = done.withColumn("__r", parsed)
    empty = lambda field, kind: F.coalesce(F.col(f"__r.{field}"), F.array().cast(kind)).alias(field)
    return rows.select(*chunks.columns, empty("entities", ENTITIES), empty("relations", RELATIONS)), new


#: Up to so many ends of relations that no mention names are sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
_CHUNK = ["chunk_id", "doc_name", "page_number", "chunk_type", "content"]


def mentions(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows of entity mentions and relations with the chunk's columns, their place in it (seq) and keys (key; source_key, target_key)."""
    place = F.struct(F.col("page_number"), F.col("chunk_id"), F.col("pos"))
    chunk = [F.col(c) for c in _CHUNK]
    entities = G.clean_entities(extractions.select(*chunk, F.posexplode("entities").alias("pos", "e")).select(*chunk, place.alias("seq"), "e.*"))
    relations = G.clean_relations(extractions.select(*chunk, F.posexplode("relations").alias("pos", "e")).select(*chunk, place.alias("seq"), "e.*"))
    return entities.withColumn("key", G.entity_id(F.col("name"))), relations.withColumns({"source_key": G.entity_id(F.col("source")), "target_key": G.entity_id(F.col("target"))})


def first_evidence(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, evidence): the first n different chunks of each group with a snippet.

    Every task passes on the rows of its own first n chunks of a group alone, before the shuffle (a chunk is on one page).
    """
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("page_number", "chunk_id"))
    top = rows.select(*by, *_CHUNK, "seq").withColumn("n", place).where(F.col("n") <= n)
    each = top.groupBy(*by, "n", "chunk_id").agg(F.min_by(F.struct("doc_name", "page_number", "chunk_type", snippet(F.col("content"), 420).alias("snippet")), "seq").alias("e"))
    item = F.struct("n", F.struct("chunk_id", "e.doc_name", "e.page_number", "e.chunk_type", "e.snippet").alias("v"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("evidence"))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows of mentions() in a scratch table; seq repeats the chunk's columns, so its last part alone is written."""
    back = stored(rows.withColumn("pos", F.col("seq.pos")).drop("seq"))
    return back.withColumn("seq", F.struct("page_number", "chunk_id", "pos")).drop("pos")


def build_graph(extractions: DataFrame, options: GraphOptions | None = None, communities: bool = True) -> dict[str, DataFrame]:
    """entities, relations and members of communities from extraction rows, and stats (kind, name, n).

    entities: key, name, aliases, type, description (the first three), mention_count, evidence, community. Ends of
    relations that no mention names are entities of type OTHER with the evidence of the first relation that names them.
    Without `communities` entities have none and there are no members.
    relations: source, target (keys), type, weight (rows), evidence_count (chunks), description, evidence, relation_id.
    Extractions are worked out once and kept as compressed tables with snippets in place of contents; pairs of group and
    chunk are the largest rows shuffled after that.
    """
    options = options or GraphOptions()
    rows = stored(extractions.select(*(snippet(F.col(c), 420).alias(c) if c == "content" else c for c in _CHUNK), "entities", "relations"))
    named, related = map(_kept, mentions(rows))
    ends = related.select(*_CHUNK, "seq", F.explode(F.array(F.struct(F.col("source_key").alias("key"), F.col("source").alias("name")), F.struct(F.col("target_key").alias("key"), F.col("target").alias("name")))).alias("end")).select(*_CHUNK, "seq", "end.*")
    unknown = cut(ends.select("key").distinct().join(named.select("key").distinct(), "key", "left_anti"))
    few = F.broadcast(unknown) if unknown.count() <= BROADCAST_KEYS else unknown
    columns = [c for c in named.columns if c not in ("key", "type", "description")]
    first = ends.join(few, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct(*columns), "seq").alias("r"))
    only = first.select("key", "r.*", F.lit("OTHER").alias("type"), F.lit("").alias("description"))
    every = named.unionByName(only)
    entities = G.accumulate_entities(every).join(G.first_descriptions(every, ["key"]), "key", "left").join(first_evidence(every, ["key"], options.evidence), "key", "left")
    keyed = related.select(*_CHUNK, "seq", "type", "description", F.col("source_key").alias("source"), F.col("target_key").alias("target"))
    by = ["source", "target", "type"]
    relations = G.accumulate_relations(keyed).join(G.first_descriptions(keyed, by), by, "left").join(first_evidence(keyed, by, options.evidence), by, "left")
    relations = relations.withColumn("relation_id", stable_id(F.col("source"), F.col("type"), F.col("target"), prefix="relation:"))
    relations = relations.withColumn("description", F.coalesce("description", F.lit("")))
    entities, relations = map(cut, G.threshold(entities.withColumn("description", F.coalesce("description", F.lit(""))), relations, options.min_mentions, options.min_weight))
    stats = graph_stats(entities, relations)
    if not communities:
        return {"entities": entities, "relations": relations, "stats": stats}
    members = G.communities(entities.select("key"), relations.select("source", "target", "weight"), options.resolution)
    numbered = members.join(G.number_communities(members), "community").select("key", "community_id")
    return {"entities": entities.join(numbered, "key", "left"), "relations": relations, "members": numbered, "stats": stats}


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, name, n): entities and relations by type."""
    count = lambda rows, kind: rows.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(entities, "entity").unionByName(count(relations, "relation"))


def source_fields(evidence: Column) -> list[Column]:
    """Sorted different documents, pages, chunks and types of evidence, without empty ones."""
    union = lambda field: F.array_sort(F.array_distinct(F.filter(F.transform(evidence, lambda e: e[field]), lambda x: x.isNotNull() & (x.cast("string") != "") & (x.cast("string") != "0"))))
    return [union("doc_name").alias("source_docs"), union("page_number").alias("source_pages"), union("chunk_id").alias("source_chunk_ids"), union("chunk_type").alias("source_types")]


def _joined(item: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(item).alias("t")))), lambda x: x["t"]), sep)


def graph_to_documents(entities: DataFrame, relations: DataFrame, communities: DataFrame | None = None, options: GraphOptions | None = None) -> DataFrame:
    """(node_id, graph_kind, text, entity_ids, source_docs, source_pages, source_chunk_ids, source_types): documents of entities, relations and communities.

    An entity shows its heaviest relations, neighbours and evidence up to the options' limits; communities: community,
    title, summary and entity_ids. Lists are cut by rank before they are gathered.
    """
    options = options or GraphOptions()
    names = entities.select("key", "name")
    named = relations.join(names.select(F.col("key").alias("source"), F.col("name").alias("sn")), "source").join(names.select(F.col("key").alias("target"), F.col("name").alias("tn")), "target")
    line = F.concat("sn", F.lit(" --"), "type", F.lit("--> "), "tn")
    sides = F.array(F.struct(F.col("source").alias("key"), F.col("tn").alias("other")), F.struct(F.col("target").alias("key"), F.col("sn").alias("other")))
    each = named.select("weight", "sn", "type", "tn", line.alias("line"), F.explode(sides).alias("s")).select("weight", "sn", "type", "tn", "line", "s.*")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "sn", "type", "tn"))
    lines = each.withColumn("n", rank).where(F.col("n") <= options.relations).groupBy("key").agg(_joined("line", "\n").alias("lines"))
    near = each.groupBy("key", "other").agg(F.sum("weight").alias("w"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("w"), "other"))).where(F.col("n") <= options.neighbours).groupBy("key").agg(_joined("other", ", ").alias("near"))
    shown = F.slice("evidence", 1, options.evidence)
    seen = F.array_join(F.transform(shown, lambda e: F.concat(F.lit("- "), e["snippet"])), "\n")
    part = lambda head, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(head), text))
    rows = entities.join(lines, "key", "left").join(near, "key", "left")
    text = F.concat_ws("\n", F.concat(F.lit("Entity: "), "name"), F.concat(F.lit("Type: "), "type"), part("Description: ", F.col("description")), part("Relations:\n", F.col("lines")), part("Neighbours: ", F.col("near")), part("Evidence:\n", seen))
    out = rows.select(F.col("key").alias("node_id"), F.lit("entity").alias("graph_kind"), text.alias("text"), F.array("key").alias("entity_ids"), *source_fields(shown))
    text = F.concat_ws("\n", F.concat(line, F.lit(" ("), F.col("weight").cast("string"), F.lit(")")), part("Description: ", F.col("description")), part("Evidence:\n", seen))
    out = out.unionByName(named.select(F.col("relation_id").alias("node_id"), F.lit("relation").alias("graph_kind"), text.alias("text"), F.array("source", "target").alias("entity_ids"), *source_fields(shown)))
    if communities is None:
        return out
    none = [F.array().cast(kind).alias(c) for c, kind in (("source_docs", "array<string>"), ("source_pages", "array<int>"), ("source_chunk_ids", out.schema["source_chunk_ids"].dataType), ("source_types", "array<string>"))]
    return out.unionByName(communities.select(F.col("community").cast("string").alias("node_id"), F.lit("community").alias("graph_kind"), F.concat_ws("\n", "title", "summary").alias("text"), "entity_ids", *none))


def seed_entities(hits: DataFrame, documents: DataFrame, most: int) -> DataFrame:
    """(query_id, key, score, first): entities of the hits (query_id, node_id, score, rank), best score each, in the order in which they were first seen."""
    each = hits.join(documents.select("node_id", F.posexplode("entity_ids").alias("pos", "key")), "node_id")
    seeds = each.groupBy("query_id", "key").agg(F.max("score").alias("score"), F.min(F.struct("rank", "pos")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "key")
    return seeds.withColumn("first", F.row_number().over(order)).where(F.col("first") <= most)


def graph_search(hits: DataFrame, documents: DataFrame, relations: DataFrame, options: GraphOptions | None = None) -> DataFrame:
    """(query_id, node_id, score, hop, rank): the hits' own documents first in their order, then those of entities within some hops that are not among them, sliced.

    hits come from any search over the graph documents. Expanded entities come by hop, then score.
    """
    options = options or GraphOptions()
    seeds = seed_entities(hits.where(F.col("rank") <= options.seeds), documents, options.seeds)
    found = G.expand(seeds.select("query_id", "key", "score"), relations, options.hops, cap=options.cap)
    known = documents.where("graph_kind = 'entity'").select(F.col("node_id").alias("key"))
    extra = found.join(known, "key", "left_semi").select("query_id", F.col("key").alias("node_id"), "score", "hop")
    new = extra.join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    own = hits.select("query_id", "node_id", F.col("score").cast("double").alias("score"), F.lit(-1).alias("hop"), F.col("rank").cast("long").alias("at"))
    order = Window.partitionBy("query_id").orderBy(F.col("hop") >= 0, "at", "hop", F.desc("score"), "node_id")
    both = own.unionByName(new.withColumn("at", F.lit(None).cast("long"))).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= options.final).select("query_id", "node_id", "score", F.when(F.col("hop") >= 0, F.col("hop")).alias("hop"), "rank")


def resolve_names(mentioned: DataFrame, related: DataFrame) -> DataFrame:
    """related (chunk_id, source, target) with source_key and target_key: that of an entity which the same chunk names so (case and accents aside), else that of the name alone.

    A chunk's names are one list, so both sides are shuffled once, by the chunk.
    """
    own = mentioned.select("chunk_id", F.struct(canonical_name(F.col("name")).alias("c"), "key").alias("__e")).groupBy("chunk_id").agg(F.collect_set("__e").alias("__own"))
    out = related.join(own, "chunk_id", "left")
    for side in ("source", "target"):
        named = lambda e: e["c"] == F.col(f"__{side}")  # noqa: B023, E731
        key = F.array_min(F.transform(F.filter("__own", named), lambda e: e["key"]))
        out = out.withColumn(f"__{side}", canonical_name(F.col(side))).withColumn(f"{side}_key", F.coalesce(key, G.entity_id(F.col(side)))).drop(f"__{side}")
    return out.drop("__own")


def write_graph(graph: dict[str, DataFrame], path: str, communities: DataFrame | None = None) -> DataFrame:
    """Writes the graph's tables and its documents (JSON lines) under the path; gives the documents as read again."""
    for name in ("entities", "relations", *(["members"] if "members" in graph else [])):
        graph[name].write.mode("overwrite").parquet(f"{path}/{name}")
    spark = graph["entities"].sparkSession
    entities, relations = (spark.read.parquet(f"{path}/{n}") for n in ("entities", "relations"))
    documents = graph_to_documents(entities, relations, communities)
    documents.write.mode("overwrite").json(f"{path}/documents")
    return spark.read.schema(documents.schema).json(f"{path}/documents")
