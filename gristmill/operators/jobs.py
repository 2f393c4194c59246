"""Jobs that ask a text generator and keep its answers: contexts of chunks, rewritten questions, cluster summaries, evaluation sets.

Every job has a cache table by key, asks only for what is pending, and goes on without answers where none come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import squeeze, stable_id
from gristmill.operators.lineage import cut
from gristmill.operators.providers import Embedder, TextGenerator, batched, cache_key, embed, fallback_context, first_json, with_cache
from gristmill.operators.retrieval import clean_list

CONTEXT_PROMPT = "Say in one sentence for each numbered chunk where it stands in its document. Answer as JSON: {\"contexts\": [{\"id\": 1, \"context\": \"...\"}]}\n\n"


def shaped_contexts(answer: str, n: int) -> list[str]:
    """The contexts of a batch of n from a model's answer: whole-number ids from 1 to n, each with a text that isn't blank; anything else is an error."""
    found = first_json(answer)
    items = found.get("contexts") if isinstance(found, dict) else found
    if not isinstance(items, list):
        raise ValueError("no list of contexts")
    out = {}
    for x in items:
        text = " ".join(str(x.get("context") or "").split())
        if not text:
            raise ValueError("a blank context")
        out[int(x["id"])] = text
    if set(out) != set(range(1, n + 1)):
        raise ValueError("the ids are not those asked for")
    return [out[i] for i in range(1, n + 1)]


def context_key(chunks: DataFrame) -> Column:
    return cache_key("context", *(F.col(c).cast("string") for c in ("doc_name", "page_number")), F.array_join("headings", " > "), F.col("content"))


def ask_contexts(generator: TextGenerator, max_tokens: int = 2048) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Contexts of a batch (key, doc_name, page_number, content); after the first failure of a run nothing more is asked."""
    off: list[bool] = []

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        if off:
            raise RuntimeError("asking was given up in this run")
        lines = [f"{i}. ({d}, page {p})\n{c}" for i, (d, p, c) in enumerate(zip(part["doc_name"], part["page_number"], part["content"], strict=True), 1)]
        try:
            found = shaped_contexts(generator.generate(CONTEXT_PROMPT + "\n\n".join(lines), max_tokens), len(part))
        except Exception:
            off.append(True)
            raise
        return pd.DataFrame({"key": part["key"].to_numpy(), "context": found})

    return ask


def enrich(chunks: DataFrame, cache: DataFrame, ask: Callable[[pd.DataFrame], pd.DataFrame] | None, size: int = 20, budget: int | None = 40) -> tuple[DataFrame, DataFrame]:
    """chunks (doc_name, page_number, chunk_type, chunk_index, headings, content) with a bracketed context line before the content, its origin (cache, model, fallback), and ids of the new content; and the new rows (key, context) for the cache.

    ask None: no model. Chunks without an answer get the sentence that needs none. Chunks of several pages share batches, in order.
    """
    keyed = chunks.withColumn("key", context_key(chunks))
    had = cache.select("key", F.lit(True).alias("__had"))
    columns = ["key", "doc_name", "page_number", "content"]
    if ask is None:
        done, new = keyed.join(cache.select("key", "context"), "key", "left"), cache.limit(0).select("key", "context")
    else:
        make = lambda pending: batched(pending, columns, size, ask, "key string, context string", ["doc_name", "page_number", "key"], budget)
        done, new = with_cache(keyed, cache, "key", "context", make)
    rows = done.join(had, "key", "left")
    origin = F.when(F.col("__had"), "cache").when(F.col("context").isNotNull(), "model").otherwise("fallback")
    line = F.coalesce(F.concat(F.lit("["), squeeze(F.regexp_replace("context", r"[\[\]]", "")), F.lit("]")), fallback_context(F.col("doc_name"), F.col("page_number"), F.col("headings")))
    rows = rows.withColumns({"origin": origin, "content": F.concat(line, F.lit("\n"), F.col("content"))})
    id_ = stable_id(F.col("doc_name"), F.col("page_number"), F.col("chunk_type"), F.col("chunk_index"), F.substring("content", 1, 120))
    return rows.withColumn("id", id_).drop("key", "context", "__had"), new


def enrich_stats(rows: DataFrame) -> DataFrame:
    """(origin, n)."""
    return rows.groupBy("origin").agg(F.count("*").alias("n"))


FACETS = "hyde_document string, multi_queries array<string>, sub_questions array<string>, step_back_query string"
OPTIMISE_PROMPT = "Rewrite the question. Answer as JSON with hyde_document, multi_queries, sub_questions, step_back_query.\n\nQuestion: "


def optimise(questions: DataFrame, generator: TextGenerator | None, n: int = 3, strict: bool = False, max_tokens: int = 1024) -> DataFrame:
    """Query bundles (query_id, original, hyde_document, multi_queries, sub_questions, step_back_query) from questions (query_id, text).

    One request a question gives all expansions; lists are cleaned and cut to n. Whatever fails leaves the question as
    it is, alone (strict: raises). Without a generator all stay as they are. The answers are checkpointed, so nothing is asked twice.
    """
    base = questions.select("query_id", squeeze(F.coalesce("text", F.lit(""))).alias("original"))
    names = [x.split()[0] for x in FACETS.split(", ")]
    if generator is None:
        kinds = {x.split()[0]: x.split()[1] for x in FACETS.split(", ")}
        return base.select("*", *((F.array().cast(kinds[c]) if kinds[c].startswith("array") else F.lit(None).cast("string")).alias(c) for c in names))
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for id_, text in zip(frame["query_id"], frame["original"], strict=True):
                try:
                    found = first_json(generator.generate(OPTIMISE_PROMPT + text, max_tokens))
                    if not isinstance(found, dict):
                        raise ValueError("no JSON object in the answer")
                    rows.append((id_, json.dumps(found)))
                except Exception:
                    if strict:
                        raise
                    rows.append((id_, None))
            yield pd.DataFrame(rows, columns=["query_id", "reply"])

    replies = cut(base.mapInPandas(run, f"query_id {kind}, reply string"))
    parsed = base.join(replies.select("query_id", F.from_json("reply", FACETS).alias("r")), "query_id", "left")
    lists = [clean_list(F.col(f"r.{c}"), F.col("original"), n).alias(c) for c in ("multi_queries", "sub_questions")]
    blank = lambda c: F.when(squeeze(F.col(f"r.{c}")) != "", squeeze(F.col(f"r.{c}"))).alias(c)
    return parsed.select("query_id", "original", blank("hyde_document"), *lists, blank("step_back_query"))


SUMMARY_PROMPT = "Summarise the following texts as one.\n\n"


def summary_prompts(members: DataFrame, nodes: DataFrame, max_cluster_tokens: int = 9000, id_col: str = "node_id") -> DataFrame:
    """(cluster, children, prompt, key): numbered texts of the children in order of their id, cut so that all have max(6000, 5 x max_cluster_tokens) characters, and the key of their answer.

    Lengths are summed before texts are gathered, so a cluster of any size gathers no more than the limit.
    """
    limit = max(6000, 5 * max_cluster_tokens)
    rows = members.join(nodes.select(id_col, squeeze(F.col("text")).alias("t")), id_col)
    order = Window.partitionBy("cluster").orderBy(id_col)
    before = F.coalesce(F.sum(F.char_length("t") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumns({"n": F.row_number().over(order), "room": F.lit(limit) - before})
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.substring(F.col("t"), F.lit(1), F.col("room").cast("int")))
    shown = placed.where("room > 0").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("texts"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("children"))
    prompt = F.concat(F.lit(SUMMARY_PROMPT), F.col("texts"))
    return sizes.join(shown, "cluster").select("cluster", "children", prompt.alias("prompt"), cache_key("summary", prompt).alias("key"))


def summarise_clusters(prompts: DataFrame, cache: DataFrame, generator: TextGenerator, max_tokens: int = 384) -> tuple[DataFrame, DataFrame]:
    """prompts with `summary`, one request a cluster that the cache (key, summary) doesn't know, and the new rows of the cache. A request that fails, or gives a blank text, leaves null."""

    def make(pending: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for key, prompt in zip(frame["key"], frame["prompt"], strict=True):
                    try:
                        text = generator.generate(prompt, max_tokens).strip()
                    except Exception:  # stays pending  # noqa: BLE001
                        continue
                    if text:
                        rows.append((key, text))
                yield pd.DataFrame(rows, columns=["key", "summary"])

        return pending.select("key", "prompt").mapInPandas(run, "key string, summary string")

    return with_cache(prompts, cache, "key", "summary", make)


def reusable_layer(cached: DataFrame, clusters: DataFrame) -> bool:
    """Whether a cached layer (child_node_ids, text) can stand for the clusters (child_node_ids): every one is in it with a text that isn't blank."""
    good = cached.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.array_join(F.array_sort("child_node_ids"), "\n").alias("k")).distinct()
    return clusters.select(F.array_join(F.array_sort("child_node_ids"), "\n").alias("k")).join(good, "k", "left_anti").isEmpty()


def embed_cached(rows: DataFrame, cache: DataFrame, embedder: Embedder, model: str, key: str = "node_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows with `v`, from the cache (mark, v) where model, id and text are as they were, else embedded; and the new rows of the cache."""
    marked = rows.withColumn("mark", F.sha1(F.concat(F.lit(f"{model}\t"), F.col(key).cast("string"), F.lit("\t"), F.coalesce(F.col(text), F.lit("")))))
    done, new = with_cache(marked, cache, "mark", "v", lambda pending: embed(pending.select("mark", text), embedder, "mark", text))
    return done.drop("mark"), new


TESTSET_PROMPT = "Write a question that these texts answer, and the answer, as JSON: {\"user_input\": \"...\", \"reference\": \"...\"}\n\n"
COUNTS = {"multi_hop": 30, "overview": 20, "table_visual": 15}


def choose_sources(sources: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """The sources (category, id, contexts) to make questions of: of each category as many as wanted, by a hash of the id."""
    counts = counts or COUNTS
    wanted = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(n)))), F.col("category"))
    order = Window.partitionBy("category").orderBy(F.sha1(F.col("id").cast("string")), "id")
    return sources.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.coalesce(wanted, F.lit(0)))


def message_text(value: object) -> str:
    """The text of a generator's answer: a string, an object with content, or a list of parts."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return message_text(value.get("content", value.get("text")))
    if isinstance(value, (list, tuple)):
        return "".join(map(message_text, value))
    return message_text(getattr(value, "content", str(value)))


def generate_testset(sources: DataFrame, existing: DataFrame, generator: TextGenerator, counts: dict[str, int] | None = None, max_tokens: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(category, id, user_input, reference, contexts, origin) for the chosen sources, from `existing` (id, user_input, reference) where it has both texts, else generated; and the manifest (category, wanted, rows).

    An answer that can't be read leaves the source out, which the manifest shows.
    """
    chosen = choose_sources(sources, counts)
    valid = existing.where("trim(coalesce(user_input, '')) <> '' and trim(coalesce(reference, '')) <> ''").dropDuplicates(["id"])
    kind = sources.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for id_, contexts in zip(frame["id"], frame["contexts"], strict=True):
                try:
                    found = first_json(message_text(generator.generate(TESTSET_PROMPT + "\n\n".join(contexts), max_tokens)))
                    q, a = str(found["user_input"]).strip(), str(found["reference"]).strip()
                except Exception:  # noqa: BLE001
                    continue
                if q and a:
                    rows.append((id_, q, a))
            yield pd.DataFrame(rows, columns=["id", "user_input", "reference"])

    pending = chosen.join(valid.select("id"), "id", "left_anti").select("id", "contexts")
    made = cut(pending.mapInPandas(run, f"id {kind}, user_input string, reference string"))
    answers = valid.select("id", "user_input", "reference", F.lit("existing").alias("origin")).unionByName(made.withColumn("origin", F.lit("generated")))
    rows = chosen.join(answers, "id").select("category", "id", "user_input", "reference", "contexts", "origin")
    wanted = chosen.sparkSession.createDataFrame(sorted((counts or COUNTS).items()), "category string, wanted long")
    return rows, wanted.join(rows.groupBy("category").agg(F.count("*").alias("rows")), "category", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def normalize_records(rows: DataFrame) -> DataFrame:
    """Evaluation records with trimmed texts and contexts as an array of texts that aren't blank, in whichever form they came (JSON list, text)."""
    from gristmill.operators.evaluation import as_contexts

    contexts = F.filter(as_contexts(F.col("reference_contexts")), lambda c: F.trim(c) != "")
    return rows.withColumns({"user_input": F.trim(F.coalesce("user_input", F.lit(""))), "reference": F.trim(F.coalesce("reference", F.lit(""))), "reference_contexts": contexts}).where("user_input <> ''")
