"""python -m gristmill.cli: chunk, leaves, tree, index, search, search-index, graph-docs over JSON lines and Parquet folders."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import tokens
from gristmill.operators import chunking, knowledge, retrieval
from gristmill.operators.index import Index, build_index
from gristmill.operators.providers import HashingEmbedder, embed
from gristmill.operators.tree import TreeOptions, build_tree
from gristmill.sources import files


def _chunk(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = spark.read.parquet(a.input)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "line"))
    return chunking.chunk_sections(chunking.sections(lines, ["doc_id"]), ["doc_id"], chunking.ChunkOptions(max(1, a.max_chars), max(0, a.overlap_words)))


def _leaves(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return files.load_leaves(files.read_jsonl(spark, a.input))


def _tree(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    leaves = spark.read.parquet(a.input)
    return build_tree(leaves.join(embed(leaves, HashingEmbedder(), "node_id"), "node_id"), TreeOptions(max_depth=max(1, a.max_depth)))


def _search(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if not a.question.strip():
        raise SystemExit("the question is empty")
    nodes = spark.read.parquet(a.input)
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(a.question).alias("text"))
    scored = retrieval.bm25(nodes, tokens(F.col("text")), asked, "node_id", tokens(F.col("text")))
    return retrieval.result_rows(retrieval.ranked(scored, max(1, a.top_k), ["query_id"], positive=True), nodes).orderBy("rank")


def _index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if not a.index:
        raise SystemExit("--index names the folder of the index")
    built = build_index(spark.read.parquet(a.input), tokens(F.col("text")), a.index, HashingEmbedder(), "hashing")
    return spark.createDataFrame([(a.index, built)], "index string, built boolean")


def _search_index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if not a.question.strip():
        raise SystemExit("the question is empty")
    found = Index(spark, a.input)
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(a.question).alias("text"))
    best = retrieval.ranked(found.bm25(asked, tokens(F.col("text"))), max(1, a.top_k), ["query_id"], positive=True)
    return retrieval.result_rows(best, found.nodes()).orderBy("rank")


def _graph_documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = files.read_jsonl(spark, a.input, files.EXTRACTION, "*.json*").where("_corrupt is null").drop("_corrupt", "source_jsonl")
    graph = knowledge.build_graph(rows, knowledge.GraphOptions(min_mentions=max(1, a.min_mentions), min_weight=max(1, a.min_weight)))
    return knowledge.graph_to_documents(graph["entities"], graph["relations"])


COMMANDS = {"chunk": _chunk, "leaves": _leaves, "tree": _tree, "search": _search, "index": _index, "search-index": _search_index, "graph-docs": _graph_documents}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristmill")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("--output", help="folder for Parquet; without it rows are shown")
    p.add_argument("--question", default="")
    p.add_argument("--index", help="folder of a persisted index")
    for name, default in (("top-k", 10), ("max-chars", 1400), ("overlap-words", 45), ("max-depth", 4), ("min-mentions", 1), ("min-weight", 1)):
        p.add_argument(f"--{name}", type=int, default=default)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    out = COMMANDS[a.command](SparkSession.builder.appName("gristmill").getOrCreate(), a)
    out.write.mode("overwrite").parquet(a.output) if a.output else out.show(a.top_k, truncate=100)


if __name__ == "__main__":
    main()
