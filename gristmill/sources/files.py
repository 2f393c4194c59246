"""Readers and writers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.text import estimate_tokens, squeeze, stable_id, strip_context

METADATA = "map<string,string>"
CHUNK = f"id string, doc_name string, page_number int, chunk_type string, chunk_index int, content string, search_text string, metadata {METADATA}, reconstruction {METADATA}"
NODE = f"node_id string, source_chunk_id string, depth int, text string, token_estimate long, is_leaf boolean, child_node_ids array<string>, source_docs array<string>, source_pages array<int>, chunk_type string, chunk_index int, layer string, metadata {METADATA}"
EVIDENCE = "struct<chunk_id:string,doc_name:string,page_number:int,chunk_type:string,snippet:string>"
ENTITY = f"node_id string, name string, aliases array<string>, type string, description string, mention_count long, evidence array<{EVIDENCE}>, community_id string"
RELATION = f"relation_id string, source string, target string, type string, description string, weight long, evidence array<{EVIDENCE}>"
EXTRACTION = "chunk_id string, doc_name string, page_number int, chunk_type string, content string, entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string,description:string>>"


def find_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of PDF files, one or all under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(path).select("path", "length", "content").orderBy("path")


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines under a path with a declared schema; blank lines are passed over, broken ones kept in _corrupt."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("source_jsonl", F.input_file_name())


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_markdown(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(column).write.mode(mode).option("lineSep", "\n\n").text(path)


def load_leaves(chunks: DataFrame) -> DataFrame:
    """Leaf nodes of a summary tree from chunks: content or else search text, blank ones left out, in the order (document, page, type, index)."""
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", c)
    text = squeeze(F.coalesce(filled(F.col("content")), filled(F.col("search_text"))))
    rows = chunks.withColumn("text", text).where(F.coalesce("text", F.lit("")) != "")
    key = stable_id(F.coalesce(F.col("id"), F.lit("")), F.col("doc_name"), F.col("page_number"), F.col("chunk_index"), F.col("text"), prefix="leaf_")
    return rows.select(key.alias("node_id"), F.col("id").alias("source_chunk_id"), F.lit(0).alias("depth"), "text", estimate_tokens(F.col("text")).alias("token_estimate"), F.lit(True).alias("is_leaf"), F.array().cast("array<string>").alias("child_node_ids"), F.array_compact(F.array("doc_name")).alias("source_docs"), F.array_compact(F.array("page_number")).alias("source_pages"), "chunk_type", "chunk_index")


def load_source_chunks(chunks: DataFrame, include_visual: bool = False, least: int = 12, most: int = 6000) -> DataFrame:
    """Chunks for extraction: without the bracketed context, long enough, clipped; a missing page counts as 0."""
    rows = chunks if include_visual else chunks.where(F.coalesce("chunk_type", F.lit("")) != "visual")
    text = F.trim(strip_context(F.coalesce(F.col("content"), F.lit(""))))
    return rows.select(F.coalesce("id", stable_id(F.col("doc_name"), F.col("page_number"), text)).alias("chunk_id"), F.coalesce("doc_name", F.lit("document")).alias("doc_name"), F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"), F.substring(text, 1, most).alias("content")).where(F.char_length("content") >= least)


def load_evaluation_chunks(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Chunks for evaluation sets; none is an error."""
    rows = read_jsonl(spark, path, glob=glob).where("_corrupt is null")
    if not rows.select("content", "doc_name").limit(1).collect():
        raise ValueError(f"no chunks under {path}")
    return rows.drop("_corrupt")


def page_limit(pages: DataFrame, most: int | None) -> DataFrame:
    return pages if most is None else pages.where(F.col("page_number") <= most)


def union_documents(parts: list[DataFrame]) -> DataFrame:
    """One table of several kinds of documents; columns that a kind lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fingerprint(rows: DataFrame, key: str, text: Column) -> str:
    """A digest of all rows that no order changes: the sum of their hashes, combined on the executors."""
    h = F.xxhash64(F.col(key).cast("string"), text).cast("decimal(38,0)")
    row = rows.agg(F.count("*"), F.sum(h)).first()
    return f"{row[0]}:{row[1]}"


def with_sequence(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
