"""Evaluation sets: source documents, provenance, category checks, rank metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_documents(chunks: DataFrame, page: list[str], limit: int = 12000) -> DataFrame:
    """(page, content, chunk_ids): a page's text chunks in order, joined by blank lines, cut to the limit."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content")))
    out = chunks.where("chunk_type = 'text'").groupBy(*page).agg(rows.alias("r"))
    return out.select(*page, F.substring(F.array_join(F.transform("r", lambda x: x["content"]), "\n\n"), 1, limit).alias("content"), F.transform("r", lambda x: x["id"]).alias("chunk_ids"))


def overview_windows(pages: DataFrame, doc: str, page: str, window: int = 8, stride: int = 6, least: int = 3) -> DataFrame:
    """(doc, start, pages): windows of consecutive pages of a document, a new one every `stride`; shorter than `least` ones are left out."""
    if window < least or stride < 1:
        raise ValueError(f"window must be {least} or more, stride positive")
    numbered = pages.withColumn("rn", F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1)
    # a page is in the windows that began at most window - 1 pages before it
    begins = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("rn") - window + 1) / stride).cast("int")), F.floor(F.col("rn") / stride).cast("int"))
    each = numbered.select(doc, page, F.explode(F.transform(begins, lambda b: b * stride)).alias("start"))
    return each.groupBy(doc, "start").agg(F.array_sort(F.collect_list(page)).alias("pages")).where(F.size("pages") >= least)


def modality_context(chunks: DataFrame, page_docs: DataFrame, page: list[str], limit: int = 4000) -> DataFrame:
    """Table and visual chunks with their page's text, cut to the limit."""
    near = page_docs.select(*page, F.substring("content", 1, limit).alias("page_text"))
    return chunks.where(F.col("chunk_type").isin("table", "visual")).join(near, page, "left")


MARKER = r"(?s)<!--\s*source:\s*(\{.*?\})\s*-->"
PROVENANCE = "pages array<int>, chunk_ids array<string>, types array<string>, docs array<string>"


def with_marker(content: Column, provenance: Column) -> Column:
    """content after a marker that holds its provenance as JSON."""
    return F.concat(F.lit("<!-- source: "), F.to_json(provenance), F.lit(" -->\n"), content)


def extract_provenance(rows: DataFrame, contexts: str, keep: list[str]) -> DataFrame:
    """keep, and the sorted different pages, chunk ids, types and documents of all markers in the contexts (array<string>); bad JSON is passed over."""
    marks = F.flatten(F.transform(contexts, lambda c: F.regexp_extract_all(c, F.lit(MARKER), F.lit(1))))
    parsed = F.array_compact(F.transform(marks, lambda m: F.from_json(m, PROVENANCE)))
    union = lambda name: F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(parsed, lambda p: F.coalesce(p[name], F.array()))))))
    return rows.select(*keep, *(union(n).alias(n) for n in ("pages", "chunk_ids", "types", "docs")))


def as_contexts(value: Column) -> Column:
    """A JSON list of texts, or a text, as an array; blank: empty."""
    parsed = F.from_json(value, "array<string>")
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.array().cast("array<string>")).when(value.rlike(r"^\s*\["), F.coalesce(parsed, F.array(value))).otherwise(F.array(value))


def violations(rows: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(category, wanted, rows, bad, valid): a category must have its number of rows; multi_hop two pages, overview three, table_visual a table or visual."""
    enough = F.when(F.col("category") == "multi_hop", F.size("source_pages") >= 2).when(F.col("category") == "overview", F.size("source_pages") >= 3)
    enough = enough.when(F.col("category") == "table_visual", F.arrays_overlap("source_types", F.array(F.lit("table"), F.lit("visual")))).otherwise(True)
    wanted = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(n)))), F.col("category"))
    out = rows.groupBy("category").agg(F.count("*").alias("rows"), F.count_if(~enough).alias("bad"))
    return out.withColumn("wanted", wanted.cast("long")).withColumn("valid", F.coalesce((F.col("bad") == 0) & (F.col("rows") == F.col("wanted")), F.lit(False)))


def rank_metrics(hits: DataFrame, relevant: DataFrame, k: int, id_col: str = "node_id") -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank) of ranked hits against (query_id, id)."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    right = hits.where(F.col("rank") <= k).join(relevant.withColumn("ok", F.lit(1)), ["query_id", id_col], "left")
    found = right.groupBy("query_id").agg(F.count("ok").alias("n"), F.min(F.when(F.col("ok") == 1, F.col("rank"))).alias("first"))
    out = total.join(found, "query_id", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    return out.select("query_id", (n / F.lit(float(k))).alias("precision"), (n / F.col("total")).alias("recall"), F.coalesce(F.lit(1e0) / F.col("first"), F.lit(0e0)).alias("reciprocal_rank"))


#: Texts that are summarised at once.
SUMMARY_SLICE = 256


def extractive_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 4, limit: int = 1500) -> DataFrame:
    """(id, summary): the sentences of most frequent words (over two letters, counted in the document), in their order.

    A row of docs is a document, and nothing is shuffled. Without a sentence that has such a word it has no summary.
    """
    parts = F.filter(F.split(F.regexp_replace(F.col(text_col), r"([.!?])\s+", "$1\u0001"), "\u0001|\n"), lambda s: F.trim(s) != "")
    each = docs.where(F.col(id_col).isNotNull()).select(id_col, parts.alias("s"))
    words = each.select(id_col, "s", F.transform("s", lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w"))

    def best(part: pa.RecordBatch) -> pa.RecordBatch:
        listed = pc.list_flatten(part["w"])
        row = pc.list_parent_indices(part["w"]).to_numpy().astype(np.int64)
        sentence, coded = pc.list_parent_indices(listed).to_numpy().astype(np.int64), pc.list_flatten(listed).dictionary_encode()
        _, at, n = np.unique(row[sentence] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        score = np.bincount(sentence, n[at], len(row))
        order = np.lexsort((-score, row))  # stable: of equal scores the first sentence
        order = order[score[order] > 0]
        ordered = row[order]
        chosen = np.sort(order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < sentences])
        rows, sizes = np.unique(row[chosen], return_counts=True)
        tops = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pc.list_flatten(part["s"]).take(pa.array(chosen)))
        return pa.RecordBatch.from_arrays([part[id_col].take(pa.array(rows)), tops], [id_col, "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (best(batch.slice(i, SUMMARY_SLICE)) for i in range(0, batch.num_rows, SUMMARY_SLICE))

    top = words.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, top array<string>")
    return top.select(id_col, F.substring(F.array_join(F.transform("top", lambda s: F.trim(s)), " "), 1, limit).alias("summary"))
