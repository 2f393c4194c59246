"""From what a PDF parser found on pages to chunks: text blocks, tables, pictures, a page's Markdown, and the job over all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.layout import clean_rows, clamp, looks_like_table
from gristmill.functions.text import fold, markdown_table, normalize_document, remove_footers, squeeze
from gristmill.operators import chunking as C

_BOX = ["x0", "y0", "x1", "y1"]


def text_blocks(spans: DataFrame, page: list[str]) -> DataFrame:
    """(page, block_index, box, text, avg_font_size, fonts) from a parser's spans (page, block_index, block_type, line_index, span_index, box, text, size, font).

    Blocks of text only (type 0); spans make lines, lines are normalised and lose footers, blank blocks go; at most five
    fonts are named, in order of name.
    """
    item = F.struct("line_index", "span_index", "text")
    by = [*page, "block_index"]
    rows = spans.where("block_type = 0").groupBy(*by, "line_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["text"]), "").alias("line"), *(F.min(c).alias(c) if c in ("x0", "y0") else F.max(c).alias(c) for c in _BOX), F.sum("size").alias("sizes"), F.count("size").alias("n"), F.collect_set("font").alias("fonts"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy(*by).agg(whole.alias("text"), *(F.min(c).alias(c) if c in ("x0", "y0") else F.max(c).alias(c) for c in _BOX), (F.sum("sizes") / F.sum("n")).alias("avg_font_size"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fonts")))), 1, 5).alias("fonts"))
    text = F.trim(remove_footers(normalize_document(F.col("text"), preserve_lines=True)))
    return out.withColumn("text", text).where("text <> ''").select(*by, *_BOX, "text", "avg_font_size", "fonts")


def body_font(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, body_font): the exact median of the blocks' font sizes, the mean of the middle two; null if none is known."""
    return blocks.groupBy(*by).agg(F.median("avg_font_size").alias("body_font"))


def distinct_tables(found: DataFrame, page: list[str]) -> DataFrame:
    """Tables (page, strategy, strategy_order, table_index, rows, width_share) that look like tables, cleaned; of equal ones (folded cells) of a page the first by strategy, then place."""
    rows = found.withColumn("rows", clean_rows(F.col("rows")))
    rows = rows.where(looks_like_table(F.col("rows"), F.col("strategy"), F.col("width_share")))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: squeeze(fold(c))), "\t")), "\n")
    rows = rows.withColumn("signature", F.sha1(cells))
    order = Window.partitionBy(*page, "signature").orderBy("strategy_order", "table_index")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def rounded_box(box: list[Column]) -> Column:
    """[x0, y0, x1, y1] to two decimals, halves to even."""
    return F.array(*(F.bround(b.cast("double"), 2) for b in box))


def clip_regions(regions: DataFrame, margin: float = 4.0, dpi: int = 144) -> DataFrame:
    """regions (box; page_x0 to page_y1) with `clip`, the box with a margin within the page, and its width and height in pixels at dpi, as a renderer needs them."""
    clip = clamp(tuple(F.col(c) for c in _BOX), tuple(F.col(f"page_{c}") for c in _BOX), margin)
    out = regions.withColumn("clip", clip)
    pixels = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(f"clip.{b}") - F.col(f"clip.{a}")) * dpi / 72e0)).cast("int")
    return out.withColumns({"width": pixels("x0", "x1"), "height": pixels("y0", "y1")})


def render_clips(regions: DataFrame, render: Callable[[dict], bytes], key: str) -> DataFrame:
    """(key, png): what the renderer makes of each clipped region, in batches on all tasks."""
    import pandas as pd

    kind = regions.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({key: frame[key].to_numpy(), "png": [render(r) for r in frame.to_dict("records")]})

    return regions.mapInPandas(run, f"`{key}` {kind}, png binary")


def page_markdown(parts: DataFrame, page: list[str], doc: str) -> DataFrame:
    """(page, markdown): a page's heading, then its parts (kind: text, table with rows, visual with asset) in order of y0, then place."""
    body = F.when(F.col("kind") == "table", F.concat(F.lit("**Table**\n\n"), markdown_table(F.col("rows")))).when(F.col("kind") == "visual", F.concat(F.lit("![visual]("), F.col("asset"), F.lit(")"))).otherwise(F.col("text"))
    rows = parts.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "place", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), F.col(doc).cast("string"), F.lit(", page "), F.col("page_number").cast("string"))
    return rows.select(*page, F.concat_ws("\n\n", head, "body").alias("markdown"))


def process(blocks: DataFrame, tables: DataFrame, visuals: DataFrame, options: C.ChunkOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks (id, doc_name, page_number, chunk_type, chunk_index, headings, content, search_text) of all documents, and the manifest (doc_name, pages, and chunks by kind).

    blocks: doc_name, page_number, block_index, box, text, avg_font_size; those under a table of the page are left out. tables:
    doc_name, page_number, rows, box; visuals: doc_name, page_number, region_id, box. A page's chunks are numbered by kind.
    """
    page = ["doc_name", "page_number"]
    free = C.outside(blocks, tables, page).join(body_font(blocks, ["doc_name"]), "doc_name")
    lines = free.select(*page, "avg_font_size", "body_font", "block_index", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*page, F.struct("block_index", "pos").alias("line_index"), "line", F.col("avg_font_size").alias("font_size"), "body_font")
    text = C.chunk_sections(C.sections(lines, page), page, options)
    none = F.array().cast("array<string>")
    number = lambda order: (F.row_number().over(Window.partitionBy(*page).orderBy(*order)) - 1).cast("int")
    of_text = text.select(*page, F.lit("text").alias("chunk_type"), "chunk_index", "headings", "content")
    of_tables = tables.select(*page, F.lit("table").alias("chunk_type"), number(["y0", "x0"]).alias("chunk_index"), none.alias("headings"), markdown_table(F.col("rows")).alias("content"))
    visuals = visuals.select(*page, "region_id", *_BOX)
    near = C.nearest_texts(visuals, free, page)
    of_visuals = visuals.join(near, [*page, "region_id"], "left").select(*page, F.lit("visual").alias("chunk_type"), number(["region_id"]).alias("chunk_index"), none.alias("headings"), F.concat(F.lit("Visual"), F.coalesce(F.concat(F.lit(" near:\n"), F.col("near")), F.lit(""))).alias("content"))
    chunks = C.make_chunks(of_text.unionByName(of_tables).unionByName(of_visuals))
    counts = chunks.groupBy("doc_name").agg(F.count_distinct("page_number").alias("pages"), *(F.count_if(F.col("chunk_type") == k).alias(f"{k}_chunks") for k in ("text", "table", "visual")))
    return chunks, counts
