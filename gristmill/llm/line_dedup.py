"""Line deduplication in DataFrame functions alone.

Lines are exploded and normalised, hashed to 128 bits, and counted by distinct document; a line whose key is in
enough documents is dropped except in the smallest doc_id that holds it; the rest is put together by position.

Shuffles: hashes with their minimum (combined before the shuffle), the dropped positions, and each text once.
A key that a third of all lines share reaches no single task: the count is pre-aggregated, and the lookup of
dropped keys broadcasts the 1,000 most frequent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import LONG_MAX, LOWER, UPPER, WHOLE, WS, lookup, materialise


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(WS))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """docs with its text less the repeated lines, and n_lines, n_dropped (long).

    Ids are whole numbers, any other kind is an error. Null or empty text: one empty line. A null id counts as one document, larger than any other. Rows that share an
    id are one document: none of its lines is dropped because of another of its rows. An empty table gives an empty one; further columns stay.
    """
    if docs.schema[id_col].dataType.simpleString() not in WHOLE:
        raise TypeError(f"{id_col} must be a whole number")
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MAX))
    raw = docs.select(row.alias("row"), own.alias("own"), F.posexplode(F.split(F.translate(F.col(text_col), UPPER, LOWER), "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(WS))
    lines = materialise(raw.select("row", "own", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select("row", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")))
    if min_docs == 2:
        found = lines.groupBy("h1", "h2").agg(F.min("own").alias("first"), F.max("own").alias("last"), F.count("*").alias("n")).where("first < last")
    else:
        each = lines.groupBy("h1", "h2", "own").agg(F.count("*").alias("n"))
        found = each.groupBy("h1", "h2").agg(F.min("own").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    found = materialise(found.select("h1", "h2", "first", "n"))
    gone = lookup(lines, found, ["h1", "h2"], "n", "inner").where(F.col("own") > F.col("first"))
    gone = gone.groupBy("row", "own").agg(F.collect_set("pos").alias("gone"))
    names = {"row": "__row", "own": "__own", "gone": "__gone"}
    whole = docs.withColumns({"__row": row, "__own": own}).join(gone.withColumnsRenamed(names), ["__row", "__own"], "left")
    whole = whole.withColumn("n_lines", (F.char_length(F.coalesce(text_col, F.lit(""))) - F.char_length(F.translate(F.coalesce(text_col, F.lit("")), "\n", "")) + 1).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("__gone"))
    # transform() over a one-element array binds the lines once; else they would be split again for every position
    kept = F.transform(F.array(F.split(F.col(text_col), "\n", -1)), lambda ls: F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n"))[0]
    return whole.withColumns({text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}).drop(*names.values())
