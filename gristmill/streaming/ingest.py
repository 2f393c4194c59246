"""Incremental ingest: new chunk files are cleaned, deduplicated and added to a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.chunking import make_chunks
from gristmill.sources.files import CHUNK
from gristmill.sources.store import Table


def read_chunks(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(chunks: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Adds chunks with their ids; a batch that runs again replaces its own rows, so each chunk is there once."""

    def add(batch: DataFrame, _: int) -> None:
        table.put(make_chunks(batch.where(F.trim(F.coalesce("content", F.lit(""))) != "")))

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "10 minutes", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """(start, kind, n) of a stream (or a table), with a watermark for late rows; tumbling windows, or sliding ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, window, slide or window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): runs of a key's events without a pause of `gap`; end is the last event plus the gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_within(events: DataFrame, key: list[str], time: str, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
