"""A training corpus from `documents`, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._common import materialise, release, scratch_mark
from gristmill.llm.language_id import identify, train
from gristmill.llm.line_dedup import dedup_lines
from gristmill.llm.packing import pack_documents
from gristmill.llm.simhash import one_of_each
from gristmill.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: The least score of a text whose language counts as known.
MIN_SCORE = 0.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: null or empty texts, those without a letter, and those that score below MIN_SCORE in every language.

    lang becomes the predicted one, so later stages and readers see what was decided. Where no language could be
    learned (no labelled rows), texts with a letter stay as they are.
    """
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document of which nothing is left goes too."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).where("n_lines > n_dropped").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, keeps the one of smallest doc_id; documents without an id come last and are compared like all others."""
    return one_of_each(docs).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that begin earlier; texts without any keep their lines. A document of which nothing is left goes."""
    cut = dedup_substrings(docs.withColumn("whole", F.col("text")))
    text = F.when(F.col("n_removed") == 0, F.col("whole")).otherwise(F.col("text"))
    return cut.where("n_removed < n_words").withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in training sequences of 2,048 words: no two near copies and no two documents of a source in one."""
    return pack_documents(docs)


STAGES = [("language_id", known_language), ("line_dedup", without_repeated_lines), ("simhash_near_dedup", one_of_each_group), ("substring_dedup", without_repeated_passages), ("best_fit_packing", packed)]

#: No SQL: language, fingerprints and packing can't be expressed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Between stages there is one table: those of earlier stages are removed as soon as the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = scratch_mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            release(spark, before, but_last=True)
    return docs
