"""Registration of queries, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.functions.text import STOPWORDS
from gristmill.operators.lineage import balanced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table; small ones of texts, which cost most for their size, over all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(rows, large=True) if name in ("documents", "pages") else rows


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def terms_sql(source: str, key: str, name: str = "terms") -> str:
    """CTEs: (key, token), the index terms of source's text."""
    return rf"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)?|\p{{L}}+(?:_\p{{L}}+)*')) AS w FROM {source}),
{name}_f AS (SELECT {key}, w, replace(strip_accents(w), 'đ', 'd') AS f FROM {name}_w),
{name}_k AS (SELECT * FROM {name}_f WHERE (length(f) > 1 OR regexp_matches(f, '^[0-9]+$')) AND f NOT IN ({_STOP})),
{name} AS (SELECT {key}, f AS token FROM {name}_k UNION ALL SELECT {key}, w FROM {name}_k WHERE w <> f)"""


#: CTEs: posting (doc_id, token, tf), dl (doc_id, dl, avgdl, n), idf (token, idf).
BM25_SQL = f"""{terms_sql("documents", "doc_id")},
posting AS (SELECT doc_id, token, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT d.doc_id, count(t.token) AS dl FROM documents d LEFT JOIN terms t USING (doc_id) GROUP BY d.doc_id),
dl AS (SELECT *, avg(dl) OVER () AS avgdl, count(*) OVER () AS n FROM lengths),
idf AS (SELECT token, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM posting GROUP BY token),
part AS (SELECT doc_id, token, idf * tf * 2.7e0 / (tf + 1.7e0 * (1 - 0.83e0 + 0.83e0 * dl / avgdl)) AS part FROM posting JOIN dl USING (doc_id) JOIN idf USING (token))"""
