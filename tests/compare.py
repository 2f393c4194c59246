"""Compares a query with its SQL over the same tables: columns, types of result, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(value(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items()))
    return x


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    kinds = [str(d[1]) for d in done.description]
    return names, kinds, done.fetchall()


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if the same."""
    names, _, expected = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(value(r[names.index(c)]) for c in order) for r in expected)
    got = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows and {sum(want.values())}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
