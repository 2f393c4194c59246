"""Sharding by jump consistent hashing (Lamping and Veach, arXiv:1406.2294): no ring table, and a further shard takes rows only into itself.

The law is `key`: the id and the number of shards decide, so equal texts under different ids may part. The slot of
a row in its shard needs no task that holds a whole shard: rows are ranked in sub-buckets of the hash, and the
counts of the sub-buckets (shards x SUB_BUCKETS rows at most, a fixed bound) are broadcast as offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB_BUCKETS = 256


def mix(keys: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: one-to-one on 64 bits, so different keys stay different."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, in about ln(shards) rounds over the keys still moving."""
    key = keys.astype(np.uint64)
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = to[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        to[moving] = ((at[moving] + 1) * (2147483648.0 / ((key[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        moving = moving[to[moving] < shards]
    return at


def _placer(shards: int):
    @F.pandas_udf("struct<shard int, grown_shard int, sub int>")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, spread in batches:
            h = mix(ids.to_numpy(np.int64).view(np.uint64))
            sub = (h + spread.to_numpy(np.int64).view(np.uint64)) & np.uint64(SUB_BUCKETS - 1)
            yield pd.DataFrame({"shard": jump(h, shards).astype(np.int32), "grown_shard": jump(h, shards + 1).astype(np.int32), "sub": sub.astype(np.int32)})

    return place


def shard_rows(docs: DataFrame, key: str | Column = "doc_id", shards: int = 16, order: list[Column] | None = None, spread: Column | None = None) -> DataFrame:
    """docs with shard, slot (from 0, gapless in the shard) and grown_shard (the shard if there were one more).

    key is an integer, or anything else, of which xxhash64 is then the key. A null key counts as 0. order ranks the
    rows of a sub-bucket (default: the key, then the text if there is one). Rows equal in all of it get their slots in either order.
    spread (a long; default: a hash of the text if there is one) parts rows of one key, a null key's among them, over the sub-buckets, so
    a key that a third of all rows share is ranked in many tasks; only rows equal in key and spread are ranked in one, by a
    sort that spills. Whole texts are hashed, however long; an empty table gives an empty one.
    """
    key = F.col(key) if isinstance(key, str) else key
    kind = docs.select(key.alias("k")).schema["k"].dataType.simpleString()
    value = F.coalesce(key.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key), F.lit(0).cast("long"))
    if spread is None:
        spread = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    placed = docs.withColumn("__at", _placer(shards)(value, spread.cast("long")))
    counts = placed.groupBy(F.col("__at.shard").alias("__shard"), F.col("__at.sub").alias("__sub")).count()
    before = Window.partitionBy("__shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__shard", "__sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    rows = placed.select("*", F.col("__at.shard").alias("__shard"), F.col("__at.sub").alias("__sub"))
    within = Window.partitionBy("__shard", "__sub").orderBy(*(order or [value, *[F.xxhash64(c) for c in ("text",) if c in docs.columns]]))
    ranked = rows.withColumn("__rank", F.row_number().over(within) - 1)
    joined = ranked.join(F.broadcast(offsets), ["__shard", "__sub"])
    out = joined.withColumns({"shard": F.col("__shard"), "slot": (F.col("__offset") + F.col("__rank")).cast("long"), "grown_shard": F.col("__at.grown_shard")})
    return out.drop("__at", "__shard", "__sub", "__rank", "__offset")
