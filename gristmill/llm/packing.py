"""Best-fit packing under conflicts.

Bins of a fixed capacity lie in order of what is left in them (then of their number) and carry one bitmap of the
sources and one of the duplicate clusters that they hold. A piece goes to the tightest bin that has room and shares
neither with it: the search begins at the first bin with enough room and goes on to the next until one is compatible;
if none is, a new bin opens. So no bin holds two pieces of one duplicate cluster, or more than one document of a source.

A document longer than the capacity is cut: its full pieces have bins of their own, the rest is packed like any other.
Documents are spread over shards of bounded size by a hash of id, cluster and, for equal rows, their count, so neither
a hot source nor a hot cluster nor a row that is repeated very often gathers in one task; only lengths and numbers are
shuffled, no texts. The number of shards follows the number of rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import LOWER, UPPER, WORD_RE

CAPACITY, SHARD_ROWS = 2048, 4000
#: Repeats of a row that one task makes from their count.
REPEATS = 1 << 16


def pack(items: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """For items (length from 1 to capacity, source, cluster; numbers from 0), in this order: bin and offset of each."""
    order: list[tuple[int, int]] = []  # (room left, bin)
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= s
        clusters[number] |= c
        out.append((number, capacity - room))
        if room > length:
            insort(order, (room - length, number))
    return out


def copy_group(text_col: str = "text") -> Column:
    """The same for texts whose words are equal but for the case of A-Z and white space."""
    flat = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(flat)


def spread(docs: DataFrame, id_col: str, source_col: str, length: Column, cluster: Column, shard_rows: int) -> DataFrame:
    """(id, source, n, cluster, shard): what packing needs of each document. Equal rows are counted before the shuffle and numbered again after it, so that they part."""
    shards = max(1, -(-docs.count() // shard_rows))
    light = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("\0null")).cast("string").alias("source"), F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("n"), cluster.cast("long").alias("cluster"))
    columns = ["id", "source", "n", "cluster"]
    counted = light.groupBy(*columns).agg(F.count("*").alias("copies"))
    few = counted.where(F.col("copies") <= REPEATS).select(*columns, F.lit(0).cast("long").alias("block"), "copies")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS)))
    many = counted.where(F.col("copies") > REPEATS).select(*columns, blocks.alias("block"), "copies").repartition(*columns, "block")
    last = F.least(F.lit(REPEATS).cast("long"), F.col("copies") - F.col("block") * REPEATS)
    each = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    return each.select(*columns, F.pmod(F.xxhash64("id", "cluster", "block", "copy"), F.lit(shards)).cast("long").alias("shard"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(bin, slot, id, piece, start, length, offset): a row for each piece, whole documents over all its rows.

    length defaults to the number of words, cluster to copies up to case and white space. start is the piece's first
    word in the document, offset its place in the bin, slot its rank there. bin is `shard.number` as one long. A shard
    packs longest pieces first, then by id. A document without words has one piece of length 0: bin -1, no place. A
    null source is a source of its own; null ids come last; repeated rows are packed each, never into one bin. Ids are
    of any type that sorts. Further columns are left; an empty table gives an empty one. A very long document has a bin for
    each full piece, so its rows grow with it.
    """
    if not 0 < capacity < 1 << 31:
        raise ValueError("capacity must be positive")
    kind = docs.schema[id_col].dataType.simpleString()
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_RE), F.lit(0)))
    light = spread(docs, id_col, source_col, words if length is None else length, copy_group(text_col) if cluster is None else cluster, shard_rows)
    names = ["bin", "slot", "id", "piece", "start", "length", "offset"]

    def run(table: pa.Table) -> pa.Table:
        columns = (table[c].to_pylist() for c in ("id", "n", "source", "cluster"))
        rows = sorted(zip(*columns, strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[2], r[1]))
        shard = table["shard"][0].as_py() if rows else 0
        sources, clusters, items, out = {}, {}, [], []
        full = 0
        for id_, n, source, cluster_ in rows:
            s, c = sources.setdefault(source, len(sources)), clusters.setdefault(cluster_, len(clusters))
            if n == 0:
                out.append((-1, None, id_, 0, 0, 0, None))
            for piece in range(n // capacity):
                out.append(((shard << 32) + (1 << 31) + full, 0, id_, piece, piece * capacity, capacity, 0))
                full += 1
            if n % capacity:
                items.append((n % capacity, s, c, id_, n // capacity))
        items.sort(key=lambda x: -x[0])
        slots: dict[int, int] = {}
        for (size, _, _, id_, piece), (number, offset) in zip(items, pack([x[:3] for x in items], capacity), strict=True):
            slots[number] = slot = slots.get(number, -1) + 1
            out.append(((shard << 32) + number, slot, id_, piece, piece * capacity, size, offset))
        types = [pa.int64(), pa.int32(), table.schema.field("id").type, *[pa.int64()] * 4]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    packed = light.groupBy("shard").applyInArrow(run, f"bin bigint, slot int, id {kind}, piece bigint, start bigint, length bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
