"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits are cut into BLOCKS parts. If two fingerprints differ in at most `distance` bits, at most that many parts
differ, so they agree in BLOCKS - distance parts or more: grouping by every choice of that many parts loses no pair
(6 parts, distance 4: 15 choices of two parts, about 21 bits each). Equal fingerprints are one node from the start.
With more fingerprints there are more parts, hence longer keys (7: 35 choices of 27 bits, 8: 70 of 32), so that a key
that is met by chance stays with a few fingerprints; any number of parts over the distance finds the same pairs.

Inside a group only links of a spanning forest leave a task, found by exact Hamming distances in numpy, so a group of
n close fingerprints gives n - 1 links, not n^2 / 2. A group of more than PART members is cut into parts, and
every pair of parts is verified in a task of its own; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._common import LONG_MAX, WHOLE, checkpointed, lookup, materialise
from gristmill.llm._words import texts
from gristmill.llm.components import connected_components

#: Least number of parts; fingerprints that share a key by chance, at most; members of a group verified in one task.
BLOCKS, BY_CHANCE, PART = 6, 32, 4096
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The bits set in over half of the hashes of the word shingles, repeats included; no words: 0."""
    words = data.translate(_UPPER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends = begin[: len(words) - shingle + 1].tolist(), (begin[shingle:] - 1).tolist()
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 14):
        h = b"".join([digest(line[s:e], seed) for s, e in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer. Null text: no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.tobytes(), shingle) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def forest(a: np.ndarray, b: np.ndarray, same: bool, distance: int) -> list[tuple[int, int]]:
    """Links (i in a, j in b) that join all members within the distance of each other, directly or over others."""
    n = len(a) if same else len(a) + len(b)
    shift = 0 if same else len(a)
    root, links = np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    rows = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= distance
        for k in range(len(near)):
            i = at + k
            js = np.flatnonzero(near[k])
            if same:
                js = js[js > i]
            if len(js):
                js = js[root[js + shift] != find(i)]
            for j in js.tolist():
                x, y = find(i), find(j + shift)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((i, j))
    return links


def blocks_for(fingerprints: int, distance: int) -> int:
    """The number of parts for so many different fingerprints."""
    blocks = max(BLOCKS, distance + 1)
    while blocks < 16 and fingerprints >> (64 * (blocks - distance) // blocks) > BY_CHANCE:
        blocks += 1
    return blocks


def near_links(nodes: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the nodes (node, fp; different fps) that join all within the distance; not all pairs."""
    if not 0 <= distance < 16:
        raise ValueError("distance must be from 0 to 15")
    blocks = blocks or blocks_for(nodes.count(), distance)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[p + 1]) - 1) ^ ((1 << edges[p]) - 1) for p in parts) for parts in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("node", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("choice", "key"))
    # the window sorts and spills; nothing of a group is gathered before oversized ones are cut
    group = Window.partitionBy("choice", "key")
    sized = keyed.select("*", F.count("*").over(group).alias("n")).where("n > 1")
    sized = sized.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    low = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("p"), F.greatest(p, F.col("part")).alias("q")))
    spread = sized.select("choice", "key", "part", "node", "fp", F.explode(low).alias("pq")).select("choice", "key", "pq.p", "pq.q", "part", "node", "fp")
    spread = spread.repartition("choice", "key", "p", "q").sortWithinPartitions("choice", "key", "p", "q")

    def links_of(choice: np.ndarray, key: np.ndarray, frame: pd.DataFrame) -> list[tuple[int, int]]:
        """Of whole groups, one after another."""
        p, q, part, node, fp = (frame[c].to_numpy() for c in ("p", "q", "part", "node", "fp"))
        fp = fp.view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(fp)))
        pairs = begins[(sizes == 2) & (p[begins] == q[begins])]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance]
        out = list(zip(node[near].tolist(), node[near + 1].tolist(), strict=True))
        for s, n in zip(begins.tolist(), sizes.tolist(), strict=True):
            if n == 1 or (n == 2 and p[s] == q[s]):
                continue
            own, at = fp[s : s + n], node[s : s + n]
            if p[s] == q[s]:
                out += [(int(at[i]), int(at[j])) for i, j in forest(own, own, True, distance)]
            else:
                left, right = part[s : s + n] == p[s], part[s : s + n] == q[s]
                na, nb = at[left], at[right]
                out += [(int(na[i]), int(nb[j])) for i, j in forest(own[left], own[right], False, distance)]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = frame.iloc[-1]
            tail = (frame["choice"] == last["choice"]) & (frame["key"] == last["key"]) & (frame["p"] == last["p"]) & (frame["q"] == last["q"])
            begin = int(np.argmax(tail.to_numpy()))
            held.append(frame.iloc[:begin])
            whole = pd.concat(held) if len(held) > 1 else held[0]
            if begin or not tail.all():
                yield pd.DataFrame(links_of(whole["choice"].to_numpy(), whole["key"].to_numpy(), whole), columns=["a", "b"], dtype=np.int64)
                held = [frame.iloc[begin:]]
            else:
                held[-1] = frame
        if held:
            whole = pd.concat(held)
            yield pd.DataFrame(links_of(whole["choice"].to_numpy(), whole["key"].to_numpy(), whole), columns=["a", "b"], dtype=np.int64)

    return spread.mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """(id, fp, component_id): the fingerprint and the smallest id reachable over links of at most `distance` bits.

    Documents without words have fingerprint 0 and are linked like any other. A null id counts as the largest number.
    Ids are whole numbers, any other kind is an error. Whole texts count, however long. Repeated rows share a component. Further columns are left; an empty table gives an empty one.
    """
    if docs.schema[id_col].dataType.simpleString() not in WHOLE:
        raise TypeError(f"{id_col} must be a whole number")
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MAX))).alias("node"), F.count("*").alias("n")))
    found = connected_components(near_links(nodes.select("node", "fp"), distance))
    classes = materialise(nodes.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")))
    return lookup(prints, classes, ["fp"], "n", "inner").select(id_col, "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """docs less near-duplicates: of each component one row stays, that of smallest id (null last), then of smallest hash of the row.

    Components are those of the fingerprints alone, so rows that share an id, or have none, are compared like all
    others. Of rows equal in id and hash one stays. Only numbers are shuffled to choose the rows; the texts travel once, to the
    chosen ones. An empty table gives an empty one.
    """
    row = {"__last": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)), "__h": F.xxhash64(*docs.columns)}
    keyed = docs.withColumns(row)
    prints = materialise(fingerprints(keyed.withColumn("__own", F.struct(*row)), "__own", text_col, shingle))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("__own").alias("own")))
    found = connected_components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), distance))
    classed = nodes.join(found, nodes.fp == found.node, "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("own").alias("own"))
    kept = keyed.join(classed.select("own.*"), list(row), "left_semi").dropDuplicates(list(row))
    return kept.drop(*row)
