"""Exact top-k inner products by three-phase uniform threshold (Cao and Wang, PODC 2004).

The score of a row for a query is a sum over SLICES lists, one for each slice of the dimensions. Vectors are cut into
these slices and laid out in blocks of rows; the queries come in blocks too, and one task has one slice of one block of
rows and one block of queries.

1. Each list gives its k best rows and its lowest score. The candidates' whole scores are looked up, and the k-th best
   of them, t, is a safe lower bound of the k-th score.
2. Each query's cutoffs go back to the lists: a row that is below lowest_j + (t - sum of lowest) / SLICES in every list
   j cannot reach t. The others are collected, as one bitmap (queries x rows) for a list and pair of blocks, so what a
   task sends has a bound however weak the cutoffs are.
3. The collected rows' scores are resolved from the whole vectors, and the k best of each block of rows are merged.

Everything is in whole numbers, so ties are exact. Nothing is broadcast: cutoffs travel with the query blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._common import materialise

#: Blocks are as large as a task's memory allows with ease (8 MB a side at 64 dimensions, 32 MB for a bitmap): a row
#: travels once for each block of queries and a query once for each block of rows, so larger blocks mean less traffic.
SLICES, ROW_BLOCK, QUERY_BLOCK = 2, 16384, 16384
#: Queries whose local scores, and pairs whose vectors, a task holds at once.
AT_ONCE, PAIRS = 128, 50_000
_NO = np.iinfo(np.int64).max


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(uid, id, v): floor(scale * x) of each component as long, and a number of the row. Rows with a null id, a null or empty vector, or a null or non-finite component are left out; rows that share an id stay rows of their own. uid is fixed only once the result is written."""
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fine = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & fine)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _whole(products: np.ndarray) -> np.ndarray:
    return products if products.dtype == np.int64 else np.rint(products).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(table.num_rows, -1)


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_every, the k rows of highest integer inner product, its own left out.

    Ties go to the smaller id; if there are fewer than k rows, all come. Of rows that share an id each is a candidate,
    and each is a query if the id is divisible (its own row alone is left out). Vectors of another length than the
    query's take no part for it. An empty table gives an empty result; further columns are left, texts play no part.
    """
    rows = materialise(integer_vectors(vectors, id_col, vector_col, scale))
    lengths = [r[0] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    out = None
    for n in lengths:
        part = _top_k(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, k, n, query_every)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _top_k(rows: DataFrame, k: int, length: int, every: int) -> DataFrame:
    slices = min(SLICES, length)
    edges = [length * j // slices for j in range(slices + 1)]
    # aliases make columns of their own: a cogroup takes those that both sides share for one
    queries = rows.where(F.col("id") % every == 0).select(*(F.col(c).alias(c) for c in ("uid", "id", "v")))
    count, asked = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-count // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    pieces = F.array(*(F.struct(F.lit(j).alias("slice"), F.slice("v", edges[j] + 1, edges[j + 1] - edges[j]).alias("v")) for j in range(slices)))
    no_cuts = F.lit(None).cast("array<bigint>").alias("cutoffs")

    def laid_out(df: DataFrame, own: int, other: int, block: str, spread: str) -> DataFrame:
        """Vectors in their block, once for every block of the other side."""
        placed = df.withColumn(block, F.pmod(F.xxhash64("uid"), F.lit(own)).cast("int"))
        return placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(spread))

    def sliced(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != "v"]
        return df.select(*rest, F.explode(pieces).alias("piece")).select(*rest, "piece.slice", "piece.v")

    whole_rows, whole_queries = laid_out(rows, blocks, query_blocks, "rb", "qb"), laid_out(queries.select("uid", "id", "v", no_cuts), query_blocks, blocks, "qb", "rb")
    lists, asking = sliced(whole_rows).groupBy("slice", "rb", "qb"), sliced(whole_queries).groupBy("slice", "rb", "qb")

    def sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows' numbers, ids and vectors in order of id, queries' numbers and vectors in order of number, and the order of the queries."""
        uids, ids = left["uid"].to_numpy(), left["id"].to_numpy()
        lo, ro = np.lexsort((uids, ids)), np.argsort(right["uid"].to_numpy())
        v, q = _matrix(left)[lo], _matrix(right)[ro]
        # products and sums below 2^53 are exact in floating point, which is faster
        if float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 1 << 53:
            v, q = v.astype(np.float64), q.astype(np.float64)
        return uids[lo], ids[lo], v, right["uid"].to_numpy()[ro], q, ro

    def local(uids: np.ndarray, vectors: np.ndarray, quids: np.ndarray, asked_for: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
        """First query and partial scores (AT_ONCE queries x rows; None if no query of the part is wanted); a query's own row gets the least number."""
        by_uid = np.argsort(uids)
        for at in range(0, len(quids), AT_ONCE):
            if wanted is not None and not wanted[at : at + AT_ONCE].any():
                yield at, None
                continue
            q = quids[at : at + AT_ONCE]
            scores = _whole(asked_for[at : at + AT_ONCE] @ vectors.T)
            place = by_uid[np.minimum(np.searchsorted(uids, q, sorter=by_uid), len(uids) - 1)]
            own = np.flatnonzero(uids[place] == q)
            scores[own, place[own]] = -_NO
            yield at, scores

    mark_kind = pa.schema([("rb", pa.int32()), ("qb", pa.int32()), ("slice", pa.int32()), ("marks", pa.binary()), ("q", pa.binary()), ("low", pa.binary())])
    mark_ddl = "rb int, qb int, slice int, marks binary, q binary, low binary"

    def marked(left: pa.Table, right: pa.Table, choose, least: np.ndarray | None = None) -> pa.Table:
        """One row: the bitmap of what choose() takes of the partial scores, and the queries' lowest scores (those with a cutoff need none)."""
        if not left.num_rows or not right.num_rows:
            return mark_kind.empty_table()
        uids, _, vectors, quids, asked_for, order = sides(left, right)
        wanted = None
        if least is not None:
            # by Cauchy and Schwarz no row of the block reaches a cutoff above the product of the lengths
            length = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            wanted = least[order] <= length(asked_for) * length(vectors).max() * (1 + 1e-9) + 1
        marks, lows = [], []
        for at, scores in local(uids, vectors, quids, asked_for, wanted):
            if scores is None:
                marks.append(np.zeros((min(AT_ONCE, len(quids) - at), -(-len(uids) // 8)), np.uint8))
                continue
            marks.append(np.packbits(choose(at, scores, order), axis=1))
            if least is None:
                lows.append(np.where(scores == -_NO, _NO, scores).min(axis=1))
        key = [left[c][0].as_py() for c in ("rb", "qb", "slice")]
        packed = zstandard.ZstdCompressor(level=1).compress(np.concatenate(marks).tobytes())
        low = np.concatenate(lows).tobytes() if lows else None
        return pa.Table.from_pylist([dict(zip(mark_kind.names, [*key, packed, quids.tobytes(), low], strict=True))], schema=mark_kind)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        def choose(at: int, scores: np.ndarray, order: np.ndarray) -> np.ndarray:
            out = np.zeros(scores.shape, bool)
            m = min(k, scores.shape[1])
            np.put_along_axis(out, np.argpartition(-scores, m - 1, axis=1)[:, :m], True, axis=1)
            return out & (scores > -_NO)

        return marked(left, right, choose)

    def sufficient(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return mark_kind.empty_table()
        cuts, j = right["cutoffs"].to_pylist(), left["slice"][0].as_py()
        least = np.array([c[j] if c else -_NO + 1 for c in cuts], np.int64)
        return marked(left, right, lambda at, scores, order: scores >= least[order][at : at + AT_ONCE, None], least)

    score_kind = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """Whole scores of marked rows, the k best of the block for each query. right: query vectors, and bitmaps with a null number."""
        if not left.num_rows or not right.num_rows:  # a hash may leave a block empty
            return score_kind.empty_table()
        marks = right.filter(pc.is_null(right["uid"]))["marks"].to_pylist()
        right = right.filter(pc.is_valid(right["uid"]))
        if not right.num_rows or not marks:
            return score_kind.empty_table()
        _, ids, vectors, quids, asked_for, order = sides(left, right)
        query_ids = right["id"].to_numpy()[order]
        d = zstandard.ZstdDecompressor()
        bits = None
        for m in marks:
            part = np.frombuffer(d.decompress(m), np.uint8).reshape(len(quids), -1)
            bits = part if bits is None else bits | part
        out = []
        for at in range(0, len(quids), AT_ONCE):
            q, r = np.nonzero(np.unpackbits(bits[at : at + AT_ONCE], axis=1, count=len(ids)))
            q += at
            score = np.concatenate([np.zeros(0, np.int64), *(_whole(np.einsum("ij,ij->i", asked_for[q[i : i + PAIRS]], vectors[r[i : i + PAIRS]])) for i in range(0, len(q), PAIRS))])
            by_score = np.lexsort((r, -score, q))
            q, r, score = q[by_score], r[by_score], score[by_score]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            out.append((quids[q[nth < k]], query_ids[q[nth < k]], ids[r[nth < k]], score[nth < k]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=score_kind)

    def resolved(marks: DataFrame) -> DataFrame:
        """(q, query_id, id, score, rank): the k best of the marked rows of each query."""
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        vectors = whole_queries.select("rb", "qb", "uid", "id", "v", none("binary", "marks"))
        sent = vectors.unionByName(marks.select("rb", "qb", none("bigint", "uid"), none("bigint", "id"), none("array<bigint>", "v"), "marks"))
        scored = whole_rows.groupBy("rb", "qb").cogroup(sent.groupBy("rb", "qb")).applyInArrow(resolve, "q bigint, query_id bigint, id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def low_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, q, low in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                q, low = np.frombuffer(q, np.int64), np.frombuffer(low, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), j, np.int32)), pa.array(low)], ["q", "slice", "low"])

    first = materialise(lists.cogroup(asking).applyInArrow(best, mark_ddl))
    each = first.select("slice", "q", "low").mapInArrow(low_rows, "q bigint, slice int, low bigint").groupBy("q", "slice").agg(F.min("low").alias("low"))
    lows = each.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "low"))), lambda x: x["low"]).alias("lows"))
    bound = resolved(first).where(F.col("rank") == k).select("q", F.col("score").alias("t"))
    # a row reaches t only if some list has low_j + ceil((t - sum of lows) / slices) or more; no t (fewer than k rows): all are collected
    share = F.ceil((F.col("t") - F.aggregate("lows", F.lit(0).cast("long"), lambda a, x: a + x)) / slices).cast("long")
    cutoffs = lows.join(bound, "q").select(F.col("q").alias("uid"), F.transform("lows", lambda x: x + share).alias("cutoffs"))
    with_cuts = materialise(queries.join(cutoffs, "uid", "left"))
    collected = lists.cogroup(sliced(laid_out(with_cuts, query_blocks, blocks, "qb", "rb")).groupBy("slice", "rb", "qb")).applyInArrow(sufficient, mark_ddl)
    return resolved(collected).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
