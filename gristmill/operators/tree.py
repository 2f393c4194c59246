"""Recursive summary tree: reduction, mixture clustering by BIC, oversize splits, roll-up, ancestors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import estimate_tokens
from gristmill.operators.lineage import cut
from gristmill.operators.retrieval import matrix

#: Numbers in the vectors of a cluster that one task splits by itself (64 MB of doubles); larger clusters are split over all tasks.
LOCAL_CELLS = 1 << 23


@dataclass(frozen=True)
class TreeOptions:
    max_depth: int = 4
    components: int = 8
    max_k: int = 6
    min_cluster: int = 3
    max_cluster_tokens: int = 9000
    soft_threshold: float = 0.30
    memberships: int = 1
    seed: int = 42


def reduce_vectors(nodes: DataFrame, components: int, vector: str = "v") -> DataFrame:
    """nodes with `reduced`, the first principal components (fewer if the vectors are short or few)."""
    rows = nodes.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    width = nodes.select(F.size(vector)).first()[0]
    n = nodes.limit(components + 1).count()
    if n <= 2 or width <= components:
        return rows.withColumnRenamed("__v", "reduced")
    model = PCA(k=min(components, width, max(1, n - 1)), inputCol="__v", outputCol="reduced").fit(rows)
    return model.transform(rows).drop("__v")


def mixture(nodes: DataFrame, options: TreeOptions) -> tuple[DataFrame, int, dict[int, float]]:
    """nodes with `probability` under the mixture of least BIC, the number of its parts, and the BIC of each number."""
    rows = nodes.persist()
    n = rows.count()
    d = len(rows.select("reduced").first()[0])
    best, scores = None, {}
    for k in range(1, max(1, min(options.max_k, n - 1)) + 1):
        if n < 3 and k > 1:
            break
        model = GaussianMixture(k=max(k, 2) if k > 1 else 1, featuresCol="reduced", probabilityCol="probability", seed=options.seed, maxIter=50).fit(rows) if k > 1 else None
        if model is None:
            scores[1] = _one(rows, n, d)
        else:
            free = k * d + k * d * (d + 1) / 2 + k - 1
            scores[k] = -2 * model.summary.logLikelihood + free * math.log(n)
        if best is None or scores[k] < best[0]:
            best = (scores[k], k, model)
    rows.unpersist()
    if best[2] is None:
        return rows.withColumn("probability", array_to_vector(F.array(F.lit(1e0)))), 1, scores
    return best[2].transform(rows).drop("prediction"), best[1], scores


def _one(rows: DataFrame, n: int, d: int) -> float:
    """BIC of a single Gaussian, from the covariance that one pass gives."""
    x = vector_to_array("reduced")
    cells = [F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    row = rows.agg(*(F.sum(x[i]).alias(f"m{i}") for i in range(d)), *cells).first()
    mean = np.array([row[f"m{i}"] / n for i in range(d)])
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] / n for j in range(d)] for i in range(d)]) - np.outer(mean, mean) + 1e-5 * np.eye(d)
    log_likelihood = -0.5 * n * (d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + d)
    return -2 * log_likelihood + (d + d * (d + 1) / 2) * math.log(n)


def memberships(scored: DataFrame, options: TreeOptions, id_col: str = "node_id") -> DataFrame:
    """(id, cluster): the likeliest cluster, and further ones above the threshold up to `memberships`."""
    each = scored.select(id_col, F.posexplode(vector_to_array("probability")).alias("cluster", "p"))
    order = Window.partitionBy(id_col).orderBy(F.desc("p"), "cluster")
    return each.withColumn("r", F.row_number().over(order)).where((F.col("r") == 1) | ((F.col("r") <= options.memberships) & (F.col("p") > options.soft_threshold))).select(id_col, "cluster")


def _reduced(v: np.ndarray, components: int) -> np.ndarray:
    """As reduce_vectors()."""
    n, width = v.shape
    if n <= 2 or width <= components:
        return v
    values, vectors = np.linalg.eigh(np.cov(v, rowvar=False))
    return v @ vectors[:, np.argsort(-values)[: min(components, width, max(1, n - 1))]]


def _fitted(x: np.ndarray, k: int, seed: int, rounds: int = 50, tolerance: float = 0.01) -> tuple[np.ndarray, float]:
    """The probabilities of k Gaussians for each row, and the log-likelihood, by expectation-maximisation from the means of five rows each."""
    n, d = x.shape
    some = x[np.random.default_rng(seed).integers(0, n, (k, 5))]
    means, least = some.mean(axis=1), 1e-5 * np.eye(d)
    covs, weights = np.stack([np.diag(s.var(axis=0)) + least for s in some]), np.full(k, 1 / k)
    before = -np.inf
    for _ in range(rounds):
        logs = np.empty((k, n))
        for j in range(k):
            root = np.linalg.cholesky(covs[j])
            z = (x - means[j]) @ np.linalg.inv(root).T
            logs[j] = math.log(max(weights[j], 1e-300)) - 0.5 * (np.einsum("ij,ij->i", z, z) + d * math.log(2 * math.pi)) - np.log(np.diag(root)).sum()
        top = logs.max(axis=0)
        p = np.exp(logs - top)
        total = p.sum(axis=0)
        p /= total
        now = float((top + np.log(total)).sum())
        if abs(now - before) <= tolerance:
            break
        before = now
        for j in range(k):
            mass = max(p[j].sum(), 1e-12)
            means[j], weights[j] = p[j] @ x / mass, mass / n
            y = x - means[j]
            covs[j] = (p[j][:, None] * y).T @ y / mass + least
    return p.T, now


def _split(v: np.ndarray, options: TreeOptions) -> list[np.ndarray]:
    """The rows of each cluster of the mixture of least BIC, empty ones left out: mixture() and memberships() of vectors in memory."""
    x = _reduced(v, options.components)
    n, d = x.shape
    best = None
    for k in range(1, max(1, min(options.max_k, n - 1)) + 1):
        p, log_likelihood = _fitted(x, k, options.seed)
        bic = -2 * log_likelihood + (k * d + k * d * (d + 1) / 2 + k - 1) * math.log(n)
        if best is None or bic < best[0]:
            best = (bic, p)
    p = best[1]
    order = np.argsort(-p, axis=1, kind="stable")[:, : max(1, options.memberships)]
    taken = np.take_along_axis(p, order, axis=1) > options.soft_threshold
    taken[:, 0] = True
    found = (np.sort(np.nonzero(((order == j) & taken).any(axis=1))[0]) for j in range(p.shape[1]))
    return [rows for rows in found if len(rows)]


def split_in_memory(v: np.ndarray, tokens: np.ndarray, options: TreeOptions) -> list[np.ndarray]:
    """The rows of each cluster within an oversize one, split as cluster_level() does until none is too large or can be split."""
    done, left = [], [np.arange(len(v))]
    while left:
        rows = left.pop()
        parts = _split(v[rows], options) if len(rows) > 3 else [np.arange(len(rows))]
        for part in (rows[p] for p in parts):
            large = tokens[part].sum() > options.max_cluster_tokens and len(part) >= 2 * options.min_cluster and len(parts) > 1
            (left if large and len(part) < len(rows) else done).append(part)
    return done


def split_each(members: DataFrame, nodes: DataFrame, options: TreeOptions, id_col: str) -> DataFrame:
    """(id, cluster, part): the clusters of members, each split by one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        parts = split_in_memory(matrix(table["v"]), table["tokens"].to_numpy(), options)
        at = pa.array(np.concatenate(parts))
        return pa.table({id_col: table[id_col].combine_chunks().take(at), "cluster": table["cluster"].combine_chunks().take(at), "part": pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int32))})

    kind = nodes.schema[id_col].dataType.simpleString()
    rows = members.join(nodes.select(id_col, F.col("v").cast("array<double>").alias("v"), F.col("tokens").cast("long").alias("tokens")), id_col)
    return rows.groupBy("cluster").applyInArrow(run, f"`{id_col}` {kind}, cluster int, part int")


def cluster_level(nodes: DataFrame, options: TreeOptions, id_col: str = "node_id") -> DataFrame:
    """(id, cluster) for a level; clusters of too many tokens are clustered again while they are large enough to split.

    nodes: id, v, tokens. The level, and each cluster of more than LOCAL_CELLS numbers, is split over all tasks, in jobs of
    its own; the oversize clusters below that, whose number grows with the level, are split in one job, each by one task.
    """
    n = nodes.limit(4).count()
    if n <= 3:
        return nodes.select(id_col, F.lit(0).alias("cluster"))
    scored, _, _ = mixture(reduce_vectors(nodes, options.components), options)
    found = cut(memberships(scored, options, id_col))
    sizes = found.join(nodes.select(id_col, "tokens"), id_col).groupBy("cluster").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    large = {r["cluster"]: r["n"] for r in sizes if r["t"] > options.max_cluster_tokens and r["n"] >= 2 * options.min_cluster and len(sizes) > 1}
    if not large:
        return found
    out = found.where(~F.col("cluster").isin(list(large)))
    last = 1 + max(r["cluster"] for r in sizes)
    most = LOCAL_CELLS // max(1, nodes.select(F.size("v")).first()[0]) if "v" in nodes.columns else 0
    for c in (c for c, n in large.items() if n > most):
        inner = cut(cluster_level(nodes.join(found.where(F.col("cluster") == c).select(id_col), id_col, "left_semi"), options, id_col))
        out = out.unionByName(inner.withColumn("cluster", F.lit(last) + F.col("cluster")))
        last += 1 + inner.agg(F.max("cluster")).first()[0]
    small = sorted(c for c, n in large.items() if n <= most)
    if small:
        parts = split_each(found.where(F.col("cluster").isin(small)), nodes, options, id_col)
        place = F.array_position(F.array(*map(F.lit, small)), F.col("cluster")).cast("int") - 1
        out = out.unionByName(cut(parts.select(id_col, (F.lit(last) + F.col("part") * len(small) + place).alias("cluster"))))
    return out


def roll_up(members: DataFrame, nodes: DataFrame, summarise: Column | None = None, id_col: str = "node_id") -> DataFrame:
    """A row for each cluster: ordered child ids, sorted different documents, pages and types, tokens, one type or `mixed`, text.

    nodes: id, text, tokens, v, and where known source_docs, source_pages, chunk_type. summarise is an aggregate over text (default: the children's first sentences, in order).
    """
    rows = members.join(nodes, id_col)
    docs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_docs")))) if "source_docs" in nodes.columns else F.array().cast("array<string>")
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_pages")))) if "source_pages" in nodes.columns else F.array().cast("array<int>")
    kinds = F.array_sort(F.collect_set("chunk_type")) if "chunk_type" in nodes.columns else F.array().cast("array<string>")
    sentence = F.regexp_extract("text", r"(?s)^\s*(.{1,200}?[.!?]|.{1,200})(?:\s|$)", 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(id_col, sentence.alias("s")))), lambda x: x["s"]), " ") if summarise is None else summarise
    out = rows.groupBy("cluster").agg(F.array_sort(F.collect_set(id_col)).alias("child_node_ids"), docs.alias("source_docs"), pages.alias("source_pages"), kinds.alias("child_chunk_types"), F.sum("tokens").cast("long").alias("children_token_estimate"), F.substring(text, 1, 6000).alias("text"))
    return out.withColumn("chunk_type", F.when(F.size("child_chunk_types") == 1, F.col("child_chunk_types")[0]).otherwise("mixed"))


def mean_vectors(members: DataFrame, nodes: DataFrame, id_col: str = "node_id") -> DataFrame:
    """(cluster, v): the normalised mean of the children's vectors: the offline embedding of a summary."""
    each = members.join(nodes.select(id_col, "v"), id_col).select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    v = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0e0), lambda s, x: s + x * x))
    return v.select("cluster", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("v"))


def build_tree(leaves: DataFrame, options: TreeOptions | None = None) -> DataFrame:
    """All nodes (node_id, depth, text, tokens, child_node_ids, v, is_leaf, layer): leaves, a level of summaries after another, one root.

    Fewer than three nodes end in a root; after max_depth levels a root is forced. Each level is one plan, persisted.
    leaves: node_id string, text, v.
    """
    options = options or TreeOptions()
    level = cut(leaves.select("node_id", "text", F.col("v").cast("array<double>").alias("v"), estimate_tokens(F.col("text")).alias("tokens")))
    every = level.withColumns({"depth": F.lit(0), "child_node_ids": F.array().cast("array<string>"), "is_leaf": F.lit(True)})
    for depth in range(1, options.max_depth + 2):
        n = level.limit(3).count()
        if n <= 1:
            break
        forced = depth > options.max_depth or n < 3
        members = level.select("node_id", F.lit(0).alias("cluster")) if forced else cluster_level(level, options)
        up = roll_up(members, level).join(mean_vectors(members, level), "cluster")
        key = F.concat(F.lit("node_"), F.substring(F.sha1(F.concat_ws("|", F.lit(str(depth)), F.col("cluster").cast("string"), F.array_join("child_node_ids", ","))), 1, 16))
        up = up.select(key.alias("node_id"), "text", "v", estimate_tokens(F.col("text")).alias("tokens"), "child_node_ids")
        up = cut(up)
        every = every.unionByName(up.withColumns({"depth": F.lit(depth), "is_leaf": F.lit(False)}))
        level = up.drop("child_node_ids")
        if forced:
            break
    return every.withColumn("layer", F.when(F.col("is_leaf"), "leaf").otherwise("summary"))


def edges(nodes: DataFrame) -> DataFrame:
    """(parent, child)."""
    return nodes.select(F.col("node_id").alias("parent"), F.explode("child_node_ids").alias("child"))


def expand_ancestors(hits: DataFrame, links: DataFrame, hops: int = 2, decay: float = 0.92, extras: int = 12) -> DataFrame:
    """hits (query_id, node_id, score) and the ancestors within some hops, score times decay^hop, not those already there; at most `extras` for each question."""
    level, found = hits.select("query_id", "node_id", "score"), None
    for hop in range(1, hops + 1):
        level = level.join(links, F.col("node_id") == F.col("child")).groupBy("query_id", F.col("parent").alias("node_id")).agg(F.max("score").alias("score"))
        now = level.select("query_id", "node_id", (F.col("score") * F.lit(decay**hop)).alias("score"), F.lit(hop).alias("hop"))
        found = now if found is None else found.unionByName(now)
    new = found.groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.min("hop").alias("hop")).join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    new = new.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", F.desc("score"), "node_id"))).where(F.col("r") <= extras).drop("r")
    return hits.select("query_id", "node_id", "score", F.lit(0).alias("hop")).unionByName(new)


def nearest_parent(nodes: DataFrame) -> DataFrame:
    """(node_id, parent): the parent of least depth, NO_PARENT for none."""
    up = edges(nodes).join(nodes.select(F.col("node_id").alias("parent"), "depth"), "parent").groupBy("child").agg(F.min_by("parent", F.struct("depth", "parent")).alias("parent"))
    return nodes.select("node_id").join(up.withColumnRenamed("child", "node_id"), "node_id", "left").select("node_id", F.coalesce("parent", F.lit("NO_PARENT")).alias("parent"))


def inspect(nodes: DataFrame) -> DataFrame:
    """(depth, nodes, children, matched): nodes and children of each depth, and the share of nodes that have a parent."""
    up = nearest_parent(nodes)
    rows = nodes.select("node_id", "depth", F.size("child_node_ids").cast("long").alias("children")).join(up, "node_id")
    return rows.groupBy("depth").agg(F.count("*").alias("nodes"), F.sum("children").alias("children"), F.avg((F.col("parent") != "NO_PARENT").cast("double")).alias("matched"))


def parent_chains(links: DataFrame, start: DataFrame, depth: int = 10) -> DataFrame:
    """(node_id, path): every path to a root from the start nodes, without going in circles."""
    return links.sparkSession.sql(f"""
        WITH RECURSIVE walk(node_id, at, path, n) AS (
          SELECT node_id, node_id, array(node_id), 0 FROM {{start}}
          UNION ALL SELECT w.node_id, l.parent, concat(w.path, array(l.parent)), n + 1 FROM walk w JOIN {{links}} l ON l.child = w.at WHERE NOT array_contains(w.path, l.parent) AND n < {depth})
        SELECT node_id, path FROM walk LEFT ANTI JOIN {{links}} up ON up.child = walk.at""", links=links, start=start)
