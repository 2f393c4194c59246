"""Queries and operators over all of their rows, against brute force on small fixtures."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gristmill.functions.text import tokens
from gristmill.operators import evaluation as E
from gristmill.operators import retrieval as R
from gristmill.operators import tree
from gristmill.operators.lineage import numbered_within
from gristmill.plans import catalog


def smallest_of_component(vertices, edges):
    """(key, smallest key of its component), by union-find."""
    up = {v: v for v in vertices}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {(v, top(v)) for v in vertices}


def test_every_order_links_its_customers(spark, tmp_path):
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    orders = [(i, k, kinds[i % 5]) for i, k in enumerate([*range(1, 401), *range(500, 530), 701, 701])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in [*range(1, 401), 900]], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    edges = {(k, k + 1 + k % 5) for _, k, _ in orders}
    expected = smallest_of_component({900, *range(1, 401), *(x for e in edges for x in e)}, edges)
    got = [tuple(r) for r in catalog.queries()["connected_components"](spark, str(tmp_path)).select("key", "component").collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_nested_oversize_splits_stay_apart(spark, monkeypatch):
    """A level of 2 x 2 x 2 groups: both halves are oversize and so are both quarters of each."""

    def by_next_letter(rows, options):
        ids = [r["node_id"] for r in rows.collect()]
        at = next(i for i in range(3) if len({x[i] for x in ids}) > 1)
        one = F.substring("node_id", at + 1, 1) == "1"
        return rows.withColumn("probability", array_to_vector(F.when(one, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))), 2, {}

    monkeypatch.setattr(tree, "reduce_vectors", lambda nodes, components: nodes)
    monkeypatch.setattr(tree, "mixture", by_next_letter)
    nodes = spark.createDataFrame([(f"{g:03b}{i}", 1) for g in range(8) for i in range(3)], "node_id string, tokens int")
    found = defaultdict(set)
    for r in tree.cluster_level(nodes, tree.TreeOptions(max_cluster_tokens=3)).collect():
        found[r["cluster"]].add(r["node_id"])
    assert sorted(map(sorted, found.values())) == [[f"{g:03b}{i}" for i in range(3)] for g in range(8)]


def test_oversize_clusters_are_split_in_one_job(spark, monkeypatch):
    """Six halves of far groups are oversize: the level is fitted over all tasks once, and no cluster by a fit of its own."""
    fits, fit = [], tree.mixture
    monkeypatch.setattr(tree, "mixture", lambda rows, options: fits.append(1) or fit(rows, options))
    g = np.random.default_rng(3)
    groups = [(a, b) for a in range(6) for b in range(6)]
    v = np.concatenate([np.array([a * 100.0, (a * a % 7) * 50.0, b * 2.0, (b * b % 5) * 1.0]) + g.normal(0, 0.05, (20, 4)) for a, b in groups])
    nodes = spark.createDataFrame([(f"n{i:04}", x.tolist(), 10) for i, x in enumerate(v)], "node_id string, v array<double>, tokens int")
    found = tree.cluster_level(nodes, tree.TreeOptions(max_cluster_tokens=400)).collect()
    assert sorted(r["node_id"] for r in found) == [f"n{i:04}" for i in range(len(v))]
    sizes = Counter(r["cluster"] for r in found)
    assert len(fits) == 1 and max(sizes.values()) <= 40 and len(sizes) <= 60
    monkeypatch.setattr(tree, "LOCAL_CELLS", 0)  # larger ones go over all tasks
    assert sorted(r["node_id"] for r in tree.cluster_level(nodes.limit(240), tree.TreeOptions(max_cluster_tokens=1000, max_k=2)).collect()) == sorted(r["node_id"] for r in nodes.limit(240).collect())


def test_every_token_of_a_question_counts(spark, tmp_path):
    questions = [(0, "Is it  an\tox or an elephant"), (1, "go to it"), (2, "elephant elephant ox")]
    docs = [(0, "an ox, is it"), (1, "The ELEPHANT"), (2, "none"), (3, "GO"), (4, "or an elephant"), (5, None)]
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for q, text in questions:
        scores = [(-sum(t in (d or "").lower() for t in text.lower().split()), i) for i, d in docs]
        expected |= {(q, i, -s, n) for n, (s, i) in enumerate(sorted(x for x in scores if x[0])[:5], 1)}
    got = catalog.queries()["keyword_overlap_search"](spark, str(tmp_path)).select("item_id", "doc_id", "score", "rank").collect()
    assert {tuple(r) for r in got} == expected and (1, 3, 1, 2) in expected


def test_every_part_is_in_a_table_of_each_size(spark, tmp_path):
    parts = [(i, "b" if i % 3 else "a", "lower words" if i > 40 else "Some Name", "TYPE OF PART", i) for i in range(64)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["looks_like_table"](spark, str(tmp_path)).collect()
    for brand, n in (("a", 22), ("b", 42)):
        for cut in (1, 5, 9):
            sizes = [r["n_rows"] for r in sorted(got, key=lambda r: r["table_no"]) if (r["p_brand"], r["cut"]) == (brand, cut)]
            assert sizes == [cut] * (n // cut) + [n % cut] * (n % cut > 0)
    verdicts = {r["table_no"]: r["aligned"] for r in got if (r["p_brand"], r["cut"]) == ("b", 9)}
    assert verdicts[0] and not verdicts[4]  # the last rows alone look like prose


def test_batch_questions_by_blocks(spark, monkeypatch):
    """The best of each question by blocks and slices of nodes are those of all pairs; a node without text counts in the statistics, and no pairs leave their block."""
    words = "oak elm ash fir yew box bay fig".split()
    g = np.random.default_rng(5)
    docs = [(i, " ".join(g.choice(words[:7], 1 + i % 9))) for i in range(50)] + [(90, None), (91, "")]
    asked = [(i, " ".join(g.choice(words, 2))) for i in range(9)] + [(20, "fig fig")]
    dl = [len((t or "").split()) for _, t in docs]
    expected = set()
    for q, text in asked:
        scores = []
        for (i, t), n in zip(docs, dl):
            s = 0.0
            for w in set(text.split()) & set((t or "").split()):
                df = sum(w in (x or "").split() for _, x in docs)
                tf = t.split().count(w)
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.7 / (tf + 1.7 * (0.17 + 0.83 * n / (sum(dl) / len(docs))))
            if s:
                scores.append((-round(s, 6), i))
        expected |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:4], 1)}
    nodes, questions = spark.createDataFrame(docs, "node_id long, text string").coalesce(1), spark.createDataFrame(asked, "query_id long, text string")
    find = lambda: {tuple(r) for r in R.bm25_top(nodes, tokens(F.col("text")), questions, 4, question_terms=tokens(F.col("text")), digits=6).withColumn("score", F.round("score", 6)).select("query_id", "node_id", "score", "rank").collect()}
    assert find() == expected
    for name, value in (("NODE_SLICE", 7), ("SCORE_CELLS", 60), ("QUESTION_BLOCK", 4), ("NODE_BLOCK", 16), ("BROADCAST_TOKENS", 2)):
        monkeypatch.setattr(R, name, value)
        assert find() == expected


def test_scores_in_memory_are_bounded(spark, monkeypatch):
    """A block of nodes is scored in slices: a task never holds more scores than SCORE_CELLS."""
    monkeypatch.setattr(R, "SCORE_CELLS", 400)
    vectors = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(300)], "node_id long, v array<double>").coalesce(1)
    questions = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "query_id long, q array<double>")

    def score(asked, table):
        out = R.matrix(asked["q"]) @ R.matrix(table["v"]).T
        if out.size > 400:
            raise ValueError("too many scores")
        return out, table["node_id"].combine_chunks()

    got = {tuple(r) for r in R.by_blocks(vectors, questions, "node_id", score, 3).select("query_id", "node_id", "rank").collect()}
    assert got == {(q, i, n) for q in range(20) for n, (_, i) in enumerate(sorted((-(i % 17 + q * (i % 5)), i) for i in range(300))[:3], 1)}


def test_summaries_are_made_without_a_shuffle(spark, monkeypatch):
    texts = [(1, "Oak elm. Oak oak ash! Of it. Elm?\nOak fir yew elm. Ash ash."), (2, None), (3, ""), (4, "Of it. No."), (5, "One two three. \n Two "), (None, "Oak elm.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    expected = [(1, "Oak elm. Oak oak ash! Oak fir yew elm. Ash ash."), (5, "One two three. Two")]
    for size in (256, 2):
        monkeypatch.setattr(E, "SUMMARY_SLICE", size)
        made = E.extractive_summary(docs)
        assert sorted(tuple(r) for r in made.collect()) == expected
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_large_value_are_numbered_by_many_tasks(spark, tmp_path):
    rows = [("hot" if i % 10 else None if i % 20 else "cold", (i * 37) % 1000) for i in range(1000)]
    spark.createDataFrame(rows, "b string, k long").write.parquet(f"{tmp_path}/rows")
    made = numbered_within(spark.read.parquet(f"{tmp_path}/rows"), "b", "k", "at")
    got = {tuple(r) for r in made.collect()}
    groups = defaultdict(list)
    for b, k in rows:
        groups[b].append(k)
    assert got == {(b, k, n) for b, ks in groups.items() for n, k in enumerate(sorted(ks), 1)}
    assert "specifiedwindowframe" in made._jdf.queryExecution().executedPlan().toString() and "windowspecdefinition(b#" not in made._jdf.queryExecution().executedPlan().toString()
