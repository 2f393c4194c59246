import pytest
from pyspark.sql import functions as F

from gristmill.operators import chunking as C
from gristmill.operators import evaluation as E
from gristmill.operators import graph as G
from gristmill.operators import retrieval as R
from gristmill.operators import tree as T


def test_units_and_packing():
    o = C.ChunkOptions(max_chars=90, overlap_words=8, min_chars=0)
    text = " ".join(f"word{i}" for i in range(80))
    parts = C.units(text, o.max_chars)
    chunks = C.pack_units(parts, o)
    assert len(chunks) > 1 and max(map(len, chunks)) <= 90
    assert set(" ".join(chunks).split()) == set(text.split())
    assert C.split_long("One is here. Two is there.", 15) == ["One is here.", "Two is there."]
    assert C.split_long("x" * 25 + " y", 10) == ["x" * 10, "x" * 10, "x" * 5, "y"]
    assert C.units("- a\n- b\n\npara", 50) == ["- a", "- b", "para"]
    assert C.merge_short(["a", "b", "c" * 200], 150) == ["a\n\nb", "c" * 200]


def test_heading_starts_a_section(spark):
    lines = spark.createDataFrame([("d", 1, 0, "1. Dose"), ("d", 1, 1, "Give it once."), ("d", 1, 2, "1.1 Children"), ("d", 1, 3, "Half of it."), ("d", 1, 4, "2. Empty"), ("d", 1, 5, "3. End"), ("d", 1, 6, "Stop.")], "doc string, page int, line_index int, line string")
    found = {tuple(r.headings): r.body for r in C.sections(lines, ["doc", "page"]).collect()}
    assert found == {("1. Dose",): "Give it once.", ("1. Dose", "1.1 Children"): "Half of it.", ("3. End",): "Stop."}
    chunks = C.chunk_sections(C.sections(lines, ["doc", "page"]), ["doc", "page"], C.ChunkOptions(min_chars=0)).orderBy("chunk_index").collect()
    assert [c.content for c in chunks] == ["1. Dose\n\nGive it once.", "1. Dose > 1.1 Children\n\nHalf of it.", "3. End\n\nStop."]


def test_page_text_and_signature(spark):
    blocks = spark.createDataFrame([(1, 0, 0.0, 10.0, "a"), (1, 1, 12.0, 20.0, "b"), (1, 2, 40.0, 50.0, "c")], "page int, block_index int, y0 double, y1 double, text string")
    assert C.page_text(blocks, ["page"]).first().text == "a\nb\n\nc"
    chunks = spark.createDataFrame([(1, 0, "Été"), (1, 1, "ete "), (1, 2, " ")], "page int, seq int, content string")
    assert [r.seq for r in C.distinct_by_signature(chunks, F.col("content"), ["page"], "seq").collect()] == [0]


def test_fusion_prefers_the_shared_hit(spark):
    rows = [(0, n, c, "original", i + 1, 1.0, w) for c, w, ns in (("dense", 5.0, ["d", "s"]), ("bm25", 2.0, ["s", "b"]), ("colbert", 3.0, ["s", "c"])) for i, n in enumerate(ns)]
    hits = spark.createDataFrame([*rows, (0, "", "bm25", "original", 1, 1.0, 2.0)], "query_id int, node_id string, channel string, variant string, rank int, score double, weight double")
    best = R.fuse(hits, 10).orderBy(F.desc("score"), "node_id").collect()
    assert best[0].node_id == "s" and set(best[0].matches) == {"dense:original", "bm25:original", "colbert:original"} and len(best) == 4
    assert best[0].score == pytest.approx(5 / 12 + 2 / 11 + 3 / 11)


def test_variants(spark):
    b = spark.createDataFrame([(1, "Q one", "a long answer", ["Q  ONE", "other"], ["part"], "wide"), (2, "q", None, None, None, None)], "query_id int, original string, hyde_document string, multi_queries array<string>, sub_questions array<string>, step_back_query string")
    lexical, dense = R.variants(b)
    names = lambda df, q: [(r.name, r.weight) for r in df.where(F.col("query_id") == q).orderBy("pos").collect()]
    assert names(lexical, 1) == [("original", 1.0), ("multi_2", 0.85), ("sub_1", 0.9), ("step_back", 0.65)]
    assert names(dense, 1)[0] == ("hyde", 1.1) and names(lexical, 2) == names(dense, 2) == [("original", 1.0)]
    got = b.select(R.clean_list(F.array(F.lit("Q ONE"), F.lit("b"), F.lit("B"), F.lit("c"), F.lit("d")), F.col("original"), 2).alias("x")).first().x
    assert got == ["b", "c"]


def test_weights_rerank_budget(spark):
    w = lambda *a: spark.range(1).select(R.modality_weight(*map(F.lit, a)).alias("w")).first().w
    assert w("so do gan", "visual", 0, "leaf") == 1.0 and w("gan", "visual", 0, "leaf") == 0.35 and w("nhanh", "visual", 0, "leaf") == 1.0
    assert w("trieu chung cls", "text", 1, "summary") == pytest.approx(1.8 * 1.12 * 1.08)
    hits = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 2, 95), (1, "c", 3, 20), (1, "d", 4, 70)], "query_id int, node_id string, rank int, tokens int")
    assert {r.node_id for r in R.pack_budget(hits, 100).collect()} == {"a", "c", "d"} and {r.node_id for r in R.pack_budget(hits, 5).collect()} == {"a"}
    head = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.5)], "query_id int, node_id string, rerank_score double")
    assert [r.node_id for r in R.rerank(hits, head).orderBy("rank").collect()] == ["c", "b", "a", "d"]


def test_entities_and_relations(spark):
    m = spark.createDataFrame([("k", "A", "TEST", 1, "c1"), ("k", "a", "DRUG", 2, "c1"), ("k", "a", "DRUG", 3, "c2")], "key string, name string, type string, seq int, chunk_id string")
    r = G.accumulate_entities(m).first()
    assert (r.name, r.type, r.mention_count, r.aliases) == ("A", "DRUG", 2, ["A", "a"])
    raw = spark.createDataFrame([("A", "a", "x", ""), ("A", "B", "is part-of", "d"), ("", "B", "x", "")], "source string, target string, type string, description string")
    assert [(x.source, x.target, x.type) for x in G.clean_relations(raw).collect()] == [("A", "B", "IS_PART_OF")]
    rel = spark.createDataFrame([("A", "B", "R", "c1"), ("A", "B", "R", "c2"), ("A", "B", "R", "c2")], "source string, target string, type string, chunk_id string")
    assert tuple(G.accumulate_relations(rel).first())[3:] == (3, 2)
    ends = G.add_endpoints(spark.createDataFrame([("A", "A", "DRUG")], "key string, name string, type string"), rel)
    assert {(x.key, x.type) for x in ends.collect()} == {("A", "DRUG"), ("B", "OTHER")}


def test_communities(spark):
    cliques = [(a, b, 1.0) for g in ("abcd", "efgh") for a in g for b in g if a < b] + [("d", "e", 0.1), ("x", "y", 5.0)]
    edges = spark.createDataFrame(cliques, "source string, target string, weight double")
    vertices = spark.createDataFrame([(v,) for v in "abcdefghxyz"], "key string")
    found = {r.key: (r.component, r.community) for r in G.communities(vertices, edges).collect()}
    assert len(found) == 11 and found["z"] == ("z", "z") and found["x"][1] == found["y"][1]
    assert {found[k][0] for k in "abcdefgh"} == {"a"} and {found[k][1] for k in "abcd"} == {"a"} and {found[k][1] for k in "efgh"} == {"e"}


def test_expansion_grows_over_heavy_edges(spark):
    seeds = spark.createDataFrame([(0, "a", 1.0)], "query_id int, key string, score double")
    rel = spark.createDataFrame([("a", "b", 1), ("b", "c", 10), ("c", "d", 1)], "source string, target string, weight int")
    got = {r.key: (round(r.score, 4), r.hop) for r in G.expand(seeds, rel).collect()}
    assert got == {"a": (1.0, 0), "b": (0.77, 1), "c": (round(0.77 * 1.4, 4), 2)}


def test_tree_has_one_root_over_all_leaves(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(f"l{i:02d}", f"Text {i}. More.", [math.cos(i // 8) + rng.random() / 10, math.sin(i // 8) + rng.random() / 10, rng.random() / 10]) for i in range(24)]
    nodes = T.build_tree(spark.createDataFrame(rows, "node_id string, text string, v array<double>"), T.TreeOptions(max_depth=2, components=2, max_k=3)).persist()
    children = {r.node_id: r.child_node_ids for r in nodes.collect()}
    below = {c for cs in children.values() for c in cs}
    roots = [n for n in children if n not in below]
    assert len(roots) == 1

    def leaves(n):
        return {n} if not children[n] else set().union(*map(leaves, children[n]))

    assert len(leaves(roots[0])) == 24
    assert T.nearest_parent(nodes).where("parent = 'NO_PARENT'").count() == 1
    assert T.parent_chains(T.edges(nodes), nodes.where("is_leaf").select("node_id")).count() == 24


@pytest.mark.parametrize("n, total", [(1, 1), (2, 3)])
def test_small_trees(spark, n, total):
    rows = [(f"l{i}", "t.", [1.0, float(i)]) for i in range(n)]
    assert T.build_tree(spark.createDataFrame(rows, "node_id string, text string, v array<double>")).count() == total


def test_evaluation(spark):
    pages = spark.createDataFrame([("d", i) for i in range(12)], "doc string, page int")
    assert [r.pages for r in E.overview_windows(pages, "doc", "page", 4, 3).orderBy("start").collect()] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9], [9, 10, 11]]
    with pytest.raises(ValueError):
        E.overview_windows(pages, "doc", "page", 2, 3)
    rows = spark.createDataFrame([("multi_hop", [1], ["text"]), ("overview", [1, 2, 3, 4], ["text"]), ("table_visual", [4], ["table"])], "category string, source_pages array<int>, source_types array<string>")
    assert {r.category: r.valid for r in E.violations(rows, {"multi_hop": 1, "overview": 1, "table_visual": 1}).collect()} == {"multi_hop": False, "overview": True, "table_visual": True}
    ctx = spark.createDataFrame([('["a", "b"]',), ("plain",), ("[bad",), (None,)], "x string").select(E.as_contexts(F.col("x")).alias("y"))
    assert [r.y for r in ctx.collect()] == [["a", "b"], ["plain"], ["[bad"], []]
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, node_id string, rank int")
    assert tuple(E.rank_metrics(hits, spark.createDataFrame([(1, "b"), (1, "c")], "query_id int, node_id string"), 2).first())[1:] == (0.5, 0.5, 0.5)


def test_dense_ranks_rounded_scores(spark):
    rows = spark.createDataFrame([(1, [0.100001]), (2, [0.100004]), (3, [0.1]), (4, [-0.100006])], "vec_id long, v array<double>")
    asked = spark.createDataFrame([(0, [1.0])], "query_id long, q array<double>")
    best = {r["vec_id"]: (r["rank"], r["score"]) for r in R.dense(rows, asked, 2, "vec_id", digits=5).collect()}
    assert best == {1: (1, 0.1), 2: (2, 0.1)}
    last = {r["vec_id"]: (r["rank"], r["score"]) for r in R.dense(rows, asked, 4, "vec_id", digits=5).collect()}
    assert last == {1: (1, 0.1), 2: (2, 0.1), 3: (3, 0.1), 4: (4, -0.10001)}


def test_sparse_vectors_have_an_entry_for_each_term(spark):
    """160,000 different terms: some share an index below 2^30."""
    from gristmill.operators import search as S

    docs = spark.createDataFrame([(1, [f"t{i}" for i in range(160_000)]), (2, ["t1", "t1"])], "node_id long, terms array<string>")
    sizes = lambda **k: {r[0]: r[1] for r in S.sparse_vectors(docs, F.col("terms"), **k).select("node_id", F.size("indices")).collect()}
    assert sizes() == {1: 160_000, 2: 1}
    assert sizes(size=1 << 30)[1] < 160_000


def test_nearest_blocks_by_strips(spark):
    """Against all pairs, with ties, equal boxes, far blocks, a wide one and unknown places."""
    import numpy as np

    rng = np.random.default_rng(7)
    for n, m, span in ((3, 5, 4), (400, 150, 60), (900, 200, 5000), (500, 100, 8)):
        make = lambda c: (lambda p: np.hstack([p, p + rng.integers(0, 6, (c, 2))]))(rng.integers(0, span, (c, 2)).astype(float))  # noqa: E731, B023
        blocks, regions, index = make(n), make(m), rng.permutation(n)
        blocks[0] = [-10, 2, 10 * span, 3]
        blocks[1, 0], regions[2, 1] = np.nan, np.nan
        got = C.nearest(regions, blocks, index, 4)
        for i, (x0, y0, x1, y1) in enumerate(regions):
            d = [0 if x0 < b[2] and x1 > b[0] and y0 < b[3] and y1 > b[1] else abs(y0 - b[1]) + abs(x0 - b[0]) for b in blocks]
            want = sorted(range(n), key=lambda j: (np.inf if np.isnan(d[j]) else d[j], index[j]))[:4]
            assert got[i].tolist() == want
