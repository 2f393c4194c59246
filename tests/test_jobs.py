"""Jobs over generators, the graph end to end, and searches where SQL says too little: failures, caches, blocks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill import cli
from gristmill.operators import documents as D
from gristmill.operators import index as I
from gristmill.operators import jobs as J
from gristmill.operators import knowledge as K
from gristmill.operators import lineage
from gristmill.operators import providers as P
from gristmill.operators import retrieval as R
from gristmill.operators import search as S
from gristmill.sources import store


class Fails:
    def generate(self, prompt, max_tokens):
        raise RuntimeError("down")


class Says:
    def __init__(self, answer):
        self.answer = answer

    def generate(self, prompt, max_tokens):
        return self.answer


CHUNK = "doc_name string, page_number int, chunk_type string, chunk_index int, headings array<string>, content string"


def test_contexts_must_be_whole():
    assert J.shaped_contexts('x {"contexts": [{"id": "2", "context": "b"}, {"id": 1, "context": " a  c "}]}', 2) == ["a c", "b"]
    for bad in ("none", '{"contexts": [{"id": 1, "context": "a"}]}', '[{"id": 1, "context": "a"}, {"id": 2, "context": " "}]'):
        with pytest.raises(ValueError):
            J.shaped_contexts(bad, 2)


def test_enrichment_without_answers_falls_back(spark):
    rows = [("D", 1, "text", i, ["H"] if i else [], f"content {i}") for i in range(3)]
    chunks = spark.createDataFrame(rows, CHUNK)
    none = spark.createDataFrame([], "key string, context string")
    for ask in (None, J.ask_contexts(Fails())):
        done, new = J.enrich(chunks, none, ask, 2)
        got = {r.chunk_index: (r.origin, r.content) for r in done.collect()}
        assert new.count() == 0 and got[0] == ("fallback", "[From document D, page 1.]\ncontent 0") and got[2][1].startswith("[From document D, page 1, section H.]")
    ask = J.ask_contexts(Fails())
    with pytest.raises(RuntimeError, match="down"):
        ask(chunks.toPandas().assign(key="k"))
    with pytest.raises(RuntimeError, match="given up"):
        ask(chunks.toPandas().assign(key="k"))


def test_optimiser_fails_open_or_not(spark):
    asked = spark.createDataFrame([(1, " a  question ")], "query_id int, text string")
    for generator in (None, Fails(), Says("no json"), Says("[1]")):
        row = J.optimise(asked, generator).first()
        assert (row.original, row.hyde_document, row.multi_queries, row.step_back_query) == ("a question", None, [], None)
    with pytest.raises(Exception, match="down"):
        J.optimise(asked, Fails(), strict=True).collect()


def test_layers_and_messages(spark):
    cached = spark.createDataFrame([(["b", "a"], "t"), (["c"], " ")], "child_node_ids array<string>, text string")
    clusters = lambda *x: spark.createDataFrame([(list(c),) for c in x], "child_node_ids array<string>")
    assert J.reusable_layer(cached, clusters("ab")) and not J.reusable_layer(cached, clusters("ab", "c"))
    assert J.message_text([{"text": "a"}, {"content": ["b", None]}]) == "ab" and J.message_text(None) == ""


def test_batches_without_a_budget_use_all_tasks(spark):
    rows = spark.range(100).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("k"))
    ask = lambda part: part.assign(n=len(part))
    assert P.batched(rows, ["k"], 10, ask, "k string, n long", ["k"], None).count() == 100
    assert P.batched(rows, ["k"], 10, ask, "k string, n long", ["k"], 3).count() == 30


def test_graph_from_extractions_to_search(spark):
    entity = lambda n, t, d="": {"name": n, "type": t, "description": d}
    link = {"source": "Ácid", "target": "Pain", "type": "helps", "description": "soothes"}
    rows = [("c1", "D", 10, "text", "one", [entity("Acid", "DRUG", "x"), entity("Acid", "TEST")], [link]), ("c2", "D", 11, "text", "two", [entity("acid", "DRUG")], [link, {**link, "target": " "}])]
    found = spark.createDataFrame(rows, f"chunk_id string, doc_name string, page_number int, chunk_type string, content string, entities {K.ENTITIES}, relations {K.RELATIONS}")
    graph = K.build_graph(found)
    got = {r.name: r for r in graph["entities"].collect()}
    assert set(got) == {"Acid", "Pain"} and got["Acid"].type == "DRUG" and got["Acid"].mention_count == 2 and [e.page_number for e in got["Acid"].evidence] == [10, 11]
    assert got["Pain"].type == "OTHER" and [e.chunk_id for e in got["Pain"].evidence] == ["c1"] and got["Acid"].community_id == got["Pain"].community_id
    (relation,) = graph["relations"].collect()
    assert (relation.type, relation.weight, relation.evidence_count, relation.description) == ("HELPS", 2, 2, "soothes")
    groups = graph["entities"].groupBy(F.col("community_id").alias("community")).agg(F.lit("t").alias("title"), F.lit("s").alias("summary"), F.collect_list("key").alias("entity_ids"))
    docs = lineage.cut(K.graph_to_documents(graph["entities"], graph["relations"], groups))
    kinds = {r.graph_kind: r for r in docs.collect()}
    assert set(kinds) == {"entity", "relation", "community"} and kinds["relation"].source_pages == [10, 11]
    key = got["Acid"].key
    hits = spark.createDataFrame([(0, key, 1.0, 1)], "query_id int, node_id string, score double, rank int")
    out = [(r.node_id, r.hop) for r in K.graph_search(hits, docs, graph["relations"]).orderBy("rank").collect()]
    assert out == [(key, None), (got["Pain"].key, 1)]
    assert K.build_graph(found.limit(0))["entities"].count() == 0


def test_extraction_asks_again_then_leaves_the_batch(spark):
    answers = ["rubbish", json.dumps({"chunks": [{"chunk_id": "a", "entities": [{"name": "N"}, 5]}, {"chunk_id": "zz"}]})]
    ask = K.extractor(type("G", (), {"generate": lambda self, p, n: answers.pop(0)})())
    part = spark.createDataFrame([("a", "t"), ("b", "u")], "chunk_id string, content string").toPandas()
    assert [json.loads(r)["entities"] for r in ask(part)["reply"]] == [[{"name": "N", "type": "", "description": ""}], []]
    chunks = spark.createDataFrame([("a", "t")], "chunk_id string, content string")
    done, new = K.extract(chunks, spark.createDataFrame([], "chunk_id string, reply string"), K.extractor(Says("no")))
    assert new.count() == 0 and done.first().entities == []


def test_search_by_blocks_of_questions(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(200)]
    nodes = spark.createDataFrame([*v, (None, v[0][1]), (900, None)], "node_id long, v array<double>")
    asked = nodes.where("node_id < 30").select(F.col("node_id").alias("query_id"), F.col("v").alias("q"))
    want = []
    for q, a in v[:30]:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in v)[:5]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    matrices = [(i, [b, [x + 1 for x in b]]) for i, b in v]
    tokens = spark.createDataFrame(matrices, "node_id long, tokens array<array<double>>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    late = []
    for q, m in matrices[:9]:
        best = sorted((-sum(max(dot(a, b) for b in n) for a in m), i) for i, n in matrices)[:5]
        late += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    docs = spark.createDataFrame([(i, f"the {'ox ' * (i % 3)} cat{i}") for i in range(20)], "doc_id long, text string")
    words = spark.createDataFrame([(i, ["ox", "ox", f"t{i}"]) for i in range(12)], "query_id long, ts array<string>")
    for block in (2000, 4):
        monkeypatch.setattr(R, "QUESTION_BLOCK", block)
        monkeypatch.setattr(R, "NODE_BLOCK", 50)
        assert sorted(tuple(r) for r in R.dense(nodes, asked, 5).collect()) == sorted((q, i, s, n) for q, i, s, n in want)
        got = R.max_sim_top(tokens, tokens.where("node_id < 9").select(F.col("node_id").alias("query_id"), F.col("tokens").alias("q")), 5)
        assert sorted(tuple(r) for r in got.collect()) == sorted(late)
        best = R.keyword_search(docs, words, 2).where("query_id = 0").orderBy("rank").collect()
        assert [(r.doc_id, r.score) for r in best] == [(1, 2), (2, 2)]


def test_ensemble_of_an_empty_question_is_an_error(spark):
    bundle = spark.createDataFrame([(1, "  ", None, None, None, None)], "query_id long, original string, hyde_document string, multi_queries array<string>, sub_questions array<string>, step_back_query string")
    nodes = spark.createDataFrame([(1, "a")], "node_id long, text string")
    with pytest.raises(Exception, match="empty"):
        S.ensemble_search(bundle, nodes, {"bm25": lambda asked, k: R.ranked(R.bm25(nodes, F.split("text", " "), asked, "node_id", F.split("text", " ")), k, ["query_id"])}).collect()
    with pytest.raises(ValueError):
        S.SearchOptions(final=0)


def test_index_of_no_nodes_and_no_index(spark, tmp_path):
    with pytest.raises(ValueError):
        I.build_index(spark.createDataFrame([], "node_id long, text string"), F.split("text", " "), str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        I.Index(spark, str(tmp_path / "none"))


def test_numbers_over_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    assert {(r.x, r.n) for r in lineage.numbered(rows, ["x"]).collect()} == {(i, i + 1) for i in range(500)}
    assert lineage.numbered(rows.limit(0), ["x"]).count() == 0


def test_table_keeps_the_last_put_over_many_puts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store.Table, "MOST", 3)
    t = store.Table(spark, str(tmp_path / "t"), "k", "k long, v string, m map<string,string>")
    for i in range(6):
        t.put(spark.createDataFrame([(0, f"v{i}", None), (i, f"own{i}", {"a": "b"})][i == 0 :], "k long, v string, m map<string,string>"))
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {0: "v5", **{i: f"own{i}" for i in range(1, 6)}} and t.version() == 6
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) <= 2 * 3
    vectors = store.VectorStore(spark, str(tmp_path / "v"), 2)
    assert vectors.ensure() and not vectors.ensure()
    counts = spark.createDataFrame([(f"k{i:04d}", 1) for i in range(1500)], "kind string, n long")
    assert len(json.loads(store.manifest(counts, {}))["counts"]) == 1500


def test_rendered_clips(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0, 0.0, 0.0, 12.0, 100.0)], "id int, x0 double, y0 double, x1 double, y1 double, page_x0 double, page_y0 double, page_x1 double, page_y1 double")
    clipped = D.clip_regions(boxes)
    assert clipped.select("width", "height").first() == (24, 48)
    assert bytes(D.render_clips(clipped.select("id", "width"), lambda r: str(r["width"]).encode(), "id").first().png) == b"24"


def test_command_line(spark, tmp_path):
    nodes = str(tmp_path / "nodes")
    spark.createDataFrame([("a", "alpha beta"), ("b", "beta gamma")], "node_id string, text string").write.parquet(nodes)
    cli.main(["index", nodes, "--index", str(tmp_path / "i"), "--output", str(tmp_path / "o1")])
    cli.main(["search-index", str(tmp_path / "i"), "--question", "alpha", "--output", str(tmp_path / "o2")])
    assert [r.node_id for r in spark.read.parquet(str(tmp_path / "o2")).collect()] == ["a"]
    row = {"chunk_id": "c", "doc_name": "D", "page_number": 1, "chunk_type": "text", "content": "t", "entities": [{"name": "A", "type": "DRUG", "description": ""}], "relations": []}
    (tmp_path / "x.jsonl").write_text(json.dumps(row))
    cli.main(["graph-docs", str(tmp_path / "x.jsonl"), "--output", str(tmp_path / "o3")])
    assert spark.read.parquet(str(tmp_path / "o3")).count() == 1


def test_graph_of_lines_keeps_no_wide_rows(spark, tmp_path, monkeypatch):
    """Rows of mentions and relations are kept as compressed columns: no checkpoint takes a row for each line; the graph stays that of brute force."""
    from gristmill.operators import knowledge as K

    sizes = []
    plain = K.cut
    monkeypatch.setattr(K, "cut", lambda df: (lambda done: (sizes.append(done.count()), done)[1])(plain(df)))
    chunks = [(f"c{i:03d}", f"doc {i % 3}", i % 4, "text", "long " * 200, [(f"E{j % 5}", "DRUG", f"d{j}") for j in range(i % 7)], [(f"E{i % 5}", f"X{i % 2}", "treats", f"r{i % 9}")]) for i in range(200)]
    chunks += [chunks[11], chunks[12]]  # a chunk that comes twice is one chunk
    rows = spark.createDataFrame(chunks, f"chunk_id string, doc_name string, page_number int, chunk_type string, content string, entities {K.ENTITIES}, relations {K.RELATIONS}")
    graph = K.build_graph(rows, communities=False)
    found = {r["name"]: r for r in graph["entities"].collect()}
    for name in [f"E{j}" for j in range(5)]:
        own = sorted({(c[2], c[0]) for c in chunks if name in [e[0] for e in c[5]]})
        assert found[name]["mention_count"] == len(own)
        assert [e["chunk_id"] for e in found[name]["evidence"]] == [k for _, k in own[:5]]
    for name in ("X0", "X1"):
        first = min((c[2], c[0]) for c in chunks if c[6][0][1] == name)
        assert (found[name]["type"], [e["chunk_id"] for e in found[name]["evidence"]]) == ("OTHER", [first[1]])
    assert sum(r["weight"] for r in graph["relations"].collect()) == len(chunks)
    assert sum(r["evidence_count"] for r in graph["relations"].collect()) == 200
    assert max(sizes) <= 20


def test_names_of_a_chunk_resolve_in_one_list(spark):
    from gristmill.operators import knowledge as K

    named = spark.createDataFrame([("a", "Áb", "k2"), ("a", "ab", "k1"), ("b", "c", "k3"), (None, "x", "k4")], "chunk_id string, name string, key string")
    related = spark.createDataFrame([("a", "AB", "zz"), ("b", "ab", "C"), (None, "x", "y"), ("q", "x", "y")], "chunk_id string, source string, target string")
    got = {(r["chunk_id"], r["source"]): r for r in K.resolve_names(named, related).collect()}
    lone = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in ("zz", "ab", "x", "y")], "n string").select("n", K.G.entity_id(K.F.col("n")).alias("k")).collect()}
    assert (got["a", "AB"]["source_key"], got["a", "AB"]["target_key"]) == ("k1", lone["zz"])
    assert (got["b", "ab"]["source_key"], got["b", "ab"]["target_key"]) == (lone["ab"], "k3")
    assert (got[None, "x"]["source_key"], got["q", "x"]["source_key"]) == (lone["x"], lone["x"])


def test_every_chunk_is_extracted(spark, tmp_path):
    """More chunks than two runs with a budget of 40 batches of 20 take."""
    from gristmill.plans import catalog

    rows = [(i // 10, i % 10, "user", f"Word{i} and more") for i in range(2001)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in catalog.queries()["extraction_job"](spark, str(tmp_path)).select("chunk_id", "name").collect()}
    assert got == {(f"{i // 10}-{i % 10}", f"Word{i}") for i in range(2001)}


def test_a_bucket_of_terms_is_one_file(spark, tmp_path):
    """Though each of many tasks has terms of every bucket."""
    from pathlib import Path

    from gristmill.operators import index as I

    nodes = spark.createDataFrame([(i, " ".join(f"w{'abcdefghij'[j % 10]}{'klmnop'[i % 6]}{'qrstu'[j // 10]}" for j in range(50))) for i in range(60)], "node_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert I.build_index(nodes, F.split("text", " "), f"{tmp_path}/i", buckets=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for kind in ("terms", "postings"):
        files = [f.parent.name for f in Path(f"{tmp_path}/i/{kind}").glob("bucket=*/*.parquet")]
        assert sorted(files) == [f"bucket={b}" for b in range(4)]
