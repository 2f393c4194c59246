import json
import uuid

import pytest
from pyspark.sql import functions as F

from gristmill.operators import providers as P
from gristmill.sources import files, store
from gristmill.streaming.ingest import ingest, read_chunks


def test_budget_stops_requests():
    slept = []
    limit = P.RateLimiter(interval=3, budget=2, clock=lambda: 0.0, sleep=slept.append)
    limit.acquire()
    limit.acquire()
    with pytest.raises(P.BudgetExhausted):
        limit.acquire()
    assert slept == [3.0]


def test_client_retries_and_gives_up():
    answers = [(429, {"Retry-After": "0"}, None), (200, {}, "ok")]
    slept = []
    client = P.Client(lambda _: answers.pop(0), P.RateLimiter(0, 10), sleep=slept.append)
    assert client.send({}) == "ok" and slept == [0.0]
    refused = P.Client(lambda _: (401, {}, None), P.RateLimiter(0, 10), sleep=slept.append)
    with pytest.raises(RuntimeError):
        refused.send({})
    assert refused.limiter.used == 1
    assert P.retry_after("Thu, 01 Jan 1970 00:00:10 GMT", 4.0) == 6.0 and P.retry_after("x") is None and P.backoff(9, lambda: 1.0) == 37.5


def test_json_in_talk():
    assert P.first_json('Sure:\n```json\n{"chunks": [], "s": "}"}\n```') == {"chunks": [], "s": "}"}
    assert P.first_json("none") is None


def test_batches_and_cache(spark):
    rows = spark.range(45).select(F.col("id").cast("string").alias("chunk_id"), F.lit("x").alias("content"))
    cache = spark.createDataFrame([("3", 0)], "chunk_id string, n int")
    ask = lambda part: part.assign(n=len(part))[["chunk_id", "n"]]
    done, new = P.with_cache(rows, cache, "chunk_id", "n", lambda p: P.batched(p, ["chunk_id", "content"], 20, ask, "chunk_id string, n long", ["chunk_id"]))
    assert sorted(r.n for r in new.select("n").distinct().collect()) == [4, 20] and done.where("n is null").count() == 0
    again, newer = P.with_cache(rows, cache.unionByName(new), "chunk_id", "n", lambda p: P.batched(p, ["chunk_id", "content"], 20, ask, "chunk_id string, n long", ["chunk_id"]))
    assert newer.count() == 0 and again.count() == 45


def test_failed_batches_stay_pending(spark):
    rows = spark.range(4).select(F.col("id").cast("string").alias("k"))

    def ask(part):
        if "0" in set(part["k"]):
            raise RuntimeError
        return part

    assert {r.k for r in P.batched(rows, ["k"], 2, ask, "k string", ["k"]).collect()} == {"2", "3"}


def test_jsonl_and_leaves(spark, tmp_path):
    lines = [{"id": "a", "doc_name": "D", "page_number": 1, "chunk_type": "text", "chunk_index": 0, "content": " Đoạn  một ", "search_text": ""}, {"id": "b", "doc_name": "D", "content": "", "search_text": "found"}, {"id": "c", "content": " "}]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "chunks.jsonl").write_text("\n\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n{broken\n")
    chunks = files.read_jsonl(spark, str(tmp_path)).cache()
    assert chunks.where("_corrupt is not null").count() == 1
    leaves = files.load_leaves(chunks).collect()
    assert {r.text for r in leaves} == {"Đoạn một", "found"} and all(r.node_id.startswith("leaf_") and len(r.node_id) == 21 for r in leaves)
    source = files.load_source_chunks(chunks.withColumn("content", F.lit("[ctx] some long enough text")))
    assert {(r.content, r.page_number) for r in source.collect()} == {("some long enough text", 1), ("some long enough text", 0)}


def test_store(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "v"), 2)
    assert s.read().count() == 0
    s.upsert(spark.createDataFrame([("a", "one", [1.0, 0.0], ["c1"]), ("b", "two", [0.0, 2.0], None)], "node_id string, text string, dense array<double>, source_chunk_ids array<string>"))
    s.upsert(spark.createDataFrame([("a", "new", [1.0, 1.0], ["c2"])], "node_id string, text string, dense array<double>, source_chunk_ids array<string>"))
    rows = {r.node_id: r for r in s.read().collect()}
    assert rows["a"].text == "new" and rows["a"].source_chunk_ids == ["c2"] and len(rows) == 2
    assert rows["a"].point_id == str(uuid.uuid5(store.NAMESPACE, "a"))
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, q array<double>")
    assert [(r.node_id, round(r.score, 4)) for r in s.search(asked, 2).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.7071)]
    assert s.search(asked, 0).count() == 0
    with pytest.raises(Exception, match="vector size"):
        s.upsert(spark.createDataFrame([("c", "t", [1.0])], "node_id string, text string, dense array<double>"))
    with pytest.raises(ValueError):
        store.VectorStore(spark, "x", 0)


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    src, rows = tmp_path / "in", [{"id": "", "doc_name": "D", "page_number": 1, "chunk_type": "text", "chunk_index": i, "content": f"text {i}"} for i in range(3)]
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    table = store.Table(spark, str(tmp_path / "t"), "id", files.CHUNK)
    for turn in range(2):
        ingest(read_chunks(spark, str(src)), table, str(tmp_path / f"cp{turn}")).awaitTermination()
        assert table.read().count() == 3


def test_pdf_source_calls_its_parser(spark, tmp_path):
    from gristmill.sources.pdf import PdfBlocks

    (tmp_path / "a.pdf").write_bytes(b"one two")
    spark.dataSource.register(PdfBlocks)
    rows = spark.read.format("pdf_blocks").option("parser", "tests.fake_pdf:blocks").load(str(tmp_path)).collect()
    assert [(r.block_index, r.text) for r in rows] == [(0, "one"), (1, "two")]


def test_a_large_file_of_one_row_group_is_spread(spark, tmp_path, monkeypatch):
    from gristmill.operators import lineage

    monkeypatch.setattr(lineage, "SMALL_SCAN", 1)
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(0, 100, 1, 4).write.parquet(f"{tmp_path}/four")
    held = lambda df: [n for n in df.rdd.glom().map(len).collect() if n]
    assert len(held(lineage.balanced(spark.read.parquet(f"{tmp_path}/one"), large=True))) == spark.sparkContext.defaultParallelism
    four = spark.read.parquet(f"{tmp_path}/four")
    assert lineage.balanced(four, large=True) is four
