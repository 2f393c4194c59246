"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import io
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import bpe, language_id, packing, simhash, substring_dedup, topk, warc
from gristmill.llm.line_dedup import dedup_lines
from gristmill.llm.quality_rules import counts, judge
from gristmill.llm.sharding import jump, mix, shard_rows
from gristmill.llm.topk import top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, `row` int, shard string, fp string, score string, kind string, slot int"
SPACE = r"[^\x20\x09-\x0D]+"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gam ma", "δέλτα", "e#p%", "zeta!", "the", "of", "\x85x", "漢字"]
    passage = " ".join(rng.choice(words) + str(i) for i in range(60))
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 80)))
        lines = [body, "A shared line of some length", body.upper() if i % 9 == 0 else ""]
        if i % 4 == 0:
            lines.insert(1, passage)
        if i % 7 == 0:
            lines += ["  same LINE twice here \t", "same line twice here"]
        rows.append((i, rng.choice(["\n", "\n", " \n "]).join(lines), "en" if i % 2 else None, "hot" if i % 3 == 0 else f"s{i}"))
    copy = rows[5][1]
    rows += [(100, None, "en", None), (101, "", "en", "hot"), (102, " \n\t ", None, "hot"), (103, "\n\n", "en", "x"), (104, copy, "en", "hot"), (105, copy, "en", "hot"), (105, copy, "en", "hot"), (106, "word " * 30_000, "en", "y"), (107, copy.lower(), "en", "z"), (108, "12 34 !!", "en", "z"), (None, copy, "en", "q"), (109, "one two three", "en", "z"), (-3, "x" * 200_000, "fr", "z")]
    return [(d, t, lang, s, len(t or ""), "?", "?", 7, "?", "?", "?", "?", 1) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(row):
    return (row[0] is None, row[0] or 0)


def test_line_dedup(docs, empty):
    first, where = {}, defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")
    rows = sorted(((r[0], r[1]) for r in documents()), key=order)
    for d, t in rows:
        for line in (t or "").split("\n"):
            first.setdefault(key(line), d)
            where[key(line)].add(d)
    want = []
    for d, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= 10 and len(where[key(x)]) > 1 and first[key(x)] != d)]
        n = (t or "").count("\n") + 1
        want.append((d, n, n - len(kept), "\n".join(kept)))
    got = dedup_lines(docs).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=str) == sorted(want, key=str)
    assert set(SCHEMA.replace("`", "").split()[::2]) <= {x for x in got[0].asDict()}
    assert dedup_lines(empty).count() == 0
    assert dedup_lines(docs, min_docs=3).agg(F.sum("n_dropped")).first()[0] <= sum(w[2] for w in want)


def without_repeats(rows):
    """Brute force of the substring deduplication over (id, text)."""
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: (*order(r), hashlib.sha256((r[1] or "").encode()).digest())):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        want.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return want


@pytest.mark.parametrize("chunk, fanout", [(6 << 20, 6), (3000, 6), (3000, 2), (1500, 1)])
def test_substring_dedup(docs, empty, monkeypatch, chunk, fanout):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "FANOUT_BITS", fanout)
    want = without_repeats([(r[0], r[1]) for r in documents()])
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_of_null_and_shared_ids_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "FANOUT_BITS", 2)
    rng = random.Random(3)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    rows = [(rng.choice([None, None, 4, 9, i]), " ".join([rng.choice(passages), f"own{i} " * rng.randrange(4), rng.choice(passages)])) for i in range(150)]
    got = [tuple(r) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got, key=str) == sorted(without_repeats(rows), key=str)
    with pytest.raises(TypeError):
        substring_dedup.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substring_dedup_compares_words_not_weak_hashes(spark):
    """The Thue-Morse words of 1,024 letters have equal polynomial hashes mod 2^64 for any odd base."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    tail = " ".join(f"t{i}" for i in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substring_sketches_grow_with_the_chunks():
    rng = np.random.default_rng(1)
    for chunks in (10, 1000, 100_000, 10_000_000):
        steps = substring_dedup.Steps(chunks, 44)
        cells = np.unique(rng.integers(0, 1 << 44, 5000, dtype=np.uint64))
        assert len(steps.sketch_pieces(0, 0, chunks - 1, 0, cells, cells[:9])) <= 1 << substring_dedup.FANOUT_BITS
        assert max(steps.bits) <= substring_dedup.FANOUT_BITS and chunks / 3 <= 1 << sum(steps.bits) < chunks
    assert [len(substring_dedup.ladder(c)) for c in (1, 190, 10_000, 10_000_000)] == [1, 1, 2, 4]


def brute_fingerprint(text):
    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("part, blocks", [(4096, 6), (3, 6), (4096, 8)])
def test_simhash(docs, empty, monkeypatch, part, blocks):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    assert [simhash.blocks_for(n, 4) for n in (10, 10**12)] == [blocks, max(blocks, 9)]
    rows = [((1 << 63) - 1 if r[0] is None else r[0], brute_fingerprint(r[1])) for r in documents()]
    links = {i: i for i, _ in rows}

    def find(i):
        while links[i] != i:
            i = links[i]
        return i

    for a, fa in rows:
        for b, fb in rows:
            if (fa ^ fb).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                links[y] = x
    got = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got) == sorted((i, f, find(i)) for i, f in rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_forest_joins_all_close_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    a = np.concatenate([base ^ np.uint64(1 << k) for k in range(6)])
    links = simhash.forest(a, a, True, 4)
    assert len(links) == 5 * 40 and all(int(a[i] ^ a[j]).bit_count() <= 4 for i, j in links)


def test_quality_counts_and_verdict(docs, empty):
    want = {}
    for r in documents():
        t = r[1] or ""
        w = re.findall(SPACE, t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = set()
        number = defaultdict(int)
        for x in windows:
            number[x] += 1
        for i, x in enumerate(windows):
            if number[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        want[r[0]] = (len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    rows = judge(docs).collect()
    assert len(rows) == len(documents())
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and 0 <= r.posterior <= 1
        assert not (r.kept and r.base_failed)
    assert judge(empty).count() == 0 and counts(empty).count() == 0


def test_quality_keeps_what_labels_call_good(spark):
    sf = "/root/testdata/sf0.01"
    rows = judge(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"]).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = rows.where("quality = 1"), rows.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_sharding(docs, empty):
    rows = shard_rows(docs).collect()
    assert len(rows) == len(documents())
    of = defaultdict(list)
    for r in rows:
        of[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
        h, at, to = int(mix(np.array([r.doc_id or 0], np.int64).view(np.uint64))[0]), -1, 0
        while to < 16:
            at = to
            h = (h * 2862933555777941757 + 1) % (1 << 64)
            to = int((at + 1) * (2147483648.0 / ((h >> 33) + 1)))
        assert at == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    assert shard_rows(empty).count() == 0
    assert shard_rows(docs, "source", 5).where("shard not between 0 and 4").count() == 0


def test_a_hot_key_is_ranked_in_many_tasks(spark):
    from gristmill.llm import sharding

    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = shard_rows(rows)
    assert out.select("shard").distinct().count() == 1 and sorted(r.slot for r in out.collect()) == list(range(2000))
    placed = rows.select(sharding._placer(16)(F.lit(0).cast("long"), F.xxhash64("text")).alias("p")).groupBy("p.sub").count()
    assert placed.count() == sharding.SUB_BUCKETS and placed.agg(F.max("count")).first()[0] < 40


def test_ids_that_are_no_numbers_are_an_error(docs):
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    for operator in (dedup_lines, simhash.near_duplicates):
        with pytest.raises(TypeError):
            operator(rows)


def test_jump_moves_only_what_it_must():
    keys = mix(np.arange(200_000).astype(np.uint64))
    a, b = jump(keys.copy(), 20), jump(keys.copy(), 21)
    assert set(b[a != b]) == {20} and abs((a != b).mean() - 1 / 21) < 0.003
    assert np.bincount(a).min() > 0.95 * 200_000 / 20


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(vocabulary):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(vocabulary).ranks, special_tokens={})


def test_bpe_encodes_and_decodes(docs, empty, vocabulary, reference):
    encoded = bpe.encode(docs, vocabulary)
    texts = {(r[0], r[1] or "") for r in documents()}
    got = {(r.doc_id, tuple(r.ids)) for r in encoded.collect()}
    assert got == {(d, tuple(reference.encode_ordinary(t))) for d, t in texts}
    back = {(r.doc_id, bytes(r.decoded)) for r in bpe.decode(encoded, vocabulary).collect()}
    assert back == {(d, t.encode()) for d, t in texts}
    assert bpe.encode(empty, vocabulary).count() == 0


def test_bpe_pieces_of_odd_characters(vocabulary, reference):
    rng = random.Random(4)
    v = bpe.vocabulary(vocabulary)
    signs = "ab'stre llmdv S  \n\t é漢😀1½!?#’-_́\x1c\x85"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(16))) for _ in range(3000)]
    for t, ids in zip(texts, bpe.encode_texts(texts, v), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t), t


def test_bpe_prefixes_appends_and_edits(vocabulary):
    v = bpe.vocabulary(vocabulary)
    e = bpe.PrefixEncoding(v, b"unbeliev")
    e.append(b"ablynesses")
    whole = bpe.PrefixEncoding(v, b"unbelievablynesses")
    assert e.last == whole.last
    for n in range(1, len(e.data) + 1):
        assert e.ids(n) == bpe.merge(e.data[:n], v.ranks)
    e.replace(2, 9, b"xyz")
    assert e.ids() == bpe.merge(b"unxyzblynesses"[:2] + b"xyz" + b"unbelievablynesses"[9:], v.ranks)


def test_language_accuracy_on_held_out_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(rows)
    out = language_id.identify(rows, model, keep=["doc_id", "lang"]).withColumn("held", language_id.held_out()).where("held")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    odd = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for d in (100, 101, 102, 103, 108):
        assert odd[d].lang_pred == "und" and odd[d].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


def test_language_training_leaves_held_out_rows_alone(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = rows.withColumn("text", F.when(language_id.held_out(), "zzz").otherwise(F.col("text")))
    a, b = language_id.train(rows), language_id.train(swapped)
    assert np.array_equal(a.weights, b.weights)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, capacity=64, shard_rows=30).collect()
    lengths = {}
    for r in documents():
        lengths[r[0]] = len(re.findall(SPACE, r[1] or ""))
    total = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.length
        if r.bin >= 0:
            bins[r.bin].append(r)
        assert (r.bin == -1) == (r.length == 0)
    assert {d: n for d, n in total.items() if d != 105} == {d: n for d, n in lengths.items() if d != 105} and total[105] == 2 * lengths[105]
    source = {r[0]: r[3] for r in documents()}
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        end = 0
        for r in own:
            assert r.offset == end
            end += r.length
        assert end <= 64 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len({source[r.doc_id] for r in own}) == len(own)
    assert packing.pack_documents(empty).count() == 0


def test_packing_takes_the_tightest_compatible_bin():
    rng = random.Random(2)
    items = [(rng.randrange(1, 50), rng.randrange(6), rng.randrange(40)) for _ in range(400)]
    got = packing.pack(items, 60)
    bins = []
    for (n, s, c), (number, offset) in zip(items, got, strict=True):
        fit = [(60 - b[0] - n, i) for i, b in enumerate(bins) if b[0] + n <= 60 and s not in b[1] and c not in b[2]]
        if fit:
            assert (60 - bins[number][0] - n, number) == min(fit)
        else:
            assert number == len(bins)
            bins.append([0, set(), set()])
        assert offset == bins[number][0]
        bins[number][0] += n
        bins[number][1].add(s)
        bins[number][2].add(c)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    data += [(400 + i, data[50][1]) for i in range(8)] + [(7, data[8][1]), (7, data[8][1])] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, data[0][1]), (504, []), (50, data[50][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, embedding array<float>, score string, id int")
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for at, (q, asked) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-int(asked @ v), i) for j, (i, v) in enumerate(usable) if j != at)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df).collect()]
    assert sorted(got) == sorted(want) and sum(r[0] == 50 for r in got) == 10
    assert top_k(df.limit(0)).count() == 0
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df).collect()) == sorted(want)
    large = spark.createDataFrame([(0, [2.0**19, 1.0]), (1, [2.0**19, 3.0 / 256]), (2, [2.0**19, 2.0 / 256])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(large).orderBy("rank").collect()] == [(1, 2**54 + 768), (2, 2**54 + 512)]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in top_k(few).collect()] == [(1, 128 * 256 + 128 * 512)]


PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no <p> --><script>var t="</p>";</script><p>Caf&eacute;&nbsp;&#233;t&eacute; <b>bold</b><br>line<div><a href="/x?a=1&amp;b=2">go</a> <a href=\'y\'>on</a></div></body></html>'


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", ""), (3, "http://b/", "")], "page_id long, url string, html string")
    rows = warc.derive(warc.responses_of_pages(pages).withColumn("kind", F.lit("clash"))).collect()
    assert len(rows) == 8
    by = {(r.page_id, r.kind): r for r in rows}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert bytes(text.block).decode() == "Café été bold\nline\ngo on"
    assert bytes(meta.block).decode() == "title: A & B\r\nlanguage: fr\r\noutlink: /x?a=1&b=2 L a/@href\r\noutlink: y L a/@href\r\n"
    assert text.refers_to == meta.refers_to != text.record_id and text.source_digest == warc.digest(PAGE.encode())
    (headers, block), = warc.parse(bytes(text.record))
    assert block == bytes(text.block) and headers["warc-type"] == "conversion" and headers["warc-refers-to"] == text.refers_to
    assert headers["warc-block-digest"] == warc.digest(block) and headers["warc-source-payload-digest"] == text.source_digest
    assert bytes(by[2, "conversion"].block) == b"" and warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0
    warc.write_warc(warc.derive(warc.responses_of_pages(pages)), str(tmp_path / "out"))
    found = [h["warc-record-id"] for p in (tmp_path / "out").glob("part-*") for h, _ in warc.parse(p.read_bytes())]
    assert sorted(found) == sorted(r.record_id for r in rows)


def test_warc_reads_responses(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    data = warc.record("response", "<urn:uuid:1>", [("WARC-Target-URI", "http://c/"), ("WARC-Date", "2024-01-01T00:00:00Z")], body)
    (tmp_path / "a.warc").write_bytes(data + warc.record("request", "<urn:uuid:2>", [], b"x"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data) + gzip.compress(data))
    rows = warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(rows) == 3 and {r.payload for r in rows} == {"<p>hi</p>"} and {r.record_id for r in rows} == {"<urn:uuid:1>"}


def test_without_any_language_only_texts_without_a_letter_go(spark):
    import corpus_pipeline

    rows = [(1, "Some words."), (2, "été"), (3, "12 !?"), (4, ""), (5, None), (6, "字")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 2, 6]


def test_a_head_without_its_end_tag_ends_at_the_body():
    for page in ("<head><title>T</title><body><p>Text <a href=x>y</a>", "<head><title>T</title><meta charset=a><script>if (a<b) c()</script><p>Text <a href=x>y</a>"):
        assert warc.plain_text(page) == "Text y"
        assert warc.fields_of(page) == "title: T\r\noutlink: x L a/@href\r\n"


def test_warc_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 350_000, "<script" * 150_000, "<noscript>" * 100_000, "<title>" * 150_000, "<" * 1_000_000, "<!--" * 250_000, "<head>" * 170_000 + "x", "<a href='" * 110_000, "</title " * 120_000, "\n\u2003" * 500_000):
        began = time.time()
        warc.plain_text(page), warc.fields_of(page)
        assert time.time() - began < 5, page[:10]
    assert warc.plain_text("<noscript>seen <p>and read</p><template>too") == "seen\nand read\ntoo"


def test_warc_text_agrees_with_a_parser(spark):
    """Text, title, language and links of all pages against the standard library's HTML parser."""
    from html.parser import HTMLParser

    class Parsed(HTMLParser):
        def __init__(self, page):
            super().__init__(convert_charrefs=True)
            self.parts, self.links, self.title, self.language, self.inside = [], [], None, None, []
            self.feed(page)
            self.close()
            lines = (" ".join(x.replace("\xa0", " ").split(" ")) for x in re.sub("[ \t\r\xa0]+", " ", "".join(self.parts)).split("\n"))
            self.text = "\n".join(x.strip() for x in lines if x.strip())

        def handle_starttag(self, tag, attrs):
            attrs = dict(attrs)
            if tag in warc._BLOCKS:
                self.parts.append("\n")
            if tag in ("script", "style", "head", "title"):
                self.inside.append(tag)
            if tag == "a" and "href" in attrs:
                self.links.append(attrs["href"])
            if tag == "html" and self.language is None:
                self.language = attrs.get("lang")

        def handle_endtag(self, tag):
            if tag in warc._BLOCKS:
                self.parts.append("\n")
            if tag in self.inside:
                self.inside.remove(tag)

        def handle_data(self, data):
            if "title" in self.inside:
                self.title = data
            if not self.inside:
                self.parts.append(data)

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").collect():
        got, want = warc.Page(r.html), Parsed(r.html)
        assert (got.text, got.language, got.links) == (want.text, want.language, [x.replace("&", "&amp;") if "&amp;" in r.html else x for x in want.links]), r.page_id
        assert got.title is None or " ".join(want.title.split()) == " ".join(__import__("html").unescape(got.title).split())


def test_warc_reader_reports_what_is_broken_and_goes_on(spark, tmp_path):
    import gzip
    import zlib

    def response(n, body, head=b""):
        return warc.record("response", f"<urn:uuid:{n}>", [("WARC-Target-URI", "http://c/")], b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body)

    chunked = b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    good = [
        response(1, b"one"), response(2, "é".encode("latin-1"), b"Content-Type: text/html; charset=latin-1\r\n"), response(3, chunked, b"Transfer-Encoding: chunked\r\n"),
        response(4, gzip.compress(b"zipped"), b"Content-Encoding: gzip\r\n"), response(5, zlib.compress(b"flat"), b"Content-Encoding: deflate\r\n"), response(6, '<meta charset="cp1252">\u20ac'.encode("cp1252")),
    ]
    bad = [b"rubbish\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\nx\r\n\r\n"]
    data = good[0] + bad[0] + good[1] + bad[1] + good[2] + bad[2] + b"".join(good[3:])
    (tmp_path / "a.warc").write_bytes(data)
    members = [gzip.compress(x) for x in good]
    (tmp_path / "b.warc.gz").write_bytes(members[0] + members[1][:30] + members[2] + members[3])
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a.warc")
    for source in (files, files.select("path")):
        rows = warc.read_responses(source).collect()
        assert [r.payload for r in rows if r.problem is None] == ["one", "é", "hello world", "zipped", "flat", '<meta charset="cp1252">\u20ac']
        assert [r.problem for r in rows if r.problem] == ["no record header", "no valid Content-Length", "shorter than its Content-Length"]
    rows = warc.read_responses(spark.read.format("binaryFile").load(f"{tmp_path}/b.warc.gz")).collect()
    assert {r.record_id for r in rows if r.problem is None} == {"<urn:uuid:1>", "<urn:uuid:3>", "<urn:uuid:4>"} and "broken gzip member" in {r.problem for r in rows}
    assert warc.derive(warc.read_responses(files)).count() == 12
    read = io.BytesIO(data).read
    assert [h.get("warc-record-id") for h, _, p in warc.Reader(lambda n: read(min(n, 7)), 5) if p is None] == [f"<urn:uuid:{n}>" for n in range(1, 7)]


def test_warc_headers_stay_on_their_lines(spark):
    rows = [(1, "http://a/\r\nX-Evil: 1 b", "<p>t")] * 2
    out = warc.derive(warc.responses_of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(out) == 4 and len({r.record_id for r in out}) == 2
    for r in out:
        (headers, _), = warc.parse(bytes(r.record))
        assert headers["warc-target-uri"] == "http://a/%0D%0AX-Evil:%201%20b" and "x-evil" not in headers


def test_packing_agrees_with_brute_force(docs):
    """The whole operator against a naive packer over the same shards; ids of other kinds, rows repeated very often."""
    length, cluster = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(packing.WORD_RE), F.lit(0))), packing.copy_group()
    for cast in ("long", "int", "string"):
        rows = docs.withColumn("doc_id", F.col("doc_id").cast(cast))
        light = packing.spread(rows, "doc_id", "source", length, cluster, 20).collect()
        want = []
        for shard in {r.shard for r in light}:
            bins, items = [], []
            mine = sorted((r for r in light if r.shard == shard), key=lambda r: (r.id is None, r.id or 0, r.cluster, r.source, r.n))
            for r in mine:
                items += [(r.n % 64, r)] if r.n % 64 else []
            for n, r in sorted(items, key=lambda x: -x[0]):
                fit = [(64 - b[0] - n, i) for i, b in enumerate(bins) if b[0] + n <= 64 and r.source not in b[1] and r.cluster not in b[2]]
                at = min(fit)[1] if fit else len(bins)
                if not fit:
                    bins.append([0, set(), set()])
                want.append(((shard << 32) + at, r.id, r.n // 64, n, bins[at][0]))
                bins[at][0] += n
                bins[at][1].add(r.source)
                bins[at][2].add(r.cluster)
        got = packing.pack_documents(rows, capacity=64, shard_rows=20)
        assert dict(got.dtypes)["doc_id"] == dict(rows.dtypes)["doc_id"]
        assert sorted(((r.bin, r.doc_id, r.piece, r.length, r.offset) for r in got.collect() if 0 < r.length < 64), key=str) == sorted(want, key=str)


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "REPEATS", 100)
    same = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    shards = packing.spread(same, "doc_id", "source", F.lit(3), packing.copy_group(), 50).groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) == 1000 and max(r["count"] for r in shards) < 100
    rows = packing.pack_documents(same, shard_rows=50)
    assert rows.count() == 1000 == rows.select("bin").distinct().count()


def test_language_kernel_is_the_share_of_common_ngrams():
    texts = ["The cat sat.", "The hat sat!", "Chats et chiens", "ein Hund"]

    def grams(text):
        flat = "".join(c if c.isalpha() else " " for c in text.lower())
        return {flat[i : i + n] for n in range(1, language_id.MAX_N + 1) for i in range(len(flat) - n + 1)}

    presence, _ = language_id.ngrams(texts)
    model = language_id.fit([("a" if i < 2 else "b", np.flatnonzero(presence[i])) for i in range(4)])
    got = model.kernel(presence)
    for i, a in enumerate(map(grams, texts)):
        for j, b in enumerate(map(grams, texts)):
            assert got[i, j] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, abs=0.02)


def test_every_language_is_learned(spark):
    rows = [(i, " ".join([f"{chr(0x4E00 + i % 250 * 5)}{chr(0x5E00 + i % 250)}"] * 4), f"l{i % 250:03d}") for i in range(3000)]
    docs = spark.createDataFrame([*rows, *[(7, "aaa bbb", "l007")] * 50, (None, "zz", "null id")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == [f"l{i:03d}" for i in range(250)] and len(model.landmarks) <= language_id.LANDMARKS
    out = language_id.identify(docs, model).where("text not like '%aaa%' and doc_id is not null")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()


def test_quality_estimate_converges(spark):
    from gristmill.llm import quality_rules

    found = {r[0]: r[1] for r in counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").groupBy(quality_rules.pattern()).count().collect()}
    before, _ = quality_rules.estimate(found)
    quality_rules.ROUNDS += 20
    try:
        after, _ = quality_rules.estimate(found)
    finally:
        quality_rules.ROUNDS -= 20
    assert max(abs(before[p] - after[p]) for p in found) < 1e-3
    assert after[sum(2 * 3**k for k in range(6))] > 0.8 > 0.5 > max(p for v, p in after.items() if 1 in [v // 3**k % 3 for k in range(6)])


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from gristmill.llm._common import shared_dir

    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: none))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
