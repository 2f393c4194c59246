"""Registered queries against their SQL, and the pipeline against its stages' meaning."""

import re

import pytest

from tests.compare import differences

llm = pytest.importorskip("gristmill.llm.queries")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(llm.queries()[name](spark, SF_SMALL), llm.oracle_sql()[name], SF_SMALL) == ""


def test_queries_without_sql_return_their_columns(spark):
    want = {"op1_warc_derivatives": 100, "op5_simhash_blocks": 200, "op8_string_kernel_language": 200, "op9_bpe_prefix_dp": 200}
    for name, rows in want.items():
        assert llm.queries()[name](spark, SF_SMALL).count() == rows


def windows_of(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 20]) for i in range(len(w) - 19)}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = p.materialise(stage(spark, before, SF_SMALL))
        assert docs.columns == before.columns, name
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) == docs.count() and all(re.search(r"\w", t) for t in kept.values())
    packed = p.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == set(kept)
    assert sum(r.length for r in packed) == sum(len(t.encode().split()) for t in kept.values())
    from gristmill.llm import _common

    before = len(_common._scratch)
    assert p.run(spark, SF_SMALL).count() == len(packed) and len(_common._scratch) == before + 1


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_stages(rows, languages):
    """The rows of each stage but the last by plain Python; languages: predictions by text."""
    from tests.llm.test_operators import brute_fingerprint, order, without_repeats

    now = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and languages[r[1]][1] >= 0.25]
    now = [(d, t, languages[t][0], s, n) for d, t, _, s, n in now]
    yield now
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x).strip(" \t\n\x0b\x0c\r")
    first, where = {}, {}
    for d, t, *_ in sorted(now, key=order):
        for line in t.split("\n"):
            first.setdefault(key(line), d)
            where.setdefault(key(line), set()).add(d)
    lines = []
    for d, t, lang, s, _ in now:
        left = [x for x in t.split("\n") if not (len(key(x)) >= 10 and len(where[key(x)]) > 1 and first[key(x)] != d)]
        if left:
            lines.append((d, "\n".join(left), lang, s, len("\n".join(left))))
    yield lines
    groups = []
    for r in sorted(lines, key=lambda r: (*order(r), r[1])):
        print_ = brute_fingerprint(r[1])
        near = [g for g in groups if any((print_ ^ f).bit_count() <= 4 for f, _ in g)]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [(print_, r)]]
    one = [min((r for _, r in g), key=lambda r: (*order(r), r[1])) for g in groups]
    yield one
    cut = {d: (n, gone, t) for d, n, gone, t in without_repeats([(r[0], r[1]) for r in one])}
    yield [(d, t if not cut[d][1] else cut[d][2], lang, s, len(t if not cut[d][1] else cut[d][2])) for d, t, lang, s, _ in one if cut[d][1] < cut[d][0]]


def test_pipeline_stages_agree_with_brute_force(spark):
    """Nulls, empty and long texts, ties, repeated rows and copies through every stage."""
    import random

    import corpus_pipeline as p
    from gristmill.llm.language_id import identify, train

    rng = random.Random(8)
    words = {"en": "the of and water house small river walk green stone".split(), "fr": "le de et eau maison petite riviere marche verte pierre".split()}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(30)) for _ in range(n))
    shared, passage = "a line that many documents share", line("en", 45)
    rows = []
    for i in range(60):
        lang = "fr" if i % 4 == 0 else "en"
        parts = [line(lang, rng.randrange(4, 60)) for _ in range(3)] + ([shared] if i % 3 == 0 else []) + ([f"before{i} {passage} after{i}"] if i % 5 == 0 else [])
        rows.append((i, "\n".join(parts), lang, "hot" if i % 3 else f"s{i}"))
    rows += [(100, rows[7][1], "en", "hot"), (101, rows[7][1].upper(), None, "hot"), (102, None, "en", "x"), (103, "", "en", None), (104, " \n\t", "fr", "x"), (105, "12 34 !?", "en", "x"), (106, "word " * 20_000, "en", "y")]
    rows += [rows[9], rows[9], (107, shared, "en", "z"), (None, line("en", 70), "en", "z"), (None, line("fr", 70), "fr", None), (108, shared + "\n" + shared.upper(), "en", "z")]
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]
    docs = spark.createDataFrame(rows, ROWS)
    languages = {r.text: (r.lang_pred, r.score) for r in identify(docs, train(docs)).collect()}
    for (name, stage), want in zip(p.STAGES[:-1], brute_stages(rows, languages), strict=True):
        docs = p.materialise(stage(spark, docs, ""))
        assert sorted((tuple(r) for r in docs.collect()), key=str) == sorted(want, key=str), name
    packed = p.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.length for r in packed) == sum(len(r[1].encode().split()) for r in want)
    bins = [(r.bin, r.doc_id) for r in packed if r.bin >= 0 and r.length < 2048]
    source = {r[0]: r[3] for r in want}
    assert len({(b, source[d]) for b, d in bins if d is not None}) == len([1 for _, d in bins if d is not None])


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], ROWS)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
