import pytest
from pyspark.sql import functions as F

from gristmill.functions import layout as L
from gristmill.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want",
    [
        ("ﬁne — “x” 5 µg", 'fine - "x" 5 mcg'), ("5µg", "5microg"), ("10⁶ và H₂O", "10^6 và H2O"), ("a​b­c d", "abc d"), ("infor-\nmation", "information"), ("(cid:54) 3 ≤4", ">= 3 <= 4"), ("A → B ↑", "A -> B tang"), ("37°", "37 degree"), ("", ""),
    ],
)
def test_document_normaliser(spark, raw, want):
    assert one(spark, raw, T.normalize_document) == want


def test_document_normaliser_keeps_lines(spark):
    assert one(spark, " a  b\r\n\r\n\r\n\r\nc \n d ", lambda x: T.normalize_document(x, True)) == "a b\n\nc\nd"


def test_index_normaliser_has_its_own_targets(spark):
    assert one(spark, "A → 5 ≥ 37°C", T.normalize_index) == "a tang 5 >= 37 do c"


def test_folding_leaves_d_with_stroke(spark):
    assert one(spark, "Điều TRỊ ế", T.fold) == "đieu tri e"
    assert one(spark, "Điều", lambda x: T.fold(x, True)) == "dieu"
    assert one(spark, "Điều", T.strip_accents) == "Dieu"
    assert one(spark, "é", T.fold) == "e"


def test_mojibake(spark):
    assert one(spark, "chẩn đoán".encode().decode("latin-1"), T.repair_mojibake) == "chẩn đoán"
    assert one(spark, "Äußerung café", T.repair_mojibake) == "Äußerung café"


def test_compose(spark):
    assert one(spark, "ế", T.compose) == "ế"


def test_tokens(spark):
    assert one(spark, "Bệnh và 3,5 mg x 7", T.tokens) == ["benh", "bệnh", "3,5", "mg", "7"]
    assert one(spark, "", T.tokens) == []


def test_small_functions(spark):
    assert one(spark, "", T.estimate_tokens) == 1 and one(spark, "a b c d", T.estimate_tokens) == 6
    assert one(spark, "a b c", lambda x: T.last_words(x, 2)) == "b c" and one(spark, "a", lambda x: T.last_words(x, 2)) == "a"
    assert one(spark, "Tài liệu (1).PDF", T.safe_filename) == "tai_lieu_1_.pdf" and one(spark, "...", T.safe_filename) == "document"
    assert one(spark, "a\n12\n- 3 -\n/4/\nPage 5 of 9\nTrang 6\nb 7", T.remove_footers) == "a\nb 7"
    assert one(spark, "[context] body", T.strip_context) == "body"
    assert one(spark, "a" * 500, T.snippet) == "a" * 447 + "..."
    assert one(spark, "Aspirin (81 mg)!", T.canonical_name) == "aspirin 81 mg"
    assert one(spark, None, lambda x: T.stable_id(x, F.lit(1))) == one(spark, "None", lambda x: T.stable_id(x, F.lit(1)))


def test_markdown(spark):
    got = spark.range(1).select(T.markdown_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x|y")))).alias("m")).first().m
    assert got == "| a | b |\n| --- | --- |\n| x\\|y |  |"


@pytest.mark.parametrize(
    "line, want",
    [
        ("1.2 Dose", True), ("2 tablets daily", True), ("vi khuẩn gây bệnh", True), ("IIII text", False), ("A. Part", True), ("TREATMENT OF PAIN", True), ("Thuoc", True), ("thuoc: aspirin", True), ("plain words here", False), ("", False), ("x" * 200, False), ("1 " + "w " * 20, False),
    ],
)
def test_headings(spark, line, want):
    assert one(spark, line, L.is_heading) is want


def test_heading_levels_fonts_and_buckets(spark):
    assert [one(spark, x, L.heading_level) for x in ("1.2.3 a", "IV. a", "B. a", "thuoc", "other")] == [3, 1, 2, 3, 2]
    assert one(spark, "Some title", lambda x: L.is_heading(x, F.lit(14.0), F.lit(12.0))) is True
    assert one(spark, "xét nghiệm rồi thuốc", L.semantic_bucket) == "tests"
    assert one(spark, "factor", L.semantic_bucket) == "general" and one(spark, "a ct scan", L.semantic_bucket) == "tests"


def test_boxes(spark):
    box = lambda *x: tuple(F.lit(float(v)) if v is not None else F.lit(None).cast("double") for v in x)
    got = spark.range(1).select(L.intersects(box(0, 0, 1, 1), box(1, 0, 2, 1)).alias("a"), L.intersects(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("b"), L.intersects(box(0, 0, 2, None), box(1, 1, 3, 3)).alias("c"), L.area(box(2, 2, 1, 1)).alias("d"), L.distance(box(0, 0, 1, 1), box(5, 7, 6, 8)).alias("e")).first()
    assert tuple(got) == (False, True, False, 0.0, 12.0)


def test_tables(spark):
    def accept(rows, strategy="lines"):
        return spark.createDataFrame([(rows,)], "r array<array<string>>").select(L.looks_like_table(L.clean_rows(F.col("r")), F.lit(strategy)).alias("y")).first().y

    good = [["Name", "Dose"], ["Aspirin", "81 mg"], ["Heparin", "5000 IU"]]
    assert accept(good) and accept(good, "text")
    assert not accept([["only one row", "x"]]) and not accept([["a", "b"], ["c", "d"]])
    assert not accept([["the", "of it"], ["runs on", "and so"], ["to the", "end here"]], "text")
    assert accept([["", "", ""], ["Name", "", "Dose"], ["Aspirin", "", "81 mg"], ["Heparin", "", "50 mg"]])


def test_mojibake_of_any_letters(spark):
    """Texts whose right form scores no more than the wrong one, and other scripts."""
    for text in ("Ä", "á", "wait … and – so", "“quoted”", "Привет", "中文", "Ελλάδα", "😀 ok", "plain", "a » b", "Ã"):
        for codec in ("latin-1",) if any(0x80 <= b < 0xA0 for b in text.encode()) else ("latin-1", "cp1252"):
            assert one(spark, text.encode().decode(codec), T.repair_mojibake) == text
            assert one(spark, text.encode().decode(codec), lambda c: T.repair_mojibake(c, index=True)) == text
