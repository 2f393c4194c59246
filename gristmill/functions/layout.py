"""Predicates on headings, boxes and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import fold

#: Section keywords by bucket, folded.
BUCKETS = {
    "symptoms": "bieu hien|dau hieu|lam sang|trieu chung",
    "diagnosis": "chan doan|chan doan phan biet|tieu chuan chan doan",
    "tests": "can lam sang|cong thuc mau|ct|dien tim|mri|sieu am|sinh hoa|x quang|xet nghiem",
    "treatment": "cap cuu|dieu tri|lieu dung|phac do|thuoc|xu tri",
    "complications": "bien chung|di chung|tien luong",
}
KEYWORDS = [(k, bucket) for bucket, words in BUCKETS.items() for k in words.split("|")]
ROMAN = "M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
NUMBERED = r"^\s*[0-9]+(?:\.[0-9]+){0,5}\.?\s+\S"
ROMAN_LINE, LETTERED = r"(?i)^\s*([IVXLCDM]+)\.?\s+\S", r"(?i)^\s*[A-Z]\.\s+\S"
#: One expression for all keywords, so a line is folded once, not once for each.
_ANY = "|".join(k for k, _ in KEYWORDS)
HEADING_CHARS, HEADING_WORDS = 160, 16


def _roman(line: Column) -> Column:
    head = F.upper(F.regexp_extract(line, ROMAN_LINE, 1))
    return (head != "") & head.rlike(f"^{ROMAN}$")


def is_heading(line: Column, font: Column | None = None, body_font: Column | None = None) -> Column:
    """Whether a line is a heading, by the first rule that decides: length, keyword, structural prefix, keyword with colon, capitals, font."""
    text = F.trim(line)
    folded, words = fold(text), F.regexp_count(text, F.lit(r"(?U)\S+"))
    keyword, starts = folded.rlike(rf"^(?:{_ANY})(?::|\z)"), folded.rlike(f"^(?:{_ANY})")
    roman_like = text.rlike(ROMAN_LINE) & ~text.rlike(NUMBERED)
    structural = text.rlike(NUMBERED) | roman_like | text.rlike(LETTERED)
    capitals = (F.upper(text) == text) & (F.lower(text) != text) & F.char_length(text).between(5, 120) & (words <= 14)
    large = F.coalesce((font >= body_font + 1.5) & (words <= 14), F.lit(False)) if font is not None and body_font is not None else F.lit(False)
    rest = (text.endswith(":") & starts) | capitals | large
    decided = F.when(keyword, True).when(structural & ~(roman_like & ~_roman(text) & ~text.rlike(LETTERED)), words <= HEADING_WORDS).otherwise(rest)
    return F.coalesce(F.when((text == "") | (F.char_length(text) > HEADING_CHARS), False).otherwise(decided), F.lit(False))


def heading_level(line: Column) -> Column:
    """Depth of the number up to 5; Roman 1; letter 2; keyword 3; else 2."""
    text = F.trim(line)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+){0,5})\.?\s", 1)
    keyword = fold(text).rlike(f"^(?:{_ANY})")
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(5))).when(_roman(text), 1).when(text.rlike(LETTERED), 2).when(keyword, 3).otherwise(2).cast("int")


def semantic_bucket(text: Column) -> Column:
    """The bucket of the keyword that comes first; keywords of up to three characters need word boundaries; none: general."""

    def first(folded: Column) -> Column:
        found = []
        for i, (k, bucket) in enumerate(KEYWORDS):
            at = F.regexp_instr(folded, F.lit(rf"\b{k}\b")) if len(k) <= 3 else F.locate(k, folded)
            found.append(F.when(at > 0, F.struct(at.cast("int").alias("at"), F.lit(i).alias("nth"), F.lit(bucket).alias("bucket"))))
        return F.array_min(F.array_compact(F.array(*found)))["bucket"]

    # transform() over one element binds the folded text, so it is worked out once
    return F.coalesce(F.transform(F.array(fold(text)), first)[0], F.lit("general"))


def intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (x0, y0, x1, y1) overlap; touching is not enough, null never overlaps."""
    return F.coalesce((a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1]), F.lit(False))


def area(box: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0e0), box[2] - box[0]) * F.greatest(F.lit(0e0), box[3] - box[1])


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """0 if the boxes overlap, else the sum of the distances of their upper left corners."""
    return F.when(intersects(a, b), 0e0).otherwise(F.abs(a[1] - b[1]) + F.abs(a[0] - b[0]))


def clamp(box: tuple[Column, ...], page: tuple[Column, ...], margin: float = 4.0) -> Column:
    """The box with a margin, within the page."""
    return F.struct(F.greatest(page[0], box[0] - margin).alias("x0"), F.greatest(page[1], box[1] - margin).alias("y0"), F.least(page[2], box[2] + margin).alias("x1"), F.least(page[3], box[3] + margin).alias("y1"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once however often body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def clean_rows(rows: Column) -> Column:
    """Cells trimmed, rows filled up to one width, blank rows and then blank columns left out."""
    trimmed = lambda rows, width: F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), F.array_repeat(F.lit(""), width - F.size(r))))
    columns = lambda full, width: F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(full, lambda r: F.get(r, i) != ""))

    def cleaned(rows: Column, width: Column) -> Column:
        full = F.filter(trimmed(rows, width), lambda r: F.exists(r, lambda c: c != ""))
        some = bound(full, lambda full: bound(columns(full, width), lambda at: F.transform(full, lambda r: F.transform(at, lambda i: F.get(r, i)))))
        return F.when(F.coalesce(width, F.lit(0)) == 0, F.array().cast("array<array<string>>")).otherwise(some)

    return bound(rows, lambda rows: bound(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: cleaned(rows, width)))


def looks_like_table(rows: Column, strategy: Column | None = None, width_share: Column | None = None) -> Column:
    """Accepts cleaned rows as a table; tables found by text alignment (strategy `text`) must also not look like cut-up prose."""
    strategy = F.lit("lines") if strategy is None else strategy
    width_share = F.lit(1e0) if width_share is None else width_share
    share = lambda some, of: F.when(F.size(of) == 0, 0e0).otherwise(F.size(some) / F.size(of))
    in_row = lambda r: F.filter(r, lambda c: F.trim(c) != "")

    def prose(rows: Column, filled: Column, short: Column, fragmented: Column, whole: Column) -> Column:
        cols = F.size(rows[0])
        lower = share(F.filter(filled, lambda c: c.rlike(r"(?U)^\p{Ll}")), filled)
        dots = F.regexp_count(whole, F.lit(r"\.")) / F.greatest(F.char_length(whole), F.lit(1))
        multi = F.size(F.filter(rows, lambda r: F.size(in_row(r)) >= 2))
        return ((cols >= 3) & (short >= 0.5) & (fragmented >= 0.35)) | (lower >= 0.22) | ((cols >= 3) & (width_share < 0.35)) | (F.regexp_count(whole, F.lit(r"\.\.\.")) >= 3) | (dots >= 0.08) | (multi < 3) | ((short >= 0.4) & (fragmented >= 0.25))

    def accepted(rows: Column, filled: Column) -> Column:
        chars = F.aggregate(filled, F.lit(0), lambda a, c: a + F.char_length(c))
        base = (F.size(rows) >= 2) & (F.size(rows[0]) >= 2) & (share(filled, F.flatten(rows)) >= 0.2) & (chars >= 12) & (F.size(filled) >= 4)
        short = share(F.filter(filled, lambda c: c.rlike(r"(?U)^\p{L}{1,3}$")), filled)
        fragments = F.filter(rows, lambda r: F.size(F.filter(r, lambda c: c.rlike(r"(?U)^\p{L}{1,3}$"))) >= 2)
        bad = bound(short, lambda s: bound(F.size(fragments) / F.size(rows), lambda f: bound(F.array_join(filled, " "), lambda w: prose(rows, filled, s, f, w))))
        return base & ((strategy != "text") | ~bad)

    return F.coalesce(bound(rows, lambda r: bound(F.filter(F.flatten(r), lambda c: F.trim(c) != ""), lambda f: accepted(r, f))), F.lit(False))
