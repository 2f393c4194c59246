"""Text normalisation and measures as column expressions.

The normalisers are chains of JVM functions; only repair of mis-decoded text and full Unicode composition need Python
(Arrow batches), and mis-decoded text is looked for first, so clean rows never leave the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DELETED = "﻿­​‌‍⁠"
#: Replacements of single characters: targets by the characters that become them.
DOCUMENT_SYMBOLS = [
    (" ", " "), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("-", "‐–—−"), ('"', "“”„″"), ("'", "‘’′"),
    (" x ", "×"), (" / ", "÷"), (" <= ", "≤≦"), (" >= ", "≥≧"), (" +/- ", "±"), (" ~= ", "≈"), (" != ", "≠"), (" -> ", "→"), (" <- ", "←"), (" <-> ", "↔"), (" => ", "⇒"),
    (" tang ", "↑"), (" giam ", "↓"), ("- ", "•▪●◦"), ("Ư", "Ƣ"), ("ư", "ƣ"), ("micro", "µμ"), (" degree ", "°"), (" degree C ", "℃"), (" degree F ", "℉"), (" per mille ", "‰"),
]
INDEX_SYMBOLS = [(" >= ", "≥≧"), (" <= ", "≤≦"), (" != ", "≠"), (" +/- ", "±"), (" tang ", "↑→"), (" giam ", "↓"), (" micro ", "µμ"), (" do c ", "℃")]
GLYPH_CODES = {54: ">=", 110: "↑", 112: "↓", 113: "°", 114: "↔"}
RAISED, LOWERED = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁽⁾ⁿ", "₀₁₂₃₄₅₆₇₈₉₊₋₍₎"
#: Words left out of the index, in folded form; those with _ only occur where a word segmenter joins compounds.
STOPWORDS = sorted("voi ve va tu trong thi tai se sau ra qua phai o nhung nhieu nguoi neu nay mot lam la khi hoac hay gi duoc den de dang cua con co cho chi can cach cac bi bao anh ai a benh_nhan chan_doan dieu_tri nguoi_benh trieu_chung".split())
TOKEN = r"[0-9]+(?:[.,][0-9]+)?|\p{L}+(?:_\p{L}+)*"


def _accents() -> tuple[str, str]:
    """Precomposed characters of the Latin, Greek and Cyrillic blocks, and their bases."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)] if len(unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFD", chr(c))[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASES = _accents()
_MARKS = r"\p{Mn}+"


def literal(x: str) -> str:
    return "".join(f"\\u{ord(c):04x}" if not c.isalnum() else c for c in x)


def replace_symbols(text: Column, table: list[tuple[str, str]]) -> Column:
    """One search decides whether a text has any of the symbols; only then they are replaced, one after another."""
    one = [(c, to) for to, chars in table for c in chars]
    done = F.translate(text, "".join(c for c, to in one if len(to) == 1), "".join(to for _, to in one if len(to) == 1))
    for to, chars in table:
        if len(to) != 1:
            done = F.regexp_replace(done, f"[{literal(chars)}]", to)
    return F.when(text.rlike(f"[{literal(''.join(c for c, _ in one))}]"), done).otherwise(text)


def squeeze(text: Column) -> Column:
    """All white space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_document(text: Column, preserve_lines: bool = False) -> Column:
    """The document normaliser: glyph codes, symbols, raised and lowered digits, units, line ends, hyphens, blanks. Text should be composed (NFC), see compose()."""
    for code, to in GLYPH_CODES.items():
        text = F.replace(text, F.lit(f"(cid:{code})"), F.lit(to))
    text = replace_symbols(F.translate(text, DELETED, ""), DOCUMENT_SYMBOLS)
    text = F.regexp_replace(text, f"([{RAISED}])", "^$1")
    text = F.translate(text, RAISED + LOWERED, "0123456789+-()n" + "0123456789+-()")
    for unit, to in (("g", "mcg"), ("l", "uL"), ("mol", "umol")):
        text = F.regexp_replace(text, rf"(?iU)\bmicro\s*{unit}\b", to)
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    if not preserve_lines:
        return squeeze(text)
    text = F.regexp_replace(text, "[ \t\x0b\f]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_index(text: Column) -> Column:
    """The index normaliser: lower case and other targets for symbols (a right arrow means up here)."""
    text = replace_symbols(F.lower(text), INDEX_SYMBOLS)
    return squeeze(F.replace(text, F.lit("°c"), F.lit(" do c ")))


def fold(text: Column, fold_d: bool = False) -> Column:
    """Lower case without combining marks. The letter d with stroke stays unless fold_d: it does not decompose."""
    text = F.regexp_replace(F.translate(F.lower(text), ACCENTED, BASES), _MARKS, "")
    return F.translate(text, "đĐ", "dd") if fold_d else text


def strip_accents(text: Column) -> Column:
    """Without combining marks, d with stroke as d; the case stays."""
    return F.translate(F.regexp_replace(F.translate(text, ACCENTED, BASES), _MARKS, ""), "đĐ", "dD")


@F.pandas_udf(StringType())
def compose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC; Spark has no function for it."""
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _repaired(text: str, odd: int = 3, broken: int = 20) -> str:
    def score(t: str) -> int:
        good = sum(c.isalnum() or c.isspace() for c in t)
        return good - odd * sum(c in "ÃÂÄÆáº»" for c in t) - broken * t.count("�")

    def decoded(t: str) -> set[str]:
        out = set()
        for codec in ("cp1252", "latin-1"):
            try:
                out.add(t.encode(codec).decode("utf-8"))
            except UnicodeError:
                pass
        return out - {t}

    # a whole text is valid UTF-8 by chance next to never, whatever its letters score; a second round has to score more
    once = decoded(text) or {text}
    twice = set().union(*map(decoded, once)) - once
    return max([*sorted(once), *sorted(twice)], key=score)


@F.pandas_udf(StringType())
def _repair(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else _repaired(t))


@F.pandas_udf(StringType())
def _repair_index(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else _repaired(t, 4, 30))


def repair_mojibake(text: Column, index: bool = False) -> Column:
    """Text that was decoded with a wrong code page, decoded rightly; a second round only where that scores more. Rows without a pair that could be the first two bytes of a character stay as they are.

    index: the weights of the index normaliser, which counts odd letters and replacement characters more.
    """
    return F.when(text.rlike("[Â-ô][\u0080-¿Œ-™]"), (_repair_index if index else _repair)(text)).otherwise(text)


def tokens(text: Column, segment: Callable[[Column], Column] | None = None) -> Column:
    """Index terms; segment (say, a pandas UDF of a word segmenter) may join compounds with _ first. They are: numbers and runs of letters, folded, and the accented form too where it differs. One-letter terms and stopwords are left out."""
    extract = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    keep = lambda f: ((F.char_length(f) > 1) | f.rlike("^[0-9]+$")) & ~f.isin(*STOPWORDS)

    def folded(plain: Column) -> Column:
        pairs = F.filter(F.arrays_zip(extract(plain).alias("w"), extract(F.translate(plain, ACCENTED + "đ", BASES + "d")).alias("f")), lambda p: keep(p["f"]))
        return F.flatten(F.transform(pairs, lambda p: F.when(p["w"] == p["f"], F.array(p["f"])).otherwise(F.array(p["f"], p["w"]))))

    def of(normal: Column) -> Column:
        # loose marks go first; then folding keeps every character's place, and both forms split alike
        return F.when(normal.rlike(r"[^\x00-\x7F]"), folded(F.regexp_replace(normal, _MARKS, ""))).otherwise(F.filter(extract(normal), keep))

    # transform() over one element binds the normalised text, so it is worked out once
    normal = normalize_index(text)
    return F.transform(F.array(normal if segment is None else segment(normal)), of)[0]


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def estimate_tokens(text: Column) -> Column:
    """max(1, ceil(1.3 words))."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(count_words(text).cast("double") * 1.3e0).cast("long"))


def last_words(text: Column, n: int) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    return F.array_join(F.when(F.size(words) > n, F.slice(words, -n, n)).otherwise(words), " ") if n > 0 else F.lit("")


def join_pages(pages: Column) -> Column:
    """Page numbers as one text; none: a question mark."""
    known = F.transform(F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p.isNotNull()), lambda p: p.cast("string"))
    return F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise("?")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? ; : before a capital or a digit; blank ones are left out."""
    parts = F.split(F.regexp_replace(text, r"([.!?;:])\s+([A-ZÀ-Ỵ0-9])", "$1\u0001$2"), "\u0001", -1)
    return F.filter(parts, lambda s: F.trim(s) != "")


def stable_id(*parts: Column, prefix: str = "", separator: str = "|") -> Column:
    """16 hex digits of the SHA-1 of the joined parts. A null part counts as the word None."""
    joined = F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, 16))


def safe_filename(text: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9_.-]+", "_"), "^[_.]+|[_.]+$", "")
    return F.when(name == "", "document").otherwise(F.coalesce(name, F.lit("document")))


def remove_footers(text: Column) -> Column:
    """Without lines that are page numbers in any accepted form."""
    footer = r"(?iU)^\s*(?:-?\s*\d+\s*-?|/\s*\d+\s*/?|(?:page|trang)\s+\d+(?:\s*(?:/|of)\s*\d+)?)\s*$"
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(footer)), "\n")


def strip_context(text: Column) -> Column:
    """Without a bracketed context at the start."""
    return F.regexp_replace(text, r"^\s*\[[^\]]*\]\s*", "")


def canonical_name(name: Column) -> Column:
    """The key of an entity: folded, word characters and % + . / - only."""
    return squeeze(F.regexp_replace(fold(name), r"(?U)[^\w%+./-]+", " "))


def snippet(text: Column, limit: int = 450) -> Column:
    """One line, cut with three dots beyond the limit."""
    flat = squeeze(text)
    return F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; the first row is the header, short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def group_fingerprints(rows: DataFrame, by: list[str], parts: list[Column]) -> DataFrame:
    """(by, n, fingerprint): a digest of each group's rows that no order changes: the sums of the words of their SHA-1 digests, which are combined before the shuffle, so a group of any size costs one row a task."""
    h = F.sha1(F.concat_ws("\t", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    words = [F.sum(F.conv(F.substring("__h", at, 8), 16, 10).cast("long")).alias(f"s{i}") for i, at in enumerate((1, 9, 17, 25, 33))]
    sums = rows.select(*by, h.alias("__h")).groupBy(*by).agg(F.count("*").alias("n"), *words)
    return sums.select(*by, "n", F.sha1(F.concat_ws(":", "n", *(f"s{i}" for i in range(5)))).alias("fingerprint"))
