"""Language identification by a string kernel.

The kernel of two texts is the share of blended-spectrum n-grams (1 to MAX_N characters, presence only) that they have
in common: |A and B| / sqrt(|A| |B|). Nystroem landmarks approximate it: f(x) = K(x, L) W^(-1/2) with W = K(L, L), and
one ridge regression on f for each language (one versus the rest) is solved in closed form. Scoring a batch of texts is
two matrix products, presence x landmarks and kernel x weights.

Characters are lower-cased; all that is no letter counts as one symbol. An n-gram's number is a hash of it to BITS bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._common import materialise, others

MAX_N, BITS = 4, 17
#: The bounds of what is fitted on, whatever the size of the input: labelled rows of a language and of all languages,
#: landmarks of a language and of all. Every language is learned: with many of them each has fewer rows and landmarks,
#: one at least.
ROWS_PER_LANGUAGE, ROWS, LANDMARKS_PER_LANGUAGE, LANDMARKS, RIDGE = 400, 2000, 40, 400, 1e-3
SLICE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)], bool)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of each n-gram number in each text (rows x 2^BITS, bool), and whether a text has a letter."""
    out = np.zeros((len(texts), 1 << BITS), bool)
    lettered = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        for at in range(0, len(text), SLICE):  # n-grams across the edge are in the next slice's overlap
            part = text[max(0, at - MAX_N + 1) : at + SLICE].lower()
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            is_letter = _letters()[points]
            lettered[i] |= is_letter.any()
            c = np.where(is_letter, points, 0).astype(np.uint32) + np.uint32(1)
            h = np.zeros(len(c), np.uint32)
            for n in range(1, MAX_N + 1):
                h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :]
                if not len(h):
                    break
                mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x2545F49)) * np.uint32(0x85EBCA6B)
                out[i, mixed >> np.uint32(32 - BITS)] = True
    return out, lettered


class Model:
    """Landmarks and weights; small enough to go with the function to the executors."""

    def __init__(self, languages: list[str], columns: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.columns, self.landmarks, self.weights = languages, columns, landmarks, weights

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(1, presence.sum(axis=1)))[:, None]
        return (presence[:, self.columns].astype(np.float32) @ self.landmarks.T) / sizes

    def scores(self, presence: np.ndarray) -> np.ndarray:
        k = self.kernel(presence)
        return np.hstack([k, np.ones((len(k), 1), np.float32)]) @ self.weights


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """From (language, numbers of the n-grams) of a bounded sample; languages and rows in a fixed order."""
    languages = sorted({r[0] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    target = np.array([number[r[0]] for r in rows])
    marks_each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(languages)))
    chosen = np.concatenate([np.flatnonzero(target == k)[:marks_each] for k in range(len(languages))]).astype(int)

    def presence(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 1 << BITS), bool)
        for i, j in enumerate(at.tolist()):
            out[i, rows[j][1]] = True
        return out

    columns = np.unique(np.concatenate([rows[j][1] for j in chosen.tolist()])).astype(np.int64)
    marks = np.concatenate([presence(part)[:, columns].astype(np.float32) for part in np.array_split(chosen, -(-len(chosen) // 64))])
    marks /= np.sqrt(np.maximum(1, marks.sum(axis=1)))[:, None]
    w = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(w)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])  # K(x, L) @ root is the Nystroem feature
    half = Model(languages, columns, marks, np.zeros(0))
    parts = np.array_split(np.arange(len(rows)), -(-len(rows) // 64))  # a few rows at once: the driver's memory stays small
    features = np.hstack([np.concatenate([half.kernel(presence(part)) for part in parts]).astype(np.float64) @ root, np.ones((len(rows), 1))])
    wanted = (target[:, None] == np.arange(len(languages))).astype(np.float64)
    # languages of few rows weigh as much as those of many
    weight = (1 / np.bincount(target, minlength=len(languages)))[target][:, None] * len(rows) / len(languages)
    gram = features.T @ (features * weight)
    penalty = RIDGE * len(rows) * np.eye(len(gram)) / len(gram)
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(gram + penalty, features.T @ (wanted * weight))
    return Model(languages, columns, marks, np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out: of each language those of smallest hash of id and text.

    At most ROWS_PER_LANGUAGE rows of a language and ROWS of all (but one of each language). Rows with a null id,
    language or text, or a text without a letter, are not learned from; rows equal in id and text count once. Whole texts become
    n-gram numbers on the executors; the driver gets those (2^BITS at most a row), no text.
    """
    known = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    usable = docs.where(~held_out(id_col) & known).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    sample = usable.select("lang", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= ROWS_PER_LANGUAGE)
    sample = materialise(sample)
    languages = sample.where("n = 1").count()
    wanted = sample.where(F.col("n") <= max(1, ROWS // max(1, languages))).select("lang", "h")
    rows = usable.join(F.broadcast(wanted), ["lang", "h"], "left_semi").select("h", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = []
            for t in batch.column(2).to_pylist():
                presence, lettered = ngrams([t])
                numbers.append(np.flatnonzero(presence[0]).astype(np.int32).tobytes() if lettered[0] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.binary())], ["h", "lang", "numbers"])

    each = rows.mapInArrow(run, "h bigint, lang string, numbers binary").where("numbers is not null").groupBy("h", "lang").agg(F.min("numbers").alias("numbers"))
    found = sorted((r[0], r[1], bytes(r[2])) for r in each.collect())
    if not found:
        return Model([], np.zeros(0, int), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32))
    return fit([(lang, np.frombuffer(n, np.int32)) for _, lang, n in found])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with lang_pred (string) and score (double, 0 to 1: the best language's output, cut off at both).

    A text that is null, empty or has no letter is `und` with score 0, as is any where nothing could be learned.
    Ties go to the language that sorts first; repeated rows come out each. An empty table gives an empty one. Whole texts count, however long; equal texts get equal results.
    """
    names = others(docs, "lang_pred", "score") if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(*(F.col(n).alias(f"k{i}") for i, n in enumerate(names)), F.col(text_col).alias("__text"))
    at_text = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at_text).to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), 64):
                presence, lettered = ngrams(texts[at : at + 64])
                if model.languages:
                    s = model.scores(presence)
                    best = s.argmax(axis=1)
                    for i in np.flatnonzero(lettered).tolist():
                        lang[at + i], score[at + i] = model.languages[best[i]], min(1.0, max(0.0, float(s[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_text], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "lang_pred string", "score double"]))
