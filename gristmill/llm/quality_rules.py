"""Quality by weak supervision, in DataFrame functions alone.

Rules look at counts of a text and vote bad, vote good, or abstain. How far each rule is to be believed is not given:
expectation-maximisation over the unlabelled votes of all documents estimates, for each rule and class, how often it
votes what (two latent classes, votes independent given the class), and the posterior probability of `good` decides.
Without a prior the classes may drift to any split of the votes, such as texts with and without repeated lines; so the
first assignment (a vote for bad makes a document bad, most likely) stays as the prior counts of every round.

Votes are counted by pattern; there are at most 3^RULES patterns (729), so what the driver iterates on has a fixed
size however many documents there are. Posteriors go back as a literal array that the pattern's number indexes.
Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import WORD_RE, WS, materialise, others

#: Name, condition of a vote for bad, condition of a vote for good; whole numbers only, so that SQL engines agree.
RULES = [
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("repeats", "100 * n_repeat_words > 10 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("lines", "4 * n_dup_lines > n_lines", "8 * n_dup_lines <= n_lines"),
    ("capitals", "2 * n_capitals > word_chars", "8 * n_capitals <= word_chars"),
    ("exclamations", "4 * n_exclamations > n_words", "20 * n_exclamations <= n_words"),
    ("length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars >= 3 * n_words and word_chars <= 11 * n_words"),
]
#: Rounds of the estimate; probability of good to begin with, without and with a vote for bad; weight of the beginning as
#: the prior of all rounds (with 1 the distance to the fixed point halves at least in each); added to every count.
ROUNDS, NO_BAD, SOME_BAD, ANCHOR, SMOOTH = 25, 0.9, 0.05, 1.0, 0.01
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once for a row although lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = 5) -> Column:
    """The number of words in windows of `size` words that are found twice or more in the row's words."""

    def covered(sorted_: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            near = lambda j: F.coalesce(F.get(sorted_, j)["h"] == x["h"], F.lit(False))
            return near(i - 1) | near(i + 1)

        starts = F.array_sort(F.transform(F.filter(sorted_, twice), lambda x: x["i"]))
        # each start covers `size` words, or those up to the next start
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(s, i + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
        pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs(h), covered)))
        return F.when(F.size(w) < size + 1, F.lit(0)).otherwise(some)

    return let(words, count)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that the rules use (long). A null text has no words and no lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(WS)) != "")
    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    both = let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeats")))
    out = docs.withColumns({"__w": both, "__l": let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))})
    out = out.withColumns({"n_words": F.col("__w.n").cast("long"), "word_chars": F.col("__w.chars").cast("long"), "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"), "n_dup_lines": F.col("__l.dup").cast("long"), "n_repeat_words": F.col("__w.repeats").cast("long"),
                           "n_lines": F.col("__l.n").cast("long"), "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"), "n_exclamations": F.regexp_count(text, F.lit("!")).cast("long")})
    return out.drop("__w", "__l")


def pattern() -> Column:
    """The votes as one number in base 3: 1 bad, 2 good, 0 abstains."""
    return F.expr(" + ".join(f"{3**k} * (case when {bad} then 1 when {good} then 2 else 0 end)" for k, (_, bad, good) in enumerate(RULES)))


def estimate(found: dict[int, int]) -> tuple[dict[int, float], list]:
    """Posterior probability of `good` by pattern, and for each rule P(vote | bad, not abstaining), P(vote | good, not abstaining); abstaining says nothing."""
    votes = {p: [p // 3**k % 3 for k in range(len(RULES))] for p in found}
    first = {p: SOME_BAD if 1 in v else NO_BAD for p, v in votes.items()}

    def masses(post: dict[int, float]) -> tuple[list[float], list[list[list[float]]]]:
        """Documents by class, and by rule, class and vote."""
        of = lambda p, c: post[p] if c else 1 - post[p]
        by_vote = [[[sum(n * of(p, c) for p, n in found.items() if votes[p][k] == v) for v in range(3)] for c in (0, 1)] for k in range(len(RULES))]
        return [sum(n * of(p, c) for p, n in found.items()) for c in (0, 1)], by_vote

    prior, prior_votes = masses(first)
    post, likely = first, []
    for _ in range(ROUNDS):
        now, now_votes = masses(post)
        size = [ANCHOR * prior[c] + now[c] for c in (0, 1)]
        seen = [[[SMOOTH + ANCHOR * prior_votes[k][c][v] + now_votes[k][c][v] for v in (1, 2)] for c in (0, 1)] for k in range(len(RULES))]
        likely = [[[1.0, bad / (bad + good), good / (bad + good)] for bad, good in rule] for rule in seen]
        share = (size[1] + SMOOTH) / (sum(size) + 2 * SMOOTH)
        post = {}
        for p, v in votes.items():
            g, b = share, 1 - share
            for k, vote in enumerate(v):
                g *= likely[k][1][vote]
                b *= likely[k][0][vote]
            post[p] = g / (g + b)
    return post, likely


def judge(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_posterior: float = 0.5) -> DataFrame:
    """The columns `keep` (default: all) with the counts, base_failed, posterior (double) and kept.

    base_failed: under 10 words, or over a fifth of them in repeated windows of five. Such a document is not kept and
    has no part in the estimate. Null and empty texts have no words and fail; whole texts count, however long. Documents with equal votes, repeated
    rows among them, get equal posteriors. An empty table gives an empty one. Added columns replace those of their names.
    """
    rows = counts(docs, text_col).withColumns({"base_failed": F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"), "__pattern": pattern()})
    names = others(docs, *COUNTS, "base_failed", "posterior", "kept") if keep is None else keep
    rows = materialise(rows.select(*names, *COUNTS, "base_failed", "__pattern"))
    found = {r[0]: r[1] for r in rows.where("not base_failed").groupBy("__pattern").count().collect()}
    post, _ = estimate(found)
    table = F.array(*(F.lit(post.get(p, 0.0)) for p in range(3 ** len(RULES))))
    posterior = F.get(table, F.col("__pattern"))
    return rows.select(*names, *COUNTS, "base_failed", posterior.alias("posterior"), (~F.col("base_failed") & (posterior >= min_posterior)).alias("kept"))


def judge_sql() -> str:
    """judge() over documents in DuckDB's SQL, the rounds of the estimate one after another."""
    k = range(len(RULES))
    votes = ", ".join(f"CASE WHEN {bad} THEN 1 WHEN {good} THEN 2 ELSE 0 END AS v{i}" for i, (_, bad, good) in enumerate(RULES))
    names = ", ".join(f"v{i}" for i in k)
    sides = ((0, "(1 - post)"), (1, "post"))
    total = ", ".join(f"coalesce(sum(n * {w}), 0) AS t{c}" for c, w in sides)
    sums = ", ".join(f"coalesce(sum(n * {w}) FILTER (v{i} = {v}), 0) AS s{i}{c}{v}" for i in k for c, w in sides for v in (1, 2))
    steps = [f"p0 AS (SELECT *, CASE WHEN 1 IN ({names}) THEN {SOME_BAD}e0 ELSE {NO_BAD}e0 END AS post FROM patterns)", f"b AS (SELECT {total}, {sums} FROM p0)"]
    for r in range(1, ROUNDS + 1):
        seen = lambda i, c, v: f"({SMOOTH}e0 + {ANCHOR}e0 * b.s{i}{c}{v} + u.s{i}{c}{v})"
        rates = ", ".join(f"{seen(i, c, v)} / ({seen(i, c, 1)} + {seen(i, c, 2)}) AS l{i}{c}{v}" for i in k for c in (0, 1) for v in (1, 2))
        share = f"({ANCHOR}e0 * b.t1 + u.t1 + {SMOOTH}e0) / ({ANCHOR}e0 * (b.t0 + b.t1) + u.t0 + u.t1 + 2 * {SMOOTH}e0) AS share"
        steps.append(f"m{r} AS (SELECT {share}, {rates} FROM b, (SELECT {total}, {sums} FROM p{r - 1}) u)")
        like = lambda c: " * ".join(f"(CASE v{i} WHEN 0 THEN 1e0 WHEN 1 THEN l{i}{c}1 ELSE l{i}{c}2 END)" for i in k)
        steps.append(f"g{r} AS (SELECT {names}, n, share * {like(1)} AS good, (1 - share) * {like(0)} AS bad FROM p{r - 1}, m{r})")
        steps.append(f"p{r} AS MATERIALIZED (SELECT {names}, n, good / (good + bad) AS post FROM g{r})")
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS "at", ws FROM w WHERE len(ws) >= 5),
marked AS (SELECT doc_id, "at", count(*) OVER (PARTITION BY doc_id, array_to_string(ws["at":"at" + 4], ' ')) AS n FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range("at", "at" + 5)) AS pos FROM marked WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations
  FROM w JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {votes} FROM c),
patterns AS (SELECT {names}, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY {names}),
{", ".join(steps)}
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND coalesce(post, 0) >= 0.5 AS kept FROM v LEFT JOIN p{ROUNDS} USING ({names})
"""
