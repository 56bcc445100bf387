"""Quality rules under weak supervision (native: DataFrame functions only).

Each rule votes good (1) or bad (0) on a document or abstains (null). Expectation-maximisation over
the counts of vote patterns, which sum up all documents, estimates how each rule speaks about good and
about bad documents; a document is kept if its posterior probability of being good is at
least 0.5. There are 3 ** rules patterns at most, whatever the number of documents, so the counts are
the only thing that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import BLANKS, SYMBOLS, bind, cut, without, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 40
PRIOR_GOOD = 0.8
#: The first belief about a rule keeps the weight of so many documents.
PSEUDO = 5.0


def repeat_words(ws: Column) -> Column:
    """Words in 8-word windows found twice or more in the text.

    Windows are compared by 64-bit hash. Texts without a double, found by a hash set, stop there; in
    others (hash, position) pairs are sorted so that doubles are neighbours: n log n for any length.
    """
    hashes = F.when(
        F.size(ws) >= WINDOW,
        bind(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def doubles(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return bind(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x["i"])))

    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
    )
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(doubles(h), covered))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, over whole texts (null: none)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", t.alias("text"), words(t).alias("ws"))
    bare = without(F.col("text"), BLANKS)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return d.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("ws")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("!")))).cast("long").alias("n_marks"),
        F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"),
        F.size(F.filter("ws", lambda w: F.char_length(w) <= 3)).cast("long").alias("n_short"),
        bind(F.col("ws"), lambda x: F.size(F.filter(x, lambda w, i: F.coalesce(F.get(x, i + 1) == w, F.lit(False))))).cast("long").alias("n_stutter"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, 0).cast("int")


def votes() -> dict[str, Column]:
    """The rules over the columns of ``measures``. Most can only speak against a document, "prose" only for it."""
    n, some, long = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_words") > 0, F.col("n_words") >= MIN_WORDS
    rate = lambda c: F.col(c) / n
    never = F.lit(False)
    plain = (rate("n_symbols") < 0.05) & (rate("n_marks") < 0.05) & (F.col("n_upper") < 0.3 * F.col("word_chars")) & (rate("n_stutter") < 0.1)
    return {
        "length": _vote(never, ~long),
        "word_length": _vote(some & rate("word_chars").between(3, 8), some & ((rate("word_chars") < 2) | (rate("word_chars") > 12))),
        "symbols": _vote(never, rate("n_symbols") > 0.1),
        "repeats": _vote(never, rate("n_repeat_words") > 0.28),
        "stutter": _vote(never, rate("n_stutter") > 0.2),
        "dup_lines": _vote(never, F.col("n_dup_lines") > 0.05 * F.col("n_words")),
        "upper": _vote(never, F.col("n_upper") > 0.4 * F.col("word_chars")),
        "marks": _vote(never, rate("n_marks") > 0.2),
        "variety": _vote(never, long & (F.col("n_distinct") < 0.25 * F.least(n, F.lit(2000)))),
        "function_words": _vote(rate("n_short") > 0.1, long & (rate("n_short") < 0.02)),
        "prose": _vote(some & plain, never),
    }


#: Outcomes of a rule, and how likely they are of a good and of a bad document before anything is seen.
OUTCOMES = (1, 0, None)
START = {True: (0.45, 0.05, 0.5), False: (0.15, 0.35, 0.5)}


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rules: int) -> tuple[float, list[dict]]:
    """EM over (pattern, count): the share of good documents and, per rule, {outcome: (P(. | good), P(. | bad))}.

    Abstaining is an outcome with a probability of its own, as most rules only ever speak against.
    """
    prior = PRIOR_GOOD
    start = {v: (START[True][k], START[False][k]) for k, v in enumerate(OUTCOMES)}
    odds = [dict(start) for _ in range(rules)]
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        good, bad = 0.0, 0.0
        seen = [{v: [PSEUDO * start[v][0], PSEUDO * start[v][1]] for v in OUTCOMES} for _ in range(rules)]
        for pattern, n in patterns:
            p = n * posterior(pattern, prior, odds)
            good, bad = good + p, bad + n - p
            for j, v in enumerate(pattern):
                seen[j][v][0] += p
                seen[j][v][1] += n - p
        prior = (good + PSEUDO * PRIOR_GOOD) / (total + PSEUDO)
        odds = [{v: (g / (good + PSEUDO), b / (bad + PSEUDO)) for v, (g, b) in s.items()} for s in seen]
    return prior, odds


def posterior(pattern: tuple[int | None, ...], prior: float, odds: list[dict]) -> float:
    x = math.log(prior / (1 - prior)) + sum(math.log(o[v][0] / o[v][1]) for v, o in zip(pattern, odds, strict=True))
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, p_good and kept per document.

    Null and empty texts have no words and fail the base. Nulls in other columns, repeated rows and
    extra columns change nothing: every row is judged by its text. An empty table gives no rows.
    """
    rules = votes()
    d = cut(measures(docs).withColumns(rules))
    patterns = [(tuple(r[k] for k in rules), r["n"]) for r in d.groupBy(*rules).agg(F.count("*").alias("n")).collect()]
    prior, odds = fit(sorted(patterns, key=str), len(rules))
    x = F.lit(math.log(prior / (1 - prior)))
    for k, o in zip(rules, odds, strict=True):
        ratio = {v: math.log(g / b) for v, (g, b) in o.items()}
        x += F.when(F.col(k) == 1, ratio[1]).when(F.col(k) == 0, ratio[0]).otherwise(ratio[None])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-x)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query, with p_good besides; nulls, empty and long texts, repeated rows and empty tables as in ``judge``."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
