"""A dictionary analyzer: runs of letters become the cheapest path through a lattice of known words.

Costs come from a corpus' own words: rare words cost more, and a run that is rare itself splits into the frequent words it
is made of. Words of a user dictionary cost nothing, so they stay whole. What no word covers is a piece of its own, at a
cost by letter. Synonyms widen questions, never documents. The lexicon goes to the tasks, its most frequent WORDS at most; the
rest count as unknown.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks get these functions with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 100_000
#: Costs are whole numbers, a thousandth of a natural logarithm each, so that sums don't depend on their order.
UNIT, UNKNOWN, LETTER = 1000, 12_000, 2_000
#: Longer runs stand whole.
LONGEST = 64
RUN = "[a-zà-ÿß가-힣]+"
Lexicon = dict[str, int]


def lexicon(texts: DataFrame, text: str, words: int = WORDS, pattern: str = RUN) -> DataFrame:
    """(word, cost) of the most frequent words, ties by word: minus the logarithm of a word's share of all."""
    each = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    few = counts.orderBy(F.desc("n"), "word").limit(words).crossJoin(F.broadcast(total))  # one row
    return few.select("word", F.round(-F.log(F.col("n") / F.col("total")) * UNIT).cast("int").alias("cost"))


def pieces(run: str, known: Lexicon) -> list[str]:
    """The cheapest pieces of a run; of equal cost the fewest, then the longest first ones."""
    n = len(run)
    if n > LONGEST:
        return [run]
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # cost, pieces and, last, minus the length of the first piece
    for i in range(n - 1, -1, -1):
        found = []
        for j in range(i + 1, n + 1):
            cost = known.get(run[i:j], UNKNOWN + LETTER * (j - i))
            found.append((cost + best[j][0], 1 + best[j][1], i - j))
        best[i] = min(found)
    out, i = [], 0
    while i < n:
        out.append(run[i : i - best[i][2]])
        i -= best[i][2]
    return out


def analyzer(words: DataFrame, user: Iterable[str] = (), synonyms: Iterable[Iterable[str]] = (), pattern: str = RUN) -> Callable[[Column], Column]:
    """A column function from texts to arrays of terms; ``words`` has word and cost, WORDS rows at most.

    A null text has no terms. With synonyms every term brings the others of its groups, for questions.
    """
    rows = words.limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"a lexicon has {WORDS} words at most")
    known = {r["word"]: r["cost"] for r in rows} | {w.lower(): 0 for w in user}
    groups: dict[str, set[str]] = {}
    for group in synonyms:
        for w in (own := {x.lower() for x in group}):
            groups.setdefault(w, set()).update(own)
    sent = words.sparkSession.sparkContext.broadcast((known, {w: sorted(o) for w, o in groups.items()}))

    @F.pandas_udf("array<string>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, groups = sent.value
        find, held = re.compile(pattern).findall, {}

        def of(run: str) -> list[str]:
            if run not in held:
                if len(held) > WORDS:
                    held.clear()
                held[run] = [x for p in pieces(run, known) for x in ([p] if p not in groups else groups[p])]
            return held[run]

        for texts in batches:
            yield pd.Series([[] if t is None else [p for run in find(t.lower()) for p in of(run)] for t in texts])

    return terms
