"""The stretch of a text that shows the most of the asked terms, and the marks in it."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks get these functions with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = "[a-zà-ÿß]+"
WINDOW = "struct<first:int,last:int,covered:int,start:int,end:int,spans:array<struct<start:int,end:int>>>"


def best_window(hits: list[tuple[int, str]], width: int) -> tuple[int, int, int] | None:
    """(first, last, covered) of hits (place, term) in order: the most terms within ``width`` places, then the shortest, then the first.

    Two pointers: the left one moves on when the window is too wide, or as long as its term stands in the window again.
    """
    best, count, left = None, {}, 0
    for right, (place, term) in enumerate(hits):
        count[term] = count.get(term, 0) + 1
        while place - hits[left][0] >= width or count[hits[left][1]] > 1:
            out = hits[left][1]
            count[out] -= 1
            if not count[out]:
                del count[out]
            left += 1
        key = (-len(count), place - hits[left][0], hits[left][0])
        if best is None or key < best[0]:
            best = key, left, right
    return best and (best[1], best[2], -best[0][0])


def shown(text: str | None, terms: list[str] | None, width: int, pattern: re.Pattern) -> dict | None:
    if not text or not terms:
        return None
    asked, hits, at = {t.lower() for t in terms if t}, [], []
    for place, m in enumerate(pattern.finditer(text.lower()) if len(text.lower()) == len(text) else pattern.finditer(text)):
        if m[0].lower() in asked:
            hits.append((place, m[0].lower()))
            at.append(m.span())
    found = best_window(hits, width)
    if found is None:
        return None
    left, right, covered = found
    spans = [{"start": a, "end": b} for a, b in at[left : right + 1]]
    return {"first": hits[left][0], "last": hits[right][0], "covered": covered, "start": at[left][0], "end": at[right][1], "spans": spans}


def highlight_window(text: Column, terms: Column, width: int, pattern: str = WORD) -> Column:
    """struct(first, last, covered, start, end, spans) of the best stretch of ``width`` words: word numbers from 0, how many of the terms it has,
    its code points from 0, and those of the hits in it. Null without a hit. Terms are words in any case."""

    @F.pandas_udf(WINDOW)
    def windows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = re.compile(pattern)
        for texts, asked in batches:
            rows = [shown(t, None if a is None else list(a), width, words) for t, a in zip(texts, asked, strict=True)]
            names = ["first", "last", "covered", "start", "end", "spans"]
            frame = pd.DataFrame({n: [r[n] if r else None for r in rows] for n in names})
            yield frame.astype({n: "Int32" for n in names[:-1]})

    found = windows(text, terms)
    return found


def marked(text: Column, window: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The stretch as it stands in the text, with its hits marked."""
    spans = window["spans"]
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    parts = F.transform(spans, lambda s, k: F.concat(piece(F.coalesce(F.get(spans, k - 1)["end"], window["start"]), s["start"]), F.lit(before), piece(s["start"], s["end"]), F.lit(after)))
    return F.when(window["first"].isNotNull(), F.array_join(parts, ""))
