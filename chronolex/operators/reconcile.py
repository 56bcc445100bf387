"""Stored against recomputed rows, late scans, regions on pages, samples, batches, word differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Cells of the table that a word difference fills at once; longer pairs are halved first, so there is no bound on them.
CELLS = 400_000


def row_set_changes(stored: DataFrame, recomputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, missing, extra) of the keys whose rows differ as multisets: one aggregation of both sides, nulls equal."""
    tag = lambda d, n: d.select(key, *columns, F.lit(n).alias("_n"))
    net = tag(stored, 1).unionByName(tag(recomputed, -1)).groupBy(key, *columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return net.groupBy(key).agg(F.sum(F.greatest("_n", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("extra"))


def overlap_scan(rows: DataFrame, seen: DataFrame, key: str, day: str, overlap: int) -> DataFrame:
    """Rows not seen yet, looked for from so many days before the newest seen day; all rows if nothing was seen.

    The newest day is one value; as a literal it reaches the scan as a filter.
    """
    since = seen.agg(F.date_sub(F.max(day), overlap).cast("timestamp")).first()[0]
    recent = rows if since is None else rows.filter(F.col(day) >= F.lit(since))
    return recent.join(seen.select(key), key, "left_anti")


def outdated(owners: DataFrame, versions: DataFrame, cells: DataFrame, owner: str, created: str, extracted: str) -> DataFrame:
    """Owners without cells, or with a version newer than their oldest cell: the ones to compute again."""
    newest = versions.groupBy(owner).agg(F.max(created).alias("_newest"))
    oldest = cells.groupBy(owner).agg(F.min(extracted).alias("_oldest"))
    j = owners.select(owner).join(newest, owner, "left").join(oldest, owner, "left")
    return j.filter(F.col("_oldest").isNull() | (F.col("_newest") > F.col("_oldest"))).select(owner)


def assign_regions(items: DataFrame, regions: DataFrame, page: list[str], centre: str, top: str, bottom: str, first: Column, item: list[str]) -> DataFrame:
    """The first region of its page in whose span the centre of an item lies; the join is on the page, and few regions share one."""
    hit = items.join(regions, page).filter(F.col(centre).between(F.col(top), F.col(bottom)))
    return hit.groupBy(*page, *item, centre).agg(F.min(first).alias("region"))


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by hashed key: any run and any partitioning give the same ones. Each task passes on n at most."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def batches(events: DataFrame, by: list[str], key: str, at: str) -> DataFrame:
    """One row per group of pending events: how many, the first and last moment, a digest of the members."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.sum(key).alias("key_sum"))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest common subsequences of x with each prefix of y, from the empty one on, in two rows of memory."""
    row = np.zeros(len(y) + 1, np.int32)
    for word in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == word)))
    return row


def _leaves(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of x and y, in order, whose longest common subsequences make up that of the whole, of CELLS cells at most (Hirschberg's halving)."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if b - a < 2 or (b - a) * (d - c) <= CELLS:
            yield a, b, c, d
            continue
        half = (a + b) // 2
        cut = c + int(np.argmax(_common(x[a:half], y[c:d]) + _common(x[half:b][::-1], y[c:d][::-1])[::-1]))
        todo += [(half, b, cut, d), (a, half, c, cut)]


def _operations(before: str | None, after: str | None) -> list[tuple[str, str]]:
    a, b = (before or "").split(), (after or "").split()
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([codes[w] for w in s], dtype=np.int64) for s in (a, b))
    out: list[tuple[str, list[str]]] = []
    for a0, a1, b0, b1 in _leaves(x, y):
        for op, word in _steps(a[a0:a1], b[b0:b1], x[a0:a1], y[b0:b1]):
            if out and out[-1][0] == op:
                out[-1][1].append(word)
            else:
                out.append((op, [word]))
    return [(o, " ".join(w)) for o, w in out]


def _steps(a: list[str], b: list[str], x: np.ndarray, y: np.ndarray) -> Iterator[tuple[str, str]]:
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)  # common words of the rests from i and j on
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (y == x[i]))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            yield "=", a[i]
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1, j] >= best[i, j + 1]):
            yield "-", a[i]
            i += 1
        else:
            yield "+", b[j]
            j += 1


@F.pandas_udf(ArrayType(StructType().add("op", StringType()).add("words", StringType())))
def word_diff(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Runs of kept (=), gone (-) and new (+) words between two texts, by longest common subsequence."""
    for before, after in pairs:
        yield pd.Series([[{"op": o, "words": w} for o, w in _operations(x, y)] for x, y in zip(before, after, strict=True)])


def applied(operations: Column, without: str) -> Column:
    """One of the two texts from the operations, white space aside: ``+`` left out gives the old one, ``-`` the new one."""
    return F.array_join(F.transform(F.filter(operations, lambda o: o["op"] != without), lambda o: o["words"]), " ")


def counted(operations: Column) -> dict[str, Column]:
    words = lambda s: F.aggregate(F.filter(operations, lambda o: o["op"] == s), F.lit(0), lambda n, o: n + F.size(F.split(o["words"], " ")))
    return {"kept": words("="), "gone": words("-"), "come": words("+")}

