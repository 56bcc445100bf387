"""The best stretch of hits against all stretches."""

import random

from pyspark.sql import functions as F

from chronolex.functions import highlights as H


def brute(hits, width):
    best = None
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            if hits[j][0] - hits[i][0] < width:
                key = (-len({t for _, t in hits[i : j + 1]}), hits[j][0] - hits[i][0], hits[i][0])
                best = min(best, (key, i, j)) if best else (key, i, j)
    return best and (best[1], best[2], -best[0][0])


def test_all_stretches():
    r = random.Random(5)
    for _ in range(400):
        places = sorted(r.sample(range(40), r.randint(0, 14)))
        hits = [(p, r.choice("abcd")) for p in places]
        for width in (1, 5, 100):
            assert H.best_window(hits, width) == brute(hits, width)


def test_marks(spark):
    d = spark.createDataFrame([("A dog, a Cat; and far far far away the bird saw cat and dog.", ["DOG", "cat", "bird", None]), ("none", ["dog"]), (None, ["dog"]), ("dog", None), ("", [])], "t string, q array<string>")
    got = d.select("t", H.highlight_window(F.col("t"), F.col("q"), 6).alias("w")).select("w", H.marked(F.col("t"), F.col("w")).alias("m")).collect()
    assert got[0]["m"] == "<mark>bird</mark> saw <mark>cat</mark> and <mark>dog</mark>" and (got[0]["w"]["first"], got[0]["w"]["last"], got[0]["w"]["covered"]) == (10, 14, 3)
    assert [r["m"] for r in got[1:]] == [None] * 4
