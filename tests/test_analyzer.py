"""Segmentation against all ways to cut a run; keyword hits with an analyzer against the plain loop."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from chronolex.operators import analyzer as A
from chronolex.operators import keywords as K

from .test_keywords import plain


def brute(run, known):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        parts, last = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(run[last:k])
                last = k
        cost = sum(known.get(p, A.UNKNOWN + A.LETTER * len(p)) for p in parts)
        key = (cost, len(parts), [-len(p) for p in parts])
        best = min(best, (key, parts)) if best else (key, parts)
    return best[1]


def test_all_ways_to_cut():
    r = random.Random(6)
    for _ in range(150):
        known = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): r.randint(1, 9000) for _ in range(15)}
        run = "".join(r.choice("abcd") for _ in range(r.randint(1, 10)))
        assert A.pieces(run, known) == brute(run, known)
    assert A.pieces("x" * 65, {"x": 1}) == ["x" * 65]


def test_lexicon_and_terms(spark):
    texts = spark.createDataFrame([("rain rain coat Coat rain",), (None,), ("raincoat 12",)], "t string")
    words = A.lexicon(texts, "t")
    want = {w: round(-math.log(n / 6) * 1000) for w, n in (("rain", 3), ("coat", 2), ("raincoat", 1))}
    assert {r["word"]: r["cost"] for r in words.collect()} == want
    assert {r["word"] for r in A.lexicon(texts, "t", words=2).collect()} == {"rain", "coat"}
    d = spark.createDataFrame([("Raincoat coatrain",), (None,), ("zz-12",)], "t string")
    got = lambda f: [r["x"] for r in d.select(f(F.col("t")).alias("x")).collect()]
    assert got(A.analyzer(words)) == [["raincoat", "coat", "rain"], [], ["zz"]]  # 693 + 1099 against 1792: of equal cost the fewest pieces
    assert got(A.analyzer(words, user=["coatrain"])) == [["raincoat", "coatrain"], [], ["zz"]]
    assert got(A.analyzer(words, synonyms=[("coat", "cape")])) == [["raincoat", "cape", "coat", "rain"], [], ["zz"]]


def test_hits_by_analyzed_terms(spark):
    docs = [(1, "redbolt red", ""), (2, "blue bolt", ""), (3, "bluered", ""), (4, None, "")]
    asks = [(10, "red bolt"), (11, "blue")]
    lexicon = spark.createDataFrame([("red", 100), ("bolt", 100), ("blue", 100)], "word string, cost int")
    split = A.analyzer(lexicon)
    cut = lambda t: re.sub("(red|bolt|blue)", r"\1 ", t) if t else t
    want = plain([(d, cut(t), x) for d, t, x in docs], asks, [1.0], 3)
    got = K.best_hits(spark.createDataFrame(docs, "d long, t string, x string"), spark.createDataFrame(asks, "q long, t string"), "d", "q", "t", 3, {"t": 1.0}, tokenizer=split)
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: (x[0], x[4])) == want
    wide = K.best_hits(spark.createDataFrame(docs, "d long, t string, x string"), spark.createDataFrame([(12, "navy")], "q long, t string"), "d", "q", "t", 3, {"t": 1.0}, tokenizer=split, ask_tokenizer=A.analyzer(lexicon, user=["navy"], synonyms=[("navy", "blue")]))
    assert sorted(r["d"] for r in wide.collect()) == [2, 3]
