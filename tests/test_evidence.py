"""Quotes, deadlines, value changes, word differences and reconciliation on small rows."""

import itertools
import random

from pyspark.sql import functions as F

from chronolex.functions import evidence as E
from chronolex.operators import diff as D
from chronolex.operators import graph as G
from chronolex.operators import reconcile as R
from chronolex.operators import retrieval as RT


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_quotes_are_found_but_for_white_space(spark):
    span = E.quote_span(F.col("q"), F.col("t"))
    assert tuple(one(spark, span, q="b\\E(c) .*d", t="a 😀 b\\E\n(c).* d e")) == (4, 15)
    assert one(spark, span, q="bd", t="b c d") is None
    assert one(spark, span, q=" \n", t="b") is None and one(spark, span, q=None, t="b") is None and one(spark, span, q="b", t=None) is None


def test_value_change(spark):
    change = E.value_change(F.col("a"), F.col("b"))
    assert one(spark, change, a="in 3 days at 5 %", b="in 7 days at 5 %") == "3 days → 7 days"
    assert one(spark, change, a="in 3 days at 5 %", b="in 7 days at 6 %") is None
    assert one(spark, change, a="in 3 days", b="in 3 days") is None and one(spark, change, a=None, b="3 days") is None


def test_deadlines(spark):
    verdict = lambda days, text: one(spark, E.deadline_verdict(F.lit(days), F.col("t")), t=text)
    assert verdict(14, "in 2 weeks") == "met" and verdict(15, "in 2 weeks") == "missed"
    assert [verdict(d, "in 2 months") for d in (56, 57, 62, 63)] == ["met", "conditional", "conditional", "missed"]
    assert verdict(1, "in 2 days or 1 month") is None and verdict(1, "soon") is None and verdict(None, "2 days") is None
    assert verdict(14, "14 days, that is 2 weeks") == "met"


def test_notes(spark):
    assert tuple(one(spark, E.split_notes(F.col("t")), t="a <New 1> b<Amended x>  <c>")) == ("a b <c>", ["<New 1>", "<Amended x>"])


def common(a, b):
    return max((len(s) for n in range(len(a) + 1) for s in itertools.combinations(a, n) if subsequence(s, b)), default=0)


def subsequence(s, b):
    it = iter(b)
    return all(x in it for x in s)


def test_word_difference_keeps_the_longest_common_words(spark):
    rng = random.Random(2)
    pairs = [tuple(" ".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2)) for _ in range(40)] + [(None, "a b"), ("a", None), (None, None)]
    d = spark.createDataFrame(pairs, "a string, b string").withColumn("o", R.word_diff("a", "b"))
    for r in d.select("a", "b", R.applied(F.col("o"), "+").alias("old"), R.applied(F.col("o"), "-").alias("new"), R.counted(F.col("o"))["kept"].alias("kept")).collect():
        assert (r.old, r.new) == (r.a or "", r.b or "")
        assert r.kept == common((r.a or "").split(), (r.b or "").split())


def test_long_texts_are_compared_word_by_word():
    same = R._operations("a " * 700, "a " * 600)
    assert [sum(len(w.split()) for o, w in same if o == k) for k in "=-+"] == [600, 100, 0]
    rng = random.Random(3)
    old = [rng.choice("abcdefgh") for _ in range(1500)]
    new = [w if rng.random() < 0.8 else rng.choice("xyz") for w in old if rng.random() < 0.9]
    out = R._operations(" ".join(old), " ".join(new))
    words = lambda *ops: [w for o, t in out if o in ops for w in t.split()]
    row = [0] * (len(new) + 1)
    for w in old:
        last = 0
        for k, v in enumerate(new, 1):
            last, row[k] = row[k], last + 1 if v == w else max(row[k], row[k - 1])
    assert words("=", "-") == old and words("=", "+") == new and len(words("=")) == row[-1]


def test_row_sets_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert sorted(map(tuple, R.row_set_changes(a, b, "k", ["v"]).collect())) == [(1, 1, 0), (3, 1, 1)]


def test_scan_of_everything_if_nothing_was_seen(spark):
    o = spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01' AS d UNION ALL SELECT 2, TIMESTAMP '2024-01-20'")
    assert R.overlap_scan(o, o.limit(0), "k", "d", 7).count() == 2
    assert [r.k for r in R.overlap_scan(o.union(o.selectExpr("3", "d - INTERVAL 3 DAY")), o, "k", "d", 7).collect()] == [3]


def test_moved_parts_match_first_come_first_served(spark):
    part = "version int, ord int, path string, hash string, heading string, notes string"
    rows = [(1, 1, "a1", "h", "x", ""), (1, 2, "a2", "h", "x", ""), (1, 3, "a3", "k", "x", ""), (1, 4, "a4", None, "x", ""), (1, 5, "a5", "s", "x", "n"),
            (2, 1, "b1", "h", "x", ""), (2, 2, "b2", "k", "x", ""), (2, 3, "b3", None, "x", ""), (2, 4, "a5", "s", "x", "m")]
    pairs = spark.createDataFrame([(7, 1, 2)], "key int, prev int, version int")
    got = D.sequential(spark.createDataFrame(rows, part), pairs, "key", F.col("path") != "a3").collect()
    want = [("a1", "b1", "RENUMBERED"), ("a2", None, "DELETED"), ("a3", None, "DELETED"), (None, "b2", "ADDED"), ("a4", None, "DELETED"), (None, "b3", "ADDED"), ("a5", "a5", "ANNOTATION_ONLY")]
    assert sorted((tuple(r)[3:] for r in got), key=str) == sorted(want, key=str)


def test_expansion_keeps_fewest_hops_and_best_priority(spark):
    e = spark.createDataFrame([("a", "b", 5), ("a", "b", -2), ("b", "c", 1), ("a", "c", 9), ("c", "a", 1), ("c", "d", 3), ("b", "d", 4)], "src string, dst string, p int")
    seeds = spark.createDataFrame([("s", "a")], "seed string, node string")
    assert sorted(map(tuple, G.expand(e, seeds, 2, "p").collect())) == [("s", "b", 1, -2), ("s", "c", 1, 9), ("s", "d", 2, 3)]


def test_nearest_with_awkward_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [1.0, 1.0])], "id int, v array<float>")
    q = spark.createDataFrame([("x", [3.0, 0.0]), ("n", None)], "q string, w array<float>")
    got = RT.nearest(v, q, "q", "w", "id", "v", 3)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("x", 1, 1.0, 1), ("x", 5, 1.0, 2), ("x", 6, 0.707107, 3)]
    assert RT.nearest(v, q.limit(0), "q", "w", "id", "v", 3).count() == 0


def test_sketched_counts_are_near_exact_ones(spark):
    from chronolex.plans import evidence

    got = {r.o_orderpriority: r.owners for r in evidence.approx_distinct_facets(spark, "/root/testdata/sf0.01").collect()}
    exact = {r.bucket: r.owners for r in evidence.distinct_by_bucket(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) <= 0.08 * exact[k] for k in exact)
