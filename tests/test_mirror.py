"""Mirrored statutes, anchors, page regions, safe markup and checks of values on awkward rows."""

import pytest
from pyspark.sql import functions as F

from chronolex.functions import evidence as E
from chronolex.functions import text as X
from chronolex.operators import mirror as M
from chronolex.sources import bodies as B

STORED = "law string, path string, id long, hash string, deleted boolean, version int, gone_in int"
ARRIVING = "law string, version int, ord int, path string, hash string, deleted boolean"


def test_articles_after_a_version(spark):
    stored = spark.createDataFrame([("a", "a1", 1, "x", False, 1, None), ("a", "a2", 2, "x", False, 1, None), ("a", "a3", 3, "x", False, 1, None), ("a", "a4", 4, None, False, 1, None), ("a", "a5", 5, "x", False, 1, 1), ("b", "a1", 6, "x", False, 1, None)], STORED)
    new = spark.createDataFrame([("a", 2, 1, "a1", "y", False), ("a", 2, 2, "a1", "z", False), ("a", 2, 3, "a4", None, True), ("a", 2, 4, "a6", "n", False)], ARRIVING)
    cited = spark.createDataFrame([(3,), (3,), (5,), (None,)], "id long")
    d = M.applied(stored, new, cited)
    rows = {(r["law"], r["path"]): (r["id"], r["hash"], r["version"], r["gone_in"]) for r in M.articles_after(d).collect()}
    assert rows == {("a", "a1"): (1, "y", 2, None), ("a", "a3"): (3, "x", 1, 2), ("a", "a4"): (4, None, 2, None), ("a", "a5"): (5, "x", 1, 1), ("a", "a6"): (None, "n", 2, None), ("b", "a1"): (6, "x", 1, None)}
    assert {r["law"]: tuple(r)[1:] for r in M.changes(d).collect()} == {"a": (1, 1, 3, 2), "b": (0, 0, 0, 0)}
    assert M.applied(stored.filter("false"), new.filter("false"), cited).count() == 0


def test_anchors_go_forward_only(spark):
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(["제1조 (목적) 차례", "제 1 조(목적) 본문", None, "① 하나", "제2조(뜻)", "① 하나", ""])], "doc string, no int, text string")
    keys = [("d", 1, "제1조(목적"), ("d", 2, "①하나"), ("d", 3, "제9조"), ("d", 4, "제2조(뜻"), ("d", 5, "① 하나"), ("d", 6, None), ("d", 7, "제1조(목적"), ("e", 1, "제1조")]
    got = M.anchors(spark.createDataFrame(keys, "doc string, ord int, key string"), lines)
    assert sorted((r["ord"], r["no"]) for r in got.collect()) == [(1, 0), (2, 3), (4, 4), (5, 5)]


def test_regions_of_wrong_and_last_heads(spark):
    nodes = spark.createDataFrame([("d", 1, "annex1", "annex", 2, 100.0), ("d", 2, "x", "article", 1, 50.0), ("d", 3, "annex2", "annex", 3, 2.0), ("d", 4, "y", "article", None, None), ("e", 1, "annex1", "annex", 1, 10.0), ("e", 2, "z", "article", 2, 20.0)], "doc string, ord int, path string, unit string, page int, y double")
    pages = spark.createDataFrame([(d, p, 800.0) for d, n in (("d", 4), ("e", 2)) for p in range(1, n + 1)], "doc string, page int, height double")
    got = sorted(tuple(r) for r in M.regions(nodes, pages).collect())
    assert got == [("d", "annex1", 2, 94.0, 800.0), ("d", "annex2", 3, 0.0, 800.0), ("d", "annex2", 4, 0.0, 800.0), ("e", "annex1", 1, 4.0, 800.0)]


@pytest.mark.parametrize(
    ("html", "safe", "harmless"),
    [
        (None, None, None),
        ("", "", ""),
        ("<td rowspan=3 onclick=x>1 < 2</td>", '<td rowspan="3">1 &lt; 2</td>', "<td rowspan=3>1 < 2</td>"),
        ("a<!-- <b> --><iframe src=x></iframe>b", "ab", "a<!-- <b> --><iframe src=x></iframe>b"),
        ("<SCRIPT>x</SCRIPT ><b>y", "<b>y", "<b>y"),
        ("<a href=javascript:x>y</a>", "y", '<a href="#">y</a>'),
        ("<thing><p\n class='a'>z</p></br>", "<p>z</p>", "<thing><p\n class='a'>z</p></br>"),
    ],
)
def test_markup(spark, html, safe, harmless):
    d = spark.createDataFrame([(html,)], "h string").select(X.allowed_html(F.col("h")), X.harmless_html(F.col("h")))
    assert tuple(d.first()) == (safe, harmless)


def test_values(spark):
    d = spark.createDataFrame([("7 days", "in 7 day"), ("7 days", "in 17 days"), ("at cost", None), (None, None), ("5 %", "5% of it"), ("3 days", None)], "v string, q string")
    assert [r[0] for r in d.select(E.value_supported(F.col("v"), F.col("q"))).collect()] == [True, False, True, True, True, False]
    spans = spark.createDataFrame([("2 years", 1, 3), ("2 days or 9 weeks", 60, 70), ("1 month", None, 30), ("1 month", None, 31), (None, 1, 2)], "v string, a int, b int")
    assert [r[0] for r in spans.select(E.in_bounds(F.col("v"), F.col("a"), F.col("b"))).collect()] == [True, True, False, True, True]


def test_administrative_rules_that_are_odd(spark):
    xml = ["<A><조문내용>제3절 Lost</조문내용><조문내용>제1조 No heading</조문내용><부칙><부칙공포일자>20200101</부칙공포일자><부칙내용>a</부칙내용><부칙내용>b</부칙내용></부칙></A>", None, "<broken", "<A></A>"]
    d = spark.createDataFrame(list(enumerate(xml)), "id int, xml string")
    got = [(r["id"], r["path"], r["heading"], r["text"]) for r in B.admin_rule_provisions(d, "xml", ["id"]).orderBy("id", "ord").collect()]
    assert got == [(0, "a1", None, "No heading"), (0, "supp#1", None, "a"), (0, "supp#2", None, "b")]
