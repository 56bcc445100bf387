"""Search units of a small regulation, field by field."""

from pyspark.sql import functions as F

from chronolex.operators import drafting as D
from chronolex.operators import units as U

ROWS = [
    (0, "c1", None, "chapter", "제1장", "총칙", ""),
    (1, "c1s1", "c1", "section", "제1절", None, ""),
    (2, "a3-2", "c1s1", "article", "제3조의2", "여비", "여비를 준다."),
    (3, "a3-2.p1", "a3-2", "paragraph", "①", None, "다음과 같다."),
    (4, "a3-2.p1.i2-1", "a3-2.p1", "item", "2의1.", None, "국외"),
    (5, "a3-2.p1.i2-1.s3", "a3-2.p1.i2-1", "subitem", "다.", None, "항공"),
    (6, "a3-2.p2", "a3-2", "paragraph", "②", None, None),
    (7, "a3-2~2", None, "article", "제3조의2", "", "다시"),
    (8, "supp#3", None, "supplement", "부칙", None, "시행한다."),
    (9, "supp#3/a2", "supp#3", "supp_article", "제2조", None, "경과"),
    (10, "annex1-2", None, "annex", "별표 1의2", "지급표", "가나다라마바사아자차카타파하가나다라마바사"),
    (11, "form4", None, "annex", "별지 4", None, "서식"),
]


def units(spark, rows=ROWS, size=30, current=True):
    d = spark.createDataFrame([("v", "여비규정", *r) for r in rows], "version string, title string, ord int, path string, parent string, unit string, label string, heading string, text string")
    return {r["path"]: r for r in U.search_units(d, F.lit(current), size).collect()}


def test_fields(spark):
    u = units(spark)
    assert set(u) == {"a3-2", "a3-2.p1", "a3-2.p1.i2-1", "a3-2.p1.i2-1.s3", "a3-2.p2", "a3-2~2", "supp#3", "supp#3/a2", "annex1-2#1", "annex1-2#2", "form4"}
    s = u["a3-2.p1.i2-1.s3"]
    assert [s[c] for c in ("article_no", "article_branch", "paragraph_no", "item_no", "item_branch", "subitem", "annex_no", "annex_branch")] == [3, 2, 1, 2, 1, "다", None, None]
    assert s["full_label"] == "여비규정 제3조의2 제1항 제2호의1 다목" and s["breadcrumb"] == "여비규정 > 제1장 총칙 > 제1절 > 제3조의2(여비) > 제1항 > 제2호의1 > 다목"
    assert s["context"] == "제3조의2(여비) 여비를 준다. ① 다음과 같다. 2의1. 국외" and s["embed_text"] is None and s["article_text"] is None
    assert u["a3-2"]["article_text"] == u["a3-2"]["embed_text"] == "제3조의2(여비)\n여비를 준다.\n① 다음과 같다.\n2의1. 국외\n다. 항공\n②"
    assert u["a3-2.p1"]["embed_text"] == "제3조의2(여비)\n① 다음과 같다.\n2의1. 국외\n다. 항공"
    assert (u["a3-2.p2"]["text"], u["a3-2.p2"]["embed_text"]) == ("", "제3조의2(여비)\n②")
    assert (u["a3-2~2"]["article_no"], u["a3-2~2"]["article_branch"], u["a3-2~2"]["article_text"]) == (3, 2, "제3조의2\n다시")


def test_supplements_annexes_forms(spark):
    u = units(spark)
    assert u["supp#3/a2"]["full_label"] == "여비규정 부칙 제2조" and u["supp#3/a2"]["breadcrumb"] == "여비규정 > 부칙 > 제2조" and u["supp#3/a2"]["article_no"] is None
    assert u["supp#3"]["article_text"] == "부칙\n시행한다." and u["supp#3"]["embed_text"] is None
    one, two = u["annex1-2#1"], u["annex1-2#2"]
    assert one["text"] + two["text"] == ROWS[10][6] and len("별표 1의2(지급표)\n" + one["text"]) == 30
    assert (one["base_path"], one["annex_no"], one["annex_branch"], one["window"], two["window"]) == ("annex1-2", 1, 2, 1, 2)
    assert one["article_text"] == "별표 1의2(지급표)\n" + ROWS[10][6] and two["article_text"] is None and two["embed_text"] == "별표 1의2(지급표)\n" + two["text"]
    assert (u["form4"]["unit"], u["form4"]["annex_no"], u["form4"]["embed_text"]) == ("form", 4, None)


def test_past_versions_and_nothing(spark):
    assert all(r["embed_text"] is None for r in units(spark, current=False).values())
    assert units(spark, rows=[]) == {}


def test_chunks_follow_the_numbers(spark):
    rows = [("v", f"a1.p{k}", "paragraph", f"t{k}") for k in (10, 9, 1)] + [("v", "a1", "article", "t0")]
    d = spark.createDataFrame(rows, "version string, path string, unit string, text string")
    assert [tuple(r) for r in D.article_chunks(d, 100).collect()] == [("v", "a1", "t0\nt1\nt9\nt10")]


def test_provisions_are_not_shuffled_for_joins(spark):
    """Where versions are dealt already nothing is dealt again; a missing article, context below the second level, and a paragraph that comes late."""
    more = [(12, "c1s1d1", "c1s1", "section", "제1관", "이름", ""), (13, "a9", "c1s1d1", "article", "제9조", None, "글"), (14, "a8.p1.i1", None, "item", "1.", None, "홀로"), (1, "a9.p2.i1", None, "item", "1.", None, "앞"), (15, "a9.p2", "a9", "paragraph", "②", None, "뒤")]
    u = units(spark, rows=ROWS + more)
    assert u["a9"]["breadcrumb"] == "여비규정 > 제1절 > 제1관 이름 > 제9조" and u["a9"]["article_text"] == "제9조\n글\n1. 앞\n② 뒤"
    assert u["a9.p2.i1"]["context"] == "제9조 글 ② 뒤" and u["a8.p1.i1"]["context"] == "" and u["a8.p1.i1"]["article_text"] == "1.\n홀로"
    schema = "version string, title string, ord int, path string, parent string, unit string, label string, heading string, text string"
    dealt = spark.createDataFrame([(v, "여비규정", *r) for v in "vw" for r in ROWS], schema).repartition(4, "version")
    d = U.search_units(dealt, F.lit(True), 30)
    assert d.count() == 2 * len(units(spark))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(version") <= 2 and "article_path#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)

