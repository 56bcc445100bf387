"""Answers against their evidence, case by case."""

from pyspark.sql import functions as F

from chronolex.operators import answers as V

TEXT = "여비는 출장을 마친 날부터 2주일 이내에 청구하여야 한다. 다만, 1개월 이내에 50만원을 넘지 않는 금액은 제외한다."


def check(spark, verdict="조건부", explanation="설명", quote="출장을 마친 날부터 2주일 이내에 청구", source="E1", question="", allowed=None, text=TEXT, more=()):
    answers = spark.createDataFrame([("x", question, verdict, explanation, allowed)], "answer string, question string, verdict string, explanation string, allowed array<string>")
    cites = spark.createDataFrame([("x", source, quote), *[("x", *m) for m in more]], "answer string, id string, quote string").filter("id IS NULL OR id <> 'none'")
    evidence = spark.createDataFrame([("x", "E1", "여비규정", "제27조", text), ("x", "E2", "보안규정", "제5조", "문을 닫는다."), ("y", "E3", "t", "l", "남의 근거")], "answer string, id string, title string, label string, text string")
    r = V.verified(answers, cites, evidence).collect()[0]
    assert [r["citations_exist"], r["quotes_match"], r["numbers_match"], r["consistent"]] == [n not in r["problems"] for n in ("citation", "quote", "number", "consistency")]
    return r["problems"], r["dropped"]


def test_sources(spark):
    assert check(spark) == ([], 0)
    assert check(spark, source="E9") == (["citation", "quote"], 1)
    assert check(spark, source="E3") == (["citation", "quote"], 1)  # another answer's
    assert check(spark, source=None) == (["citation", "quote"], 1)
    assert check(spark, source="none") == (["citation", "quote"], 0)  # no source at all
    assert check(spark, more=[("E9", "x")]) == (["citation", "quote"], 2)  # one that doesn't exist spoils all


def test_quotes(spark):
    assert check(spark, quote="출장을 마친날부터 2주일이내에 청구")[0] == []
    assert check(spark, quote="출장을 마친 날부터 3주일 이내에 청구")[0] == ["quote"]
    assert check(spark, quote="50만원을 넘는 금액은 제외한다")[0] == ["quote"]  # the negation is gone
    assert check(spark, quote=None)[0] == ["quote"]
    assert check(spark, quote="없는 말이다 정말로", more=[("E2", "문을 닫는다")]) == ([], 1)  # one that matches is enough


def test_numbers(spark):
    ok = lambda e, **k: check(spark, explanation=e, **k)[0] == []
    assert ok("제27조에 따라 2주 이내입니다") and ok("14일 이내입니다") and ok("1개월 이내입니다") and ok("50만원까지") and ok(None)
    assert not ok("15일 이내입니다") and not ok("51만원까지")
    assert not ok("28일 이내입니다")  # a month is 28 to 31 days, so it is no limit in days
    assert ok("28일에서 31일 사이")  # but the days may be said
    assert not ok("20일째입니다") and ok("20일째입니다", question="20일 지났는데?") and ok("20일째입니다", allowed=["20"])
    assert not ok("20일 이내입니다", question="20일 지났는데?")  # a question makes no limit
    assert not ok("50회까지") and ok("50까지") and ok("제50조")
    assert not ok("50만원까지", quote="문을 닫는다", source="E2")  # only what is cited counts


def test_verdicts(spark):
    assert check(spark, "충족", "기한을  넘겼습니다")[0] == ["consistency"]
    assert check(spark, "충족", "기한을넘겼습니다")[0] == ["consistency"]
    assert check(spark, "미충족", "기한 안에 있습니다")[0] == ["consistency"]
    assert check(spark, "미충족", "기한을 넘겼습니다")[0] == [] and check(spark, None, "위반")[0] == []


def test_other_wording(spark):
    words = V.Wording(units=("days", "day"), places=("Article",), same=(("days", "day"),), spans=(("days", 1, 1), ("day", 1, 1)), within="at most", day="day", against=(("met", ("too late",)),), negations=("not",), sentence_end=".")
    d = spark.createDataFrame([("5 days at most", "within 5 day at most", "met", "not too  late")], "e string, x string, v string, w string")
    r = d.select(V.numbers_match(F.col("x"), F.col("e"), F.array().cast("array<string>"), words), V.consistent(F.col("v"), F.col("w"), words)).collect()[0]
    assert tuple(r) == (True, False)
