"""Citations in sentences written by hand."""

import pytest

from chronolex.operators import passages as P

CASES = {
    ("a27.p3", None, "제1항에도 불구하고 제13조의 근무지내 출장은 증빙을 생략한다."): [("internal", None, "a27.p1", "EXCEPTION"), ("internal", None, "a13", "CITATION")],
    ("a6-2.p1", None, "「여신전문금융업법」제2조 제3호에 따른 카드"): [("external", "여신전문금융업법", "a2.i3", "BASIS")],
    ("a3.p1", None, "제7조의2제1항을 준용한다."): [("internal", None, "a7-2.p1", "MUTATIS")],
    ("a29", "기타", "이 규정에 없는 것은 「여비규정」 및 「복무 예규」를 준용할 수 있다."): [("external", "여비규정", None, "MUTATIS"), ("external", "복무 예규", None, "MUTATIS")],
    ("a10.p2", None, "전항의 숙박비는 실비로 한다."): [("internal", None, "a10.p1", "CITATION")],
    ("a10.p1", None, "전항의 숙박비는 실비로 한다."): [],
    ("a9", None, "여비는 별표 1에 정하는 바에 의하고, 나머지는 원장이 따로 정한다."): [("annex", None, "annex1", "CITATION"), ("delegation", None, None, "DELEGATION")],
    ("a1.p1", None, "「공무원법」 제5조 및 제6조에 따른다. 같은 법 제7조는 준용한다."): [("external", "공무원법", "a5", "CITATION"), ("external", "공무원법", "a6", "BASIS"), ("external", "공무원법", "a7", "MUTATIS")],
    ("a3.p1", "x", "이 조치는 즉시 한다."): [],
    ("a4", None, "인사규정 제5조와 제6조, 별표 2의3을 본다."): [("named", "인사규정", "a5", "CITATION"), ("named", "인사규정", "a6", "CITATION"), ("named_annex", "인사규정", "annex2-3", "CITATION")],
    ("a5", None, "이 규정 제2조 및 관련 규정 제3조와 법 제8조에 따른다."): [("internal", None, "a2", "CITATION"), ("internal", None, "a3", "CITATION"), ("named", "이해충돌 방지법", "a8", "BASIS")],
    ("a6", None, "제72조제3항 및 제4항을 준용하고 같은 조 제5항은 뺀다."): [("internal", None, "a72.p3", "MUTATIS"), ("internal", None, "a72.p4", "MUTATIS"), ("internal", None, "a72.p5", "CITATION")],
    ("a7", None, "절차는 회계규정에서 따로 정한다. “나머지는 따로 정한다”는 말은 아니다."): [("delegation_named", "회계규정", None, "DELEGATION")],
    ("a8", None, "여비규정에 의하여 주고 회계규정에서 위임한 것은 뺀다."): [("named", "여비규정", None, "BASIS"), ("named", "회계규정", None, "IMPLEMENTS")],
    ("supp1", None, "여비규정 일부를 다음과 같이 개정한다. 제3조를 고친다."): [("named", "여비규정", "a3", "CITATION")],
    ("a1", None, "「공무원법」 제5조에 따라 정한다."): [("external", "공무원법", "a5", "IMPLEMENTS")],
    ("a13", None, "공공기관의 운영에 관한 법률 제5조부터 제7조까지를 따르고, 제8조를 본다."): [("named", "공공기관의 운영에 관한 법률", "a5", "CITATION"), ("named", "공공기관의 운영에 관한 법률", "a7", "CITATION"), ("internal", None, "a8", "CITATION")],
    ("a14", None, "이 규칙은 공공기관의 운영에 관한 법률 시행령 제3조에 의하여 만든다."): [("named", "공공기관의 운영에 관한 법률 시행령", "a3", "BASIS")],
    ("a15", None, "인사규정 제5조(직위의 해제) 및 제6조(복직)를 준용한다."): [("named", "인사규정", "a5", "MUTATIS"), ("named", "인사규정", "a6", "MUTATIS")],
    ("a16", None, "보수내규 제2조, 업무편람 제3조, 행동강령 제4조와 정관 제5조를 본다."): [("named", "보수내규", "a2", "CITATION"), ("named", "업무편람", "a3", "CITATION"), ("named", "행동강령", "a4", "CITATION"), ("named", "정관", "a5", "CITATION")],
    ("annex3", None, "표준 계약서(제7조 관련)\n제1조(총칙) 갑과 을은 제2조를 지킨다.\n제2조(기간) 여비규정 제4조에 따른다."): [("internal", None, "a7", "CITATION"), ("named", "여비규정", "a4", "BASIS")],
    ("annex4", None, "제3조와 제4조를 본다."): [("internal", None, "a3", "CITATION"), ("internal", None, "a4", "CITATION")],
    ("a17", None, "『공무원 여비 규정』 제3조 및 제4조를 준용한다."): [("named", "공무원 여비 규정", "a3", "MUTATIS"), ("named", "공무원 여비 규정", "a4", "MUTATIS")],
    ("a11", None, None): [],
    ("a12", None, ""): [],
}


@pytest.fixture(scope="module")
def found(spark):
    texts = spark.createDataFrame([("d", p + "/" + str(k), p, h, t) for k, ((p, h, t), _) in enumerate(CASES.items())], "own string, id string, path string, heading string, text string")
    known = spark.createDataFrame([(f"{p}/{k}", "법", "이해충돌 방지법") for k, (p, _, _) in enumerate(CASES)], "id string, abbreviation string, name string")
    out = {}
    for r in P.cited(texts, "text", "id", "path", "heading", known).orderBy("place").collect():
        out.setdefault(r["id"], []).append((r["kind"], r["title"], r["target"], r["rel"]))
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cited(found, k):
    (path, _, text), want = list(CASES.items())[k]
    assert found.get(f"{path}/{k}", []) == want, text


def test_abbreviations(spark):
    d = spark.createDataFrame([("a", "「공직자의 이해충돌 방지법」(이하 “법”이라 한다) 제2조"), ("a", None), ("b", "“법”")], "doc string, text string")
    assert [tuple(r) for r in P.abbreviations(d, "doc", "text").collect()] == [("a", "법", "공직자의 이해충돌 방지법")]
    d = spark.createDataFrame([("c", "도로법(이하 ‘법’이라 한다)과 같은 법 시행령 (이하 “영”이라 함)에 따른다. 회계규정 (이하 \"규정\"이라 한다)"), ("d", "같은 법 시행령(이하 “영”이라 한다)")], "doc string, text string")
    assert sorted(tuple(r) for r in P.abbreviations(d, "doc", "text").collect()) == [("c", "규정", "회계규정"), ("c", "법", "도로법"), ("c", "영", "도로법 시행령")]


def test_recurring_texts_are_read_once(spark, monkeypatch):
    """Provisions of many documents share few texts; documents call other laws by the same short name, or none."""
    read, rows = P._read, []
    monkeypatch.setattr(P, "_read", lambda d, keys: rows.append(d.count()) or read(d, keys))
    cases = [(p, h, t) for p, h, t in CASES] + [("a20", None, "법 제2조를 본다. 같은 법 시행령 제3조를 준용한다."), (None, "", "제2조를 본다."), (None, None, "제2조를 본다.")]
    texts = spark.createDataFrame([(f"{doc}.{k}", p, h, t) for doc in range(20) for k, (p, h, t) in enumerate(cases)], "id string, path string, heading string, text string")
    known = spark.createDataFrame([(f"{doc}.{k}", "법", f"{doc}법") for doc in range(0, 20, 2) for k in range(len(cases))], "id string, abbreviation string, name string")
    once = sorted(P.cited(texts, "text", "id", "path", "heading", known).collect(), key=repr)
    each = sorted(P.cited(texts, "text", "id", "path", "heading", known, few=0).collect(), key=repr)
    assert once == each and {r["title"] for r in once} >= {"4법 시행령", "법 시행령"}
    assert rows == [len(cases), 20 * len(cases)]
