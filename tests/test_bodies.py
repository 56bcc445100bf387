"""Statute bodies and zipped files with odd content."""

import io
import zipfile

from chronolex.sources import bodies as B


def zipped(**sections):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in sections.items():
            z.writestr(f"Contents/{name}.xml", f'<s xmlns:h="u">{body}</s>')
    return out.getvalue()


def test_zipped_lines(spark):
    inner = "<h:p><h:t>outer <h:x>a</h:x> tail</h:t><h:tbl><h:p><h:t>cell</h:t>not text</h:p></h:tbl><h:t> end</h:t></h:p>"
    files = [("a", zipped(section10="<h:p><h:t>last</h:t></h:p>", section2=inner, header="<h:p><h:t>no</h:t></h:p>")), ("b", b"no zip"), ("c", None), ("d", zipped(section0="<h:p>")), ("e", zipped(section0="<h:p><h:t>  </h:t></h:p>"))]
    got = B.zipped_lines(spark.createDataFrame(files, "path string, content binary"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, "cell"), ("a", 1, "outer a tail end"), ("a", 2, "last")]


def test_statute_bodies(spark):
    xml = """<법령><조문>
    <조문단위><조문여부>전문</조문여부><조문내용>제1장 총칙</조문내용></조문단위>
    <조문단위><조문여부>조문</조문여부><조문번호>1</조문번호><조문제목>목적</조문제목><조문내용>제1조(목적) 이 법은</조문내용><항><호><호번호>1.</호번호><호내용>1. 하나</호내용></호><호><호번호>1.</호번호><호내용>1의2. 둘</호내용></호></항></조문단위>
    <조문단위><조문여부>조문</조문여부><조문번호>2</조문번호><조문가지번호>3</조문가지번호><조문내용>제2조의3 끝</조문내용><항><항번호>①</항번호><항내용>① 가</항내용></항><항><항번호>②</항번호><항내용>② 나</항내용><호><호번호>4.</호번호><호내용>다</호내용></호></항></조문단위>
    </조문><부칙><부칙단위><부칙공포일자>20200102</부칙공포일자><부칙내용>x</부칙내용></부칙단위><부칙단위><부칙공포일자>20200102</부칙공포일자><부칙내용>y</부칙내용></부칙단위><부칙단위><부칙내용>z</부칙내용></부칙단위></부칙></법령>"""
    rows = B.statute_provisions(spark.createDataFrame([(1, xml), (2, None), (3, "<법령></법령>"), (4, "<법령><조문>")], "k int, xml string"), "xml", ["k"]).orderBy("ord").collect()
    assert {r.k for r in rows} == {1}
    assert [(r.path, r.unit, r.heading, r.text) for r in rows] == [
        ("a1", "article", "목적", "이 법은"), ("a1.i1", "item", None, "하나"), ("a1.i1-2", "item", None, "둘"), ("a2-3", "article", None, "끝"),
        ("a2-3.p1", "paragraph", None, "가"), ("a2-3.p2", "paragraph", None, "나"), ("a2-3.p2.i4", "item", None, "다"),
        ("supp@2020-01-02", "supplement", None, "x"), ("supp@2020-01-02~2", "supplement", None, "y"), ("supp#3", "supplement", None, "z"),
    ]
