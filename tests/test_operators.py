"""Operators on small inputs written by hand: awkward rows, ties, and results that SQL doesn't give."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from chronolex.functions import text as X
from chronolex.operators import citations as C
from chronolex.operators import retrieval
from chronolex.operators import structure as S
from chronolex.operators import upsert as U
from chronolex.operators import versions as V
from chronolex.sources import documents as D
from chronolex.streaming import outbox

SF = "/root/testdata/sf0.001"

LINES = """여비규정
제1장 총칙
제1조(목적) 이 규정은 여비를 정한다.
제2조(정의) ① 뜻은 다음과 같다.
1. 출장: 일로 가는 것
가. 국내
나. 국외
2. 여비: 드는 돈
② 그 밖의 뜻은 법에 따른다. ③ 끝.
제9장 없는 장
제1조에 따라 정한다.
제2장 여비
제5조의2(특례) 삭제 <개정 2020.1.1.>
제5조(일반) 늦게 온 조
부칙
제1조(시행일) 2020년부터 시행한다.
[별표 1] 여비표
제1조(표 안) 표의 글""".split("\n")


def tree(spark, lines):
    d = spark.createDataFrame([("d", k, t) for k, t in enumerate(lines)], "doc_id string, line_no int, text string")
    return {r["path"]: r for r in S.provisions(d).collect()}


def test_tree_of_a_regulation(spark):
    t = tree(spark, LINES)
    assert [p for p, _ in sorted(t.items(), key=lambda x: x[1]["ord"])] == ["pre", "c1", "a1", "a2", "a2.p1", "a2.p1.i1", "a2.p1.i1.s1", "a2.p1.i1.s2", "a2.p1.i2", "a2.p2", "a2.p3", "c2", "a5-2", "supp1", "supp1/a1", "annex1"]
    assert t["a1"]["heading"] == "목적" and t["a1"]["text"] == "이 규정은 여비를 정한다."
    assert t["a2.p3"]["text"] == "끝.\n제9장 없는 장\n제1조에 따라 정한다."  # a chapter out of order and an article in running text open nothing
    assert t["a5-2"]["deleted"] and t["a5-2"]["notes"] == ["<개정 2020.1.1.>"]
    assert "제5조(일반)" in t["a5-2"]["text"]  # not above the last number
    assert t["annex1"]["text"] == "여비표\n제1조(표 안) 표의 글"
    assert t["a2.p1.i1.s2"]["parent_path"] == "a2.p1.i1" and t["supp1/a1"]["parent_path"] == "supp1"


def test_tree_of_nothing(spark):
    assert tree(spark, ["", "  ", None]) == {}
    d = spark.createDataFrame([], "doc_id string, line_no int, text string")
    assert S.provisions(d).count() == 0


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("여비규정 제5조의2 제1항 제3호 나목", ("여비규정", 5, 2, 1, 3, "a5-2.p1.i3.s2")),
        ("「도로법」 제10조", ("도로법", 10, None, None, None, "a10")),
        ("제3조제2항", (None, 3, None, 2, None, "a3.p2")),
        ("여비가 뭐야", (None, None, None, None, None, None)),
        (None, (None, None, None, None, None, None)),
    ],
)
def test_citation_of_a_question(spark, question, want):
    d = spark.createDataFrame([(question,)], "q string").select(C.parse(F.col("q")).alias("c")).first()["c"]
    assert tuple(d) == want


def test_relations(spark):
    text = "「도로법」 제3조에 따라 정하되 그 밖의 여러 사정을 두루 살펴야 하며 다만, 제5조에도 불구하고 「하천법」을 준용한다."
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = [tuple(r)[1:] for r in C.extracted(d, "t", ["k"]).collect()]
    assert (True, "도로법", "a3", "BASIS") in got
    assert (True, "하천법", None, "MUTATIS") in got
    assert (False, None, "a5", "EXCEPTION") in got
    assert len(got) == 3
    near = spark.createDataFrame([(1, "「도로법」 제3조에 따르되 제5조에도 불구하고 한다.")], "k int, t string")
    assert {r["rel"] for r in C.extracted(near, "t", ["k"]).collect()} == {"EXCEPTION"}  # thirty characters decide, in this order


def test_resolution_of_titles(spark):
    refs = spark.createDataFrame([(1, True, "도로 법", "a1.p3"), (1, True, "하천법", None), (1, True, "없는 법", "a1"), (1, False, None, "a9"), (1, False, None, "a2")], "own int, external boolean, title string, path string")
    works = spark.createDataFrame([(7, "도로법"), (8, "하천법"), (9, "하천 법")], "work int, title string")
    places = spark.createDataFrame([(7, "a1"), (1, "a2")], "work int, path string")
    got = {(r["title"], r["path"]): (r["target_work"], r["target_kind"], r["resolution"]) for r in C.resolved(refs, works, places, "own").collect()}
    assert got == {
        ("도로 법", "a1.p3"): (7, "PROVISION", "RESOLVED"),
        ("하천법", None): (None, "NONE", "AMBIGUOUS"),
        ("없는 법", "a1"): (None, "NONE", "UNRESOLVED"),
        (None, "a9"): (1, "PROVISION", "UNRESOLVED"),
        (None, "a2"): (1, "PROVISION", "RESOLVED"),
    }


def test_evidence_is_packed_greedily(spark):
    rows = [("q", 1, 5000), ("q", 2, 4000), ("q", 3, 3000), ("q", 4, 1), ("q", 5, 1), ("q", 6, 1), ("r", 1, 9000)]
    d = spark.createDataFrame(rows, "q string, o int, n int")
    assert dict(map(tuple, C.packed(d, "q", "o", "n").collect())) == {"q": [1, 3], "r": []}

    def brute(hits, most, budget):
        used, out = 0, []
        for o, n in sorted(hits):
            if used + n <= budget and len(out) < most:
                used, out = used + n, [*out, o]
        return out

    for budget in (8000, 8001, 8002, 12000):
        got = dict(map(tuple, C.packed(d, "q", "o", "n", budget=budget).collect()))
        assert got == {q: brute([(o, n) for k, o, n in rows if k == q], 4, budget) for q in "qr"}


def test_runs_of_signs_collapse(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a---- b!!!!! ccccc 11111   x"), (-2, None)], "doc_id long, text string"))
    for r in docs.select("text", X.collapse_repeats(F.col("text")).alias("t")).collect():
        assert r["t"] == (None if r["text"] is None else re.sub(r"([^\w\s]|_)\1{3,}", r"\1", r["text"]))


def test_upsert_actions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None), (5, "e", 5)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", 1), (2, None, 9), (3, "c", None), (4, "d", None)], "k int, s string, n int")
    rows = lambda d: {r["k"]: tuple(r)[1:] for r in d.collect()}
    assert rows(U.upsert(old, new, ["k"])) == {1: ("a", 1, "same"), 2: (None, 9, "updated"), 3: ("c", None, "same"), 4: ("d", None, "inserted"), 5: ("e", 5, "kept")}
    assert rows(U.upsert(old, new, ["k"], keep_when_null=("s",)))[2] == ("b", 9, "updated")
    assert rows(U.upsert(old, new, ["k"], guard=F.col("_o.n") > 2))[2] == ("b", 2, "kept")
    assert {r["k"] for r in U.insert_absent(old, new, ["k"]).collect()} == {1, 2, 3, 4, 5}
    assert sorted(r["k"] for r in U.row_set_difference(old, new, ["k"]).collect()) == [2, 4, 5]


def test_chain_with_same_day_and_undated_versions(spark):
    d = dt.date
    rows = [("w", 1, d(2020, 1, 1)), ("w", 2, d(2024, 1, 17)), ("w", 3, d(2024, 1, 17)), ("w", 4, d(2030, 1, 1)), ("w", 5, None)]
    chain = V.chain(spark.createDataFrame(rows, "work string, n int, day date"), "work", "day", ["n"], F.lit("2026-10-02").cast("date"))
    assert [(r["n"], r["valid_to"], r["state"]) for r in chain.orderBy("n").collect()] == [(1, d(2024, 1, 17), "HISTORICAL"), (2, d(2024, 1, 17), "HISTORICAL"), (3, d(2030, 1, 1), "CURRENT"), (4, None, "FUTURE"), (5, None, "UNDATED")]
    assert [r["n"] for r in V.valid_at(chain, F.lit("2024-01-17").cast("date")).collect()] == [3]


def test_file_kinds_and_blobs(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.hwp": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "b.xls": bytes.fromhex("D0CF11E0A1B11AE1"), "c.hwpx": b"PK\x03\x04x", "c.zip": b"PK\x03\x04x", "e.txt": b"x", "sub/a.pdf": b"%PDF-1.7 x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = D.read_files(spark, f"file://{tmp_path}")
    got = {r["path"].removeprefix(f"file:{tmp_path}/"): r["kind"] for r in files.select("path", "kind").collect()}
    assert got == {"a.pdf": "pdf", "b.hwp": "hwp", "b.xls": None, "c.hwpx": "hwpx", "c.zip": None, "e.txt": None, "sub/a.pdf": "pdf"}
    known = files.filter("kind = 'pdf'").withColumn("source", F.lit("s"))
    assert D.new_blobs(known, spark.createDataFrame([], "source string, sha256 string")).count() == 1
    assert D.new_blobs(known, known).count() == 0


def test_listings(spark):
    page = "<LawSearch><totalCnt>2</totalCnt><law><id>1</id><name> 도로법 </name><promulgated>20240131</promulgated><effective>20240230</effective><ministry/></law><law><id>2</id><name>하천법</name></law></LawSearch>"
    rows = D.statute_list(spark.createDataFrame([(1, page)], "p int, x string"), "x", ["p"]).orderBy("id").collect()
    assert [(r["name"], r["promulgated"], r["effective"], r["ministry"], r["complete"]) for r in rows] == [("도로법", dt.date(2024, 1, 31), None, None, True), ("하천법", None, None, None, False)]
    d = spark.createDataFrame([("12|a, b.hwp,13|c.pdf",), ("",), (None,)], "f string").select(D.attachments(F.col("f")).alias("x")).collect()
    assert [[tuple(a) for a in r["x"]] for r in d] == [[("12", "a, b.hwp"), ("13", "c.pdf")], [], []]


def test_csv_mark_and_releases(spark, tmp_path):
    d = spark.createDataFrame([(1, "가")], "k int, t string")
    D.write_csv(d, str(tmp_path / "csv"))
    files = [f.read_bytes() for f in (tmp_path / "csv").glob("part-*")]
    assert all(f.startswith(b"\xef\xbb\xbf") for f in files if f) and any("가".encode() in f for f in files)
    for name, n in (("r1", 3), ("r2", 5)):
        D.publish(spark, spark.range(n), str(tmp_path / "index"), name)
    assert D.published(spark, str(tmp_path / "index")).count() == 5


def test_streams_over_several_batches(spark, tmp_path):
    rows = [(u, e, bad) for e, (u, bad) in enumerate([(1, True), (1, True), (2, True), (1, False), (1, True), (1, True), (1, True), (1, True), (2, False)])]
    d = spark.createDataFrame(rows, "user_id int, event_id int, bad boolean")
    for k in range(3):  # a file each, oldest first
        d.filter(f"event_id div 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = outbox.upserted(s, ["user_id"], "event_id")
    assert sorted(map(tuple, last.select("user_id", "event_id").collect())) == [(1, 7), (2, 8)]
    marks = outbox.with_strikes(s, "user_id", "event_id", "bad").withColumn("seen", F.col("handled") + F.col("skipped"))
    got = outbox.upserted(marks, ["user_id"], "seen", "update").drop("seen")
    assert sorted(map(tuple, got.collect())) == [(1, 6, 5, 1, 6), (2, 2, 1, 0, None)]


def test_nearest_answers_every_query_beyond_a_block(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    asked = rows.selectExpr("id AS q", "v AS a").filter("q < 25")
    got = sorted(tuple(r) for r in retrieval.nearest(rows, asked, "q", "a", "id", "v", 3, most=10).collect())
    assert got == sorted(tuple(r) for r in retrieval.nearest(rows, asked, "q", "a", "id", "v", 3).collect())
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert [r[1] for r in sorted(got, key=lambda r: (r[0], r[3]))] == [int(i) for q in range(25) for i in np.argsort(-cos[q])[:3]]


def test_best_row_of_every_other_group(spark):
    """Ties go to the smaller id, queries go in blocks; null vectors and groups take no part, zero vectors score 0."""
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.0, 0.0]), (4, "c", [1.0, 1.0]), (5, "c", [2.0, 2.0]), (6, None, [1.0, 0.0]), (7, "d", None), (8, "b", [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "id int, label string, vector array<double>")
    asks = v.select(F.col("id").alias("ask"), "label", F.col("vector").alias("asked"))
    for most in (2, 1000):
        got = retrieval.nearest_of_groups(v, asks, "ask", "asked", "id", "vector", "label", most)
        by = {(r.ask, r.label): (r.id, r.score) for r in got.collect()}
        assert len(by) == 6 * 2
        assert by[1, "b"] == (3, 0.0) and by[1, "c"] == (4, 0.707107) and by[5, "a"] == (1, 0.707107) and by[8, "a"] == (1, -1.0)
    assert retrieval.nearest_of_groups(v, asks.limit(0), "ask", "asked", "id", "vector", "label").count() == 0
    assert retrieval.nearest_of_groups(v.limit(0), asks, "ask", "asked", "id", "vector", "label").count() == 0


def test_breadcrumbs_need_no_join(spark):
    """Paths that sort between a provision and what lies in it, missing levels, several documents, a path without a name."""
    rows = [(1, "a1.p1", "x"), (1, "a1", "h"), (1, "a1-2", None), (1, "a1-2.p1", "q"), (1, "a1.p1.i3", None), (1, "a2.p1.i1", None), (1, "supp1/a1.p1.i1.s1", None), (1, "supp1", None), (1, "supp1/a1", "s"), (2, None, "z"), (2, "a1.p2", "k"), (2, "a10.p2", None), (2, "a1", "one")]
    d = S.breadcrumbs(spark.createDataFrame(rows, "doc_id long, path string, heading string"))
    got = {(r["doc_id"], r["path"]): r["trail"] for r in d.collect()}
    assert got == {
        (1, "a1"): "h", (1, "a1.p1"): "h > x", (1, "a1.p1.i3"): "h > x > a1.p1.i3", (1, "a1-2"): "a1-2", (1, "a1-2.p1"): "a1-2 > q", (1, "a2.p1.i1"): "a2.p1.i1",
        (1, "supp1"): "supp1", (1, "supp1/a1"): "supp1 > s", (1, "supp1/a1.p1.i1.s1"): "supp1 > s > supp1/a1.p1.i1.s1", (2, "a1"): "one", (2, "a1.p2"): "one > k", (2, "a10.p2"): "a10.p2",
    }
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_a_paragraph_that_opens_again_goes_on_with_its_items(spark):
    d = spark.createDataFrame([(1, k, t) for k, t in enumerate(["제1조(a) x", "① p", "1. i", "② q", "가. of p2", "① again", "가. of i1", "제2조(b)", "① r", "가. none"])], "doc_id long, line_no int, text string")
    got = {r["path"]: r["text"] for r in S.provisions(d).collect()}
    assert got == {"a1": "x", "a1.p1": "p\nagain", "a1.p1.i1": "i", "a1.p2": "q\n가. of p2", "a1.p1.i1.s1": "of i1", "a2": "", "a2.p1": "r\n가. none"}
