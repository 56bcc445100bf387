"""Known names in texts, held against a plain search."""

import random
import re

from chronolex.operators import names as N
from chronolex.operators import passages as P

TITLES = [(1, "09-01 공무원 여비 규정"), (2, "여비 규정"), (3, "[본원] 여비규정 세칙"), (4, "인사 규정"), (5, "인사규정"), (6, "가-12 안전 관리 지침"), (7, None), (8, "x")]


def keys(spark):
    return N.keys_of(spark.createDataFrame(TITLES, "w int, title string"), "w", "title")


def test_keys(spark):
    got = {r["key"]: (r["works"], r["work"]) for r in keys(spark).collect()}
    assert got["공무원여비규정"] == (1, 1) and got["인사규정"] == (2, None) and got["안전관리지침"] == (1, 6) and got["여비규정세칙"] == (1, 3) and "x" not in got


def test_names_of_several_words(spark):
    texts = [(1, "이 절은 공무원  여비\n규정 제3조와 여비규정에 따른다."), (2, "여비규정 세칙, 여비규정세칙은 인사규정의 것"), (3, "새여비규정과 여비규정집은 아니다"), (4, "우리원 안전관리 지침을 본다. 우리원 것"), (5, None), (6, "")]
    d = spark.createDataFrame(texts, "d int, t string")
    want = [(1, "공무원  여비\n규정", "공무원여비규정"), (1, "여비규정", "여비규정"), (2, "여비규정 세칙", "여비규정세칙"), (2, "여비규정세칙", "여비규정세칙"), (2, "인사규정", "인사규정"), (4, "우리원 안전관리 지침", "안전관리지침")]
    for shard in (50_000, 2):
        rows = N.names_in(d, "d", "t", keys(spark), prefixes=["우리원"], shard_names=shard).orderBy("d", "start").collect()
        assert [(r["d"], r["name"], r["key"]) for r in rows] == want
        assert all(dict(texts)[r["d"]][r["start"] : r["end"]] == r["name"] for r in rows)


def brute(text, names):
    """Leftmost and longest names of words, separated by anything but letters."""
    out, k = [], 0
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    starts, ends = {a for a, _ in words}, {b for _, b in words}
    while k < len(text):
        hit = None
        if k in starts:
            for e in sorted(ends, reverse=True):
                if e > k and "".join(text[k:e].split()).lower() in names:
                    hit = e
                    break
        if hit:
            out.append((k, hit))
            k = hit
        else:
            k += 1
    return out


def test_random_texts(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 7))) for _ in range(40)})
    texts = [(k, "".join(r.choice("aabbcC  .") for _ in range(60))) for k in range(60)]
    d, known = spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame([(n,) for n in names], "key string")
    want = sorted((k, *h) for k, t in texts for h in brute(t, set(names)))
    for shard in (50_000, 5):
        assert sorted((x["d"], x["start"], x["end"]) for x in N.names_in(d, "d", "t", known, particles=[], shard_names=shard).collect()) == want
    assert N.names_in(d, "d", "t", known.limit(0)).count() == 0 and N.names_in(d.limit(0), "d", "t", known).count() == 0


def test_marked_names_are_cited(spark):
    d = spark.createDataFrame([("a4", "공무원 여비 규정 제3조 및 제4조와 「공무원 여비 규정」 제5조를 본다."), ("a5", "제7조"), ("a6", None)], "path string, text string")
    got = {r["path"]: r["text"] for r in N.marked(d, "path", "text", keys(spark)).collect()}
    assert got == {"a4": "『공무원 여비 규정』 제3조 및 제4조와 「공무원 여비 규정」 제5조를 본다.", "a5": "제7조", "a6": None}
    marked = N.marked(d, "path", "text", keys(spark)).selectExpr("'d' AS id", "path", "text", "CAST(NULL AS STRING) AS heading")
    cites = P.cited(marked, "text", "id", "path", "heading", spark.createDataFrame([], "id string, abbreviation string, name string"))
    assert [(r["kind"], r["title"], r["target"]) for r in cites.filter("path = 'a4'").orderBy("place").collect()] == [("named", "공무원 여비 규정", "a3"), ("named", "공무원 여비 규정", "a4"), ("external", "공무원 여비 규정", "a5")]
