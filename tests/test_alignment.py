"""Quotes with planted edits, held against a plain search over all windows."""

import random
import re

import pytest

from chronolex.functions import alignment as A
from chronolex.operators import alignment as O


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(quote, text, coverage=0.9, min_chars=8):
    """(start, end, edits) in the text as it stands, or None."""
    q = "".join((quote or "").split())
    at = [k for k, c in enumerate(text or "") if not c.isspace()]
    t = "".join(text[k] for k in at)
    d = int(len(q) * (1 - coverage) + 1e-9)
    if len(q) < min_chars:
        return None
    ends = {}
    for s in range(len(t)):
        for e in range(s + max(len(q) - d, 1), min(s + len(q) + d, len(t)) + 1):
            n = edit_distance(q, t[s:e])
            if n <= d:
                ends[e] = min(ends.get(e, (99, 0)), (n, -s))
    found = []
    for e, (n, s) in ends.items():
        s = -s
        cut = (s and t[s - 1].isdecimal() and t[s].isdecimal()) or (e < len(t) and t[e - 1].isdecimal() and t[e].isdecimal())
        if re.findall("[0-9]+", t[s:e]) == re.findall("[0-9]+", q) and not cut:
            found.append((n, e, s))
    if not found:
        return None
    n, e, s = min(found)
    return at[s], at[e - 1] + 1, n


def planted(seed, n, length):
    r = random.Random(seed)
    letters = "가나다라마바사 \n12"
    out = []
    for _ in range(n):
        text = "".join(r.choice(letters) for _ in range(length))
        a = r.randrange(max(length - 45, 1))
        quote = list(text[a : a + r.randint(6, 45)])
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(quote) + 1)
            kind = r.random()
            if kind < 0.3 and quote:
                del quote[min(k, len(quote) - 1)]
            elif kind < 0.6:
                quote.insert(k, r.choice("가나x3"))
            elif quote:
                quote[min(k, len(quote) - 1)] = r.choice("다라y")
        out.append(("".join(quote), text))
    return out


def test_distances():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 80))) for _ in range(2))
        assert list(A.distances(a, b, True)) == [edit_distance(a, b[:k]) for k in range(1, len(b) + 1)]
        assert list(A.distances(a, b, False)) == [min(edit_distance(a, b[s:k]) for s in range(k + 1)) for k in range(1, len(b) + 1)]


def test_planted_edits(spark):
    rows = [(k, q, t) for k, (q, t) in enumerate(planted(1, 150, 90))] + [(900, None, "text"), (901, "a quote", None), (902, "", ""), (903, "short", "short")]
    got = {r["k"]: r for r in O.aligned(spark.createDataFrame(rows, "k int, q string, t string"), "q", "t").collect()}
    assert sum(r["start"] is not None for r in got.values()) > 40
    for k, q, t in rows:
        want = brute(q, t)
        r = got[k]
        assert (None if r["start"] is None else (r["start"], r["end"], r["edits"])) == want, (q, t)
        assert r["piece"] == (t[want[0] : want[1]] if want else None)


def test_open_search_finds_the_same(spark, monkeypatch):
    pairs = planted(2, 25, 70)
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(pairs)] + [(99, None), (98, "")], "doc int, t string")
    quotes = spark.createDataFrame([(100 + k, q) for k, (q, _) in enumerate(pairs)] + [(400, None), (401, "tiny")], "id int, q string")
    want = {(d, 100 + k): brute(q, t) for d, (_, t) in enumerate(pairs) for k, (q, _) in enumerate(pairs)}
    want = {k: v for k, v in want.items() if v}
    for block, piece in ((1000, 1 << 20), (7, 16)):
        monkeypatch.setattr(O, "SLICE", piece)
        got = {(r["doc"], r["id"]): (r["start"], r["end"], r["edits"]) for r in O.found_quotes(texts, "doc", "t", quotes, "id", "q", block=block).collect()}
        assert got == want
    assert O.found_quotes(texts.limit(0), "doc", "t", quotes, "id", "q").count() == 0
    assert O.found_quotes(texts, "doc", "t", quotes.limit(0), "id", "q").count() == 0


@pytest.mark.parametrize(("quote", "piece"), [
    ("여행자는 여행을 마친 다음날부터 열흘 안에 서류를 내야 한다", "여행자는 여행을 마친 다음 날부터 열흘 안에 서류를 내야 한다"),
    ("여행자는 여행을 마친 다음 날부터 열흘 안에 서류를 내지 않아도 된다", None),
    ("서류를 내야 한다. 영수증은 30일 안에 낸다", None),
    ("영수증은 20일 안에 낸다. 나머지", None),
    ("그 밖의 일은 그때그때 정하지 아", None),
])
def test_meaning_must_not_turn(spark, quote, piece):
    """Numbers, negations and lines as answers are held to."""
    text = "여행자는 여행을 마친 다음 날부터 열흘 안에 서류를 내야 한다.\n영수증은 30일 안에 낸다. 나머지는 없다.\n그 밖의 일은 그때그때 정하지 아니한다."
    pairs = spark.createDataFrame([(quote, text)], "q string, t string")
    assert O.aligned(pairs, "q", "t", one_line=True, counted="아니|않|없|못", tail=r"[^\n]{0,30}?(?:다\.|$)").first()["piece"] == piece
