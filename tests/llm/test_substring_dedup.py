import hashlib
import random
from collections import Counter

from chronolex.llm import substring_dedup as S

from .helpers import SF, awkward, clashing, documents


def brute(rows):
    seen = Counter()
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, t in texts:
        for i in range(len(t) - 399):
            seen[hash(t[i : i + 400])] += 1
    out = []
    for d, t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                cover[i : i + 400] = b"\x01" * 400
        left = bytes(c for c, gone in zip(t, cover, strict=True) if not gone)
        spans = sum(cover[i] and (i == 0 or not cover[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(cover), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefgh éß ") for _ in range(n))
    passages = [prose(k) for k in (399, 400, 401, 420, 432, 450, 470, 600, 900, 2000)]
    rows = [(i, prose(rng.randint(0, 900)) + rng.choice(passages) + prose(rng.randint(0, 900))) for i in range(120)]
    rows += [(200 + i, passages[-1][i * 7 : 700 + i * 31] + prose(50)) for i in range(20)]  # overlapping parts
    rows += [(300, "ab" * 700), (301, "x" * 401), (302, "y" * 400), (303, "same day " * 60), (304, prose(100) * 9)]
    rows += [(400 + i, passages[-2][: 880 - i] + "#" + passages[-2][-300 - i :]) for i in range(10)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, rows[3][1][1:]), (503, rows[4][1][:-1])]
    return rows


def test_planted_passages(spark):
    rows = planted()
    got = sorted((tuple(r) for r in S.digest(documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_sets_joined_instead_of_sent(spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(S, "SET_ROWS", 3)
    got = sorted((tuple(r) for r in S.digest(documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_filters_and_joined_runs(spark, monkeypatch):
    rows = planted()
    monkeypatch.setattr(S, "SET_ROWS", 3)
    monkeypatch.setattr(S, "SENT_DOCS", 3)
    got = sorted((tuple(r) for r in S.digest(documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_large_sets_write_no_texts(spark, monkeypatch, tmp_path):
    """Sets that are too large to send leave less in the shared folder than the texts are."""
    monkeypatch.setattr(S, "SET_ROWS", 3)
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        total = S.digest(docs).agg({"n_bytes": "sum"}).first()[0]
    finally:
        spark.sparkContext.setCheckpointDir(before.removeprefix("file:"))
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < total


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in S.digest(docs).collect()), key=str) == brute(rows)
    whole = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in whole.values())


def test_awkward_rows(spark):
    docs = clashing(awkward(spark, [(1, "z" * 500 + "1"), (1, "z" * 450 + "2"), (None, "q" * 10 + "".join(map(str, range(400))))]))
    got = sorted((tuple(r) for r in S.digest(docs).collect()), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])]
    assert S.digest(docs.limit(0)).count() == 0
