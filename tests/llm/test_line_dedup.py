import hashlib
from collections import defaultdict

from chronolex.llm import line_dedup as L

from .helpers import SF, awkward, clashing, documents, duck, rows

COLUMNS = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
LONG = "This passage stands in many documents and is long enough to count"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute(docs):
    """Digest rows for (doc_id, text), ids being distinct."""
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


PLANTED = [
    *[(k, f"own {k}\n  {LONG.upper() if k % 2 else LONG}\t\nend {k}\n{LONG}") for k in range(1, 8)],
    *[(20 + k, f"{LONG} in four documents only") for k in range(4)],
    *[(30 + k, "x" * 39) for k in range(6)],
    *[(40 + k, "é" * 40 + "\n") for k in range(6)],
    (50, f"{LONG} twice here\n" * 6),
    *[(60 + k, "ÀÉ" + "Z" * 40) for k in range(5)],
    *[(70 + k, "àé" + "z" * 40) for k in range(5)],
    (80, None),
    (81, ""),
    (82, "\n\n"),
]


def test_planted_lines(spark):
    got = rows(L.digest(documents(spark, PLANTED)), *COLUMNS)
    assert got == brute(PLANTED)
    dropped = {r[0]: r[2] for r in got}
    assert dropped[1] == 2 and dropped[7] == 0 and dropped[20] == dropped[30] == dropped[50] == 0 and dropped[40] == 1 and dropped[45] == 0


def test_keys_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_KEYS", 0)
    assert rows(L.digest(documents(spark, PLANTED)), *COLUMNS) == brute(PLANTED)


def test_agrees_with_its_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    names, want = duck(L.SQL, documents=docs.toPandas())
    assert rows(L.digest(docs), *names) == sorted(want)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark, [(k, LONG) for k in range(5)]))
    got = rows(L.digest(docs), *COLUMNS)
    assert len(got) == docs.count()
    by = defaultdict(set)
    for r in got:
        by[r[0]].add(r[1:3])
    assert by[900] == by[901] == {(1, 0)} and by[903] == {(2, 0)} and by[None] == {(1, 0)} and by[904] == {(2, 0)}
    assert [by[k] for k in range(5)] == [{(1, 1)}] * 4 + [{(1, 0)}]
    assert L.digest(docs.limit(0)).count() == 0


def test_rows_of_one_id_count_once(spark):
    """Five rows of one document don't make a line repeated; with four other documents they all lose or keep it."""
    twins = [(5, f"{LONG}\nrow {k}") for k in range(5)]
    assert all(r[2] == 0 for r in rows(L.digest(documents(spark, twins)), *COLUMNS))
    others = [(k, LONG) for k in range(6, 10)]
    assert [r[2] for r in rows(L.digest(documents(spark, twins + others)), *COLUMNS)] == [1] * 8 + [0]
