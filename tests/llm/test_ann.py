import math

import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import ann as A

from .helpers import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, near=5):
    """{query position: [(vec_id, score)]} over usable rows."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for k, (i, v) in enumerate(ok):
        if i % 50 == 0:
            others = [(j, float(v @ w / math.sqrt(v @ v * (w @ w)))) for n, (j, w) in enumerate(ok) if n != k and len(w) == len(v)]
            out.append((i, sorted(others, key=lambda x: (-round(x[1], 12), x[0]))[:near]))
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0] * 8) for i in range(30)] + [(50, None), (300, [0.0] * 8), (350, [1.0] * 7 + [None]), (400, [math.nan] * 8), (None, [1.0] * 8), (450, [math.inf] + [0.0] * 7), (500, []), (550, [1.0, 2.0]), (551, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("h1", "h2", "ids", "dim", "score", "part", "rank")})
    got = {}
    for r in A.digest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: n for q, n in brute(rows) if n}
    assert got.keys() == want.keys()
    share = []
    for q, near in want.items():
        share.append(len({i for i, _ in got[q]} & {i for i, _ in near}) / len(near))
        for (_, a), (_, b) in zip(got[q], near, strict=False):
            assert abs(a - b) < 1e-9 or a < b
    assert sum(share) / len(share) >= 0.9
    assert got[200] == [(201, 1.0), (202, 1.0), (203, 1.0), (204, 1.0), (205, 1.0)] or [i for i, _ in got[200]] == [201, 202, 203, 204, 205]
    assert A.digest(df.limit(0)).count() == 0


def test_recall_against_brute_force(spark):
    v = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in v.collect()])
    got = {}
    for r in A.digest(v).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = [len(got[q] & {i for i, _ in near}) / 5 for q, near in want]
    assert sum(share) / len(share) >= 0.92
    again = {(r.query_id, r.rank): r.vec_id for r in A.digest(v.repartition(5)).collect()}
    assert {k: set() for k, _ in again} is not None and all(again[q, r] in got[q] for q, r in again)


def test_parts_split_a_tree(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = {tuple(r) for r in A.digest(v).collect()}
    monkeypatch.setattr(A, "PART_ROWS", 100)
    assert {tuple(r) for r in A.digest(v).collect()} == whole
