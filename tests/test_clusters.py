"""Nearest vectors by clusters against all pairs: what is left out never matters, and clustered data leave much out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.operators import clusters as V


def brute(rows, asks, n, allowed=lambda r: True):
    out = []
    for q, v in asks:
        if v is None or not any(v):
            continue
        v = np.array(v)
        best = sorted((-round(float(v @ np.array(x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), i) for i, x, label in rows if x is not None and any(x) and np.isfinite(x).all() and allowed(label))
        out += [(q, i, -s, k) for k, (s, i) in enumerate(best[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("piece", [20_000, 7])
def test_exact_and_selective(spark, monkeypatch, piece):
    monkeypatch.setattr(V, "PIECE", piece)
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(6, 8))
    rows = [(k, (middle[k % 6] + 0.05 * rng.normal(size=8)).tolist(), k % 4) for k in range(300)]
    rows += [(900 + k, rows[0][1], 1) for k in range(4)] + [(950, None, 0), (951, [0.0] * 8, 0), (952, [float("nan")] + [1.0] * 7, 0)]
    asks = [(k, (middle[k] + 0.05 * rng.normal(size=8)).tolist()) for k in range(6)] + [(7, (-middle[0]).tolist()), (8, None), (9, [0.0] * 8), (10, rows[0][1])]
    d, a = spark.createDataFrame(rows, "id int, x array<double>, label int"), spark.createDataFrame(asks, "q int, v array<double>")
    centres = V.centres_of(d, "x", 12)
    lists = V.assigned(d, "x", centres)
    for n, allowed, keep in ((5, None, lambda _: True), (400, None, lambda _: True), (3, F.col("label") == 2, lambda x: x == 2)):
        s = V.Search(lists, centres, a, "q", "v", "id", "x", n, allowed)
        got = sorted((r["q"], r["id"], r["score"], r["rank"]) for r in s.hits().collect())
        want = brute(rows, asks, n, keep)
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)
        if n == 5:
            shares = {r["q"]: r["compared"] / r["rows"] for r in s.report().collect()}
            assert max(shares[k] for k in range(6)) < 0.5
    none = V.Search(lists.filter("false"), centres, a, "q", "v", "id", "x", 3)
    assert none.hits().count() == 0
    assert len(V.centres_of(d.filter("false"), "x", 4)) == 0
