import re
from collections import Counter

import pytest

from chronolex.llm import mixing as M

from .helpers import SF, awkward, clashing, documents, duck, rows

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def brute_targets(sizes):
    """Shares by weight; a source above its cap gets the cap, the excess is shared among the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[k % len(M.WEIGHTS)] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3 * sizes[s] for s in above)
        free -= above
    return out


def check(docs, got):
    """docs: (doc_id, text, source). Sizes and targets are right and each source's taken words are near its target."""
    size = {d: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    sizes = Counter()
    for d, s in source.items():
        sizes[s] += size[d]
    want, taken, largest = brute_targets(sizes), Counter(), Counter()
    for d, n, source_size, target, words in got:
        assert n == size[d] and source_size == sizes[source[d]] and target == pytest.approx(want[source[d]])
        assert 0 <= words <= 3 * n and (n == 0 or words % n == 0)
        taken[source[d]] += words
        largest[source[d]] = max(largest[source[d]], n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert len(got) == len(docs)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 7, None: 90}, {None: 5}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 300}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    got = rows(M.digest(docs), *COLUMNS)
    check([tuple(r) for r in docs.collect()], got)
    assert got == rows(M.digest(docs.repartition(7)), *COLUMNS)


def test_agrees_with_its_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, want = duck(M.SQL, documents=docs.toPandas())
    assert [r[:3] + r[4:] for r in rows(M.digest(docs), *COLUMNS)] == sorted(r[:3] + r[4:] for r in want)
    assert names == COLUMNS


def test_taken_documents_come_in_key_order(spark):
    docs = documents(spark, [(k, "word " * (k % 7 + 1), "en", f"s{k % 2}", 0) for k in range(400)])
    copies = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    for s in (0, 1):
        order = [copies[r.doc_id] for r in M.keyed(docs).orderBy("key").collect() if r.doc_id % 2 == s]
        assert sum(a < b for a, b in zip(order, order[1:], strict=False)) <= 1
        assert max(order) - min(order) <= 1


def test_expand_repeats_rows(spark):
    docs = documents(spark, [*[(k, f"text {k} of some words", "en", f"s{k % 3}", 0) for k in range(60)], *[(7, "text 7 of some words", "en", "s1", 0)] * 3])
    mixed = M.mix(docs)
    want = mixed.agg({"copies": "sum"}).first()[0]
    out = M.expand(docs, mixed)
    assert out.columns == docs.columns and out.count() == want


def test_awkward_rows(spark):
    docs = clashing(awkward(spark, [(k, "some words", "en", "s", 0) for k in range(20)]))
    got = M.digest(docs).collect()
    assert len(got) == docs.count()
    assert {(r.size, r.taken) for r in got if r.doc_id in (900, 901, 904)} == {(0, 0)}
    assert sum(r.taken for r in got) > 0
    assert M.digest(docs.limit(0)).count() == 0
    empty = M.digest(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in empty] == [(0, 0, 0.0, 0)] * 2
