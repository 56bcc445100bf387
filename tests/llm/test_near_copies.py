import random

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import near_copies as N
from chronolex.llm import simhash as S

from .helpers import SF, awkward, clashing, documents


def grams(text):
    ws = (text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def brute(rows):
    sets = [(d, grams(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if similar(x, y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, find(d)) for d, _ in sets)


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def families(rng, first, size, length, edits):
    """Rows of one text with ``edits`` words changed in each copy."""
    words = [f"w{rng.randrange(5000)}" for _ in range(length)]
    return [(first + k, " ".join(edited(rng, words, edits if k else 0))) for k in range(size)]


def check(spark, rows):
    got = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(documents(spark, rows)).collect())
    assert got == brute(rows)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text.lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for k in range(12):
        rows += families(rng, 10_000 + 100 * k, 3, 150, k % 4)
    rows += [(20_000, ""), (20_001, None), (20_002, " \n"), (20_003, "two words"), (20_004, "two words"), (20_005, "two")]
    check(spark, rows)


def test_large_buckets_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 4)
    rng = random.Random(5)
    rows = families(rng, 0, 60, 200, 3)  # chains: copies are like the first one, less so like each other
    for k in range(6):
        rows += families(rng, 1000 + 100 * k, 20, 200, 1)
    common = " ".join(f"c{k}" for k in range(60))  # half of a text in common: shared buckets without a link
    rows += [(5000 + k, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40 + k % 3))) for k in range(60)]
    rows += [(6000 + k, t + " tail") for k, (_, t) in enumerate(rows[-20:])]
    check(spark, rows)


def test_covering_tables_find_pairs_without_a_common_band(spark):
    rng = random.Random(7)
    rows = [r for k in range(12) for r in families(rng, 10 * k, 2, 1500, 1)]
    docs = documents(spark, rows)
    d = N.sketched(docs).withColumn("bands", F.array("doc_id")).withColumnRenamed("doc_id", "rep")
    sims = {r.rep: r.sim for r in d.collect()}
    near = {(a, a + 1) for a in range(0, 120, 10) if ((sims[a] ^ sims[a + 1]) & (1 << 64) - 1).bit_count() <= S.RADIUS}
    assert len(near) > 6
    assert near <= {tuple(sorted(r)) for r in N.links(d, docs).collect()}


def test_pairs_of_a_group_are_compared():
    sets = [np.arange(a, a + 90, dtype=np.int64) for a in (0, 10, 11, 20, 500)]
    assert sorted(map(sorted, N.set_links(sets, np.ones(5, bool), np.arange(5)))) == [[0, 1], [1, 2], [1, 3]]
    assert N.set_links(sets, np.array([0, 0, 0, 0, 1], bool), np.arange(5)) == []


def test_stage_drops_copies_with_a_few_edits(spark):
    """Of such pairs most are further apart than op8's four bits."""
    rng = random.Random(6)
    rows = [r for k in range(40) for r in families(rng, 10 * k, 2, 1000, 10)]
    assert all(similar(grams(a[1]), grams(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True))
    kept = P.drop_near_duplicates(spark, documents(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(40)]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = N.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[900] == by[901] == by[904] == 900 and by[903] == 903
    assert {r.component_id for r in got if r.doc_id is None} == {900, None}
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_no_link_beyond_the_radius_of_the_fingerprints(spark, monkeypatch):
    rng = random.Random(8)
    docs = documents(spark, [r for k in range(6) for r in families(rng, 10 * k, 3, 300, 1)])
    assert {r.component_id for r in N.near_duplicates(docs).collect()} == {10 * k for k in range(6)}
    monkeypatch.setattr(N, "RADIUS", -1, raising=False)
    assert all(r.component_id == r.doc_id for r in N.near_duplicates(docs).collect())


def test_pairs_at_the_similarity_meet_by_fingerprints(spark):
    """Sets of all sizes at similarity 0.8 or little more, the hardest to find."""
    rng = random.Random(9)
    rows = []
    for k in range(400):
        n = (8, 11, 12, 13, 49, 200)[k % 6]
        cut = (1, 1, 2, 1, 9, 39)[k % 6]  # last words that the other one lacks
        words = [f"w{rng.randrange(10**6)}" for _ in range(n + cut)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:n]))]
    assert all(similar(grams(a[1]), grams(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True))
    d = N.sketched(documents(spark, rows)).withColumnRenamed("doc_id", "rep")
    assert {tuple(sorted(r)) for r in N.near_fingerprints(d, N.RADIUS).collect()} == {(2 * k, 2 * k + 1) for k in range(400)}
    check(spark, rows[:120])


def test_joins_get_no_link_for_each_bucket_of_a_node(spark, monkeypatch):
    """Copies of one text meet in most of the tables, so many tasks find the same group in other stars."""
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    seen, whole = [], N.components
    monkeypatch.setattr(N, "components", lambda links: seen.append(links.count()) or whole(links))
    monkeypatch.setattr(N, "FEW_LINKS", 0, raising=False)  # the joins, as for many links
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = families(random.Random(10), 0, 120, 120, 2) + [(1000, "one of its own")]
        assert {r.component_id for r in N.near_duplicates(documents(spark, rows)).collect()} == {0, 1000}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(seen) > 1
    assert max(seen) < 600


def test_connected_gives_the_components(spark, monkeypatch):
    rng = random.Random(11)
    nodes = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    links = [(nodes[a], nodes[b]) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(250))] + [(nodes[0], nodes[0])]
    frame = spark.createDataFrame(links, "u long, v long").repartition(7)
    monkeypatch.setattr(N, "LINKS_HELD", 5)
    want = sorted((r.node, r.root) for r in N.components(frame).collect())
    for few in (N.FEW_LINKS, 0):
        monkeypatch.setattr(N, "FEW_LINKS", few)
        assert sorted((r.node, r.root) for r in N.connected(frame).collect()) == want
    assert N.connected(frame.limit(0)).count() == 0
