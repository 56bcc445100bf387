import random
import re

import numpy as np
import xxhash

from chronolex.llm import simhash as S

from .helpers import SF, awkward, clashing, documents


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """(doc_id, hex, component) for (doc_id, text)."""
    fps = [(d, fingerprint(t)) for d, t in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, f"{x:016x}", find(d)) for d, x in fps)


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in S.covering_masks()]
    assert len(masks) == 31
    rng = random.Random(5)
    for _ in range(20_000):
        diff = sum({1 << b for b in rng.sample(range(64), rng.randint(1, 4))})
        assert any(not diff & m for m in masks)


def test_spanning_links_connect_what_links_connect():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64)).sum(1, dtype=np.uint64) for c in centre]))
    got = {i: i for i in range(len(fps))}
    want = dict(got)

    def join(r, a, b):
        x, y = sorted((r[a], r[b]))
        for k in r:
            if r[k] == y:
                r[k] = x

    found = S.spanning_links(fps, 4)
    assert len(found) < len(fps)
    for a, b in found:
        join(got, a, b)
    for a in range(len(fps)):
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= 4:
                join(want, a, b)
    assert got == want


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(1)
    for k in range(60):  # chains of copies with a few words changed
        ws = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randint(0, 2)):
            ws[rng.randrange(len(ws))] = "changed"
        rows.append((10_000 + k, " ".join(ws)))
    rows += [(20_000, ""), (20_001, None), (20_002, " \n")]
    got = sorted(tuple(r) for r in S.digest(documents(spark, rows)).collect())
    assert got == brute(rows)
    assert sum(r[0] != r[2] for r in got) > 50


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = S.digest(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[900] == by[901] == by[904] == 900 and by[903] == 903
    assert {r.component_id for r in got if r.doc_id is None} == {900, None}
    assert S.digest(docs.limit(0)).count() == 0
