"""Evidence around seeds against a plain search of all paths."""

import datetime as dt
import random

from pyspark.sql import functions as F

from chronolex.operators import graph as G
from chronolex.plans import registry


def brute(edges, seeds, depth, most):
    out = []
    for s in seeds:
        found, frontier = {}, [s]
        for hop in range(1, depth + 1):
            new = {}
            for via in frontier:
                for src, dst, rank, stale in edges:
                    if src == via and dst != s and dst not in found:
                        new[dst] = min(new.get(dst, (99, "~", False)), (rank, via, stale), key=lambda x: x[:2])
            for n, (rank, via, stale) in new.items():
                found[n] = (hop, rank, via, stale)
            frontier = [n for n, x in new.items() if not x[2]]
        best = sorted(found.items(), key=lambda x: (x[1][0], x[1][1], x[0]))[:most]
        out += [(s, n, *x, k) for k, (n, x) in enumerate(best, 1)]
    return sorted(out)


def test_random_graphs(spark):
    for seed in range(4):
        r = random.Random(seed)
        stale = {f"n{k}" for k in range(0, 40, 7)}
        edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.randint(1, 3)) for _ in range(160)] + [("n1", f"n{k}", 2) for k in range(40)]
        edges = [(*e, e[1] in stale) for e in edges if e[0] != e[1]]
        seeds = ["n1", "n2", "n3", "n39", "absent"]
        d = spark.createDataFrame(edges, "src string, dst string, rank int, stale boolean")
        s = spark.createDataFrame([(x, x) for x in seeds], "seed string, node string")
        for depth, most in ((1, 5), (3, 4), (3, 12), (3, 100)):
            got = sorted((x["seed"], x["node"], x["hops"], x["rank"], x["via"], x["stale"], x["place"]) for x in G.evidence(d, s, depth, most).collect())
            assert got == brute(edges, seeds, depth, most), (seed, depth, most)


def test_redated(spark):
    day = dt.date
    versions = [("a1", "a", None, day(2020, 1, 1)), ("a2", "a", day(2020, 1, 1), None), ("b1", "b", day(2020, 1, 1), day(2021, 1, 1)), ("c1", "c", None, None)]
    v = spark.createDataFrame(versions, "node string, lineage string, valid_from date, valid_to date")
    e = spark.createDataFrame([("x", "a1"), ("x", "a2"), ("x", "b1"), ("x", "c1"), ("x", "free")], "src string, dst string")
    got = lambda at: sorted((r["dst"], r["stale"]) for r in G.redated(e, v, F.lit(at)).collect())
    assert got(day(2020, 6, 1)) == [("a2", False), ("a2", False), ("b1", False), ("c1", False), ("free", False)]
    assert got(day(2019, 6, 1)) == [("a1", False), ("a1", False), ("b1", True), ("c1", False), ("free", False)]
    assert got(day(2021, 1, 1))[2] == ("b1", True)


def test_reach_counts_what_expand_finds(spark):
    """Hubs, nulls, negative and very long numbers, names that sort unlike their numbers, nodes that lead nowhere."""
    far = [0, 5, 7, 10, 100, 1000, 11, 2, -3, -30, 2**62, 9_000_000_000_000_000_000, -(2**63), None]
    first = [(s, (s * 7 + k * k) % 23 - 2, (s + k) % 5) for s in range(40) for k in range(s % 9)] + [(1, None, 3), (1, None, 2), (50, None, None), (-4, 10, None), (None, 10, 1), (60, 999, 4), (7, 2**60, -1)]
    first += [(70, n, 1) for n in range(2000)]
    second = [(n, far[(n * 5 + j * j) % len(far)], j - 3) for n in range(-2, 21) for j in range(n % 6)] + [(30, None, None), (None, 5, 1), (2**60, 9, None)] + [(n, n % 700 * 10**15, 8) for n in range(100, 2000)]
    a = spark.createDataFrame(first, "seed long, node long, prio int").repartition(5)
    b = spark.createDataFrame(second, "src long, dst long, prio int").repartition(3)
    got = sorted((tuple(r) for r in G.reach(a, b, "p", "s").collect()), key=repr)
    want = {}
    for hops, letter, rows in ((1, "p", [(s, n, p) for s, n, p in first]), (2, "s", [(s, d, q) for s, n, _ in first for m, d, q in second if n is not None and n == m])):
        for s, n, p in rows:
            if s is not None:
                nodes, best = want.setdefault((s, hops, letter), (set(), []))
                nodes.add(n)
                best.append(p)
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    want = [(s, hops, len(nodes), least([None if n is None else f"{letter}{n}" for n in nodes]), least(best)) for (s, hops, letter), (nodes, best) in want.items()]
    assert got == sorted(want, key=repr)


def test_two_hops_shuffle_no_pair_of_seed_and_last_node(spark):
    """A customer's suppliers travel packed: what the query shuffles has no column for them."""
    plan = registry.queries()["graph_expand_2hop"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_set" in plan and plan.count("Aggregate") == 1

