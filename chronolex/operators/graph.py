"""Property graph as vertex and edge frames: bounded traversals as unrolled equi-joins."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def expand(edges: DataFrame, seeds: DataFrame, depth: int, priority: str, seed: str = "seed") -> DataFrame:
    """(seed, node, hops, priority) of every node within ``depth`` hops, at its fewest hops and best priority.

    edges: src, dst and a 32-bit priority (small is good). Each hop is one join of the frontier and one
    hash aggregation of (hops, priority) packed in a long; nodes that were reached before are not in the
    next frontier, so a hub is expanded once per seed.
    """
    place = lambda hops, best: F.shiftleft(hops.cast("long"), 32) + best.cast("long") + (1 << 31)
    reached = seeds.select(F.col(seed), F.col("node"), place(F.lit(0), F.lit(0)).alias("_at")).distinct()
    for hop in range(1, depth + 1):
        frontier = reached.filter(F.shiftright("_at", 32) == hop - 1).select(seed, F.col("node").alias("src"))
        step = frontier.join(edges, "src").select(seed, F.col("dst").alias("node"), place(F.lit(hop), F.col(priority)).alias("_at"))
        reached = reached.unionByName(step).groupBy(seed, "node").agg(F.min("_at").alias("_at"))
    best = F.col("_at").bitwiseAND((1 << 32) - 1) - (1 << 31)
    out = reached.select(seed, "node", F.shiftright("_at", 32).cast("int").alias("hops"), best.cast("int").alias(priority))
    return out.filter("hops > 0")


def reach(first: DataFrame, second: DataFrame, near: str, far: str) -> DataFrame:
    """(seed, hops, nodes, first_node, best): how many nodes each seed reaches by one edge and by two, the least by name, the best priority.

    first: seed, node, prio; second: src (a node of first), dst, prio; all long, but for the 32-bit priorities. Nodes are named by a letter and
    their number, ``near`` those of the first hop, ``far`` those of the second; the letters differ, so the hops never meet. A null node counts as one,
    a null seed is none. What a node leads to is packed once (differences of its sorted numbers, in as few bytes as they take), so a pair that is
    shuffled holds a byte or two for each node behind it. The nodes of one seed are merged in memory.
    """
    if near == far:
        raise ValueError("the nodes of both hops have one name")
    onward = second.filter("src IS NOT NULL").select("src", "dst", "prio").repartition("src").groupBy("src")
    packed = onward.agg(F.collect_set("dst").alias("dst"), F.max(F.col("dst").isNull()).alias("none"), F.min("prio").alias("prio")).mapInArrow(_packs, "_src long, _set binary")
    met = first.filter("seed IS NOT NULL").select("seed", "node", "prio").join(packed, F.expr("node = _src"), "left").select("seed", "node", "prio", "_set")
    n = met.repartition("seed").sortWithinPartitions("seed").mapInArrow(_merges, "seed long, hops int, nodes long, _first long, best int")
    name = F.concat(F.when(F.col("hops") == 1, near).otherwise(far), F.col("_first").cast("string"))
    return n.select("seed", "hops", "nodes", name.alias("first_node"), "best")


NO_PRIORITY = 1 << 40


def _least_by_name(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of x (none is empty) the number whose decimals come first as text."""
    if (x < 0).any():
        return np.array([min(run.tolist(), key=str) for run in np.split(x, starts[1:])], np.int64)
    tens = np.array([10**k for k in range(19)], np.int64)
    digits = np.maximum(np.searchsorted(tens, x, "right"), 1)
    left = x.astype(np.uint64) * tens.astype(np.uint64)[19 - digits]  # the decimals, filled up to 19 with zeros
    least = np.repeat(np.minimum.reduceat(left, starts), np.diff(np.append(starts, len(x))))
    return np.minimum.reduceat(np.where(left == least, x, np.iinfo(np.int64).max), starts)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).view(np.int64)


def _to_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers by seven bits a byte, the lowest first, and the bytes of each."""
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1 << (7 * k))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        more = np.where(size[on] > k + 1, 128, 0).astype(np.uint8)
        out[at[on] + k] = ((x[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def _from_bytes(b: np.ndarray) -> np.ndarray:
    last = b < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    k = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * k).astype(np.uint64), starts)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set by node: flags (1 for a null among it, 2 for a priority), the priority, which is first by name, the numbers."""
    for batch in batches:
        sets, n = batch.column("dst"), batch.num_rows
        if not n:
            continue
        size = sets.value_lengths().to_numpy(zero_copy_only=False)
        x, row = sets.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), size)
        x = x[np.lexsort((x, row))]
        begin = np.cumsum(size) - size
        filled = size > 0
        lead = np.zeros(n, np.int64)
        if filled.any():
            firsts = np.zeros(n, np.int64)
            firsts[filled] = _least_by_name(x, begin[filled])
            lead[row[x == firsts[row]]] = (np.arange(len(x)) - begin[row])[x == firsts[row]]
        steps = np.append(np.int64(0), x[1:] - x[:-1])[: len(x)].view(np.uint64)
        steps[begin[filled]] = _zigzag(x[begin[filled]])
        prio = batch.column("prio")
        flags = batch.column("none").to_numpy(zero_copy_only=False).astype(np.uint64) | np.where(prio.is_valid().to_numpy(zero_copy_only=False), 2, 0).astype(np.uint64)
        head = np.stack([flags, _zigzag(prio.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), lead.astype(np.uint64)], 1)
        at = begin + 3 * np.arange(n)
        every = np.zeros(len(x) + 3 * n, np.uint64)
        every[(at[:, None] + np.arange(3)).ravel()] = head.ravel()
        every[np.arange(len(x)) + 3 * (row + 1)] = steps
        b, of = _to_bytes(every)
        ends = np.append(0, np.add.reduceat(of, at).cumsum()).astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(b)])
        yield pa.RecordBatch.from_arrays([batch.column("src"), out], ["_src", "_set"])


def _merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their seeds; those of a seed wait until it ends."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seed = batch.column("seed").to_numpy()
        cut = int(_runs(seed)[-1])
        if waiting and (cut or waiting[-1].column("seed")[0].as_py() != seed[0]):
            yield _merged(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        elif cut:
            yield _merged(pa.Table.from_batches([batch.slice(0, cut)]))
        waiting.append(batch.slice(cut))
    if waiting:
        yield _merged(pa.Table.from_batches(waiting))


def _merged(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    seed, node, prio, sets = (t.column(c).combine_chunks() for c in ("seed", "node", "prio", "_set"))
    if isinstance(sets, pa.ChunkedArray):
        raise ValueError("a seed's nodes lead to more than 2 GB")
    seed = seed.to_numpy(zero_copy_only=False)
    starts = _runs(seed)
    seeds = len(starts)
    run = np.repeat(np.arange(seeds), np.diff(np.append(starts, len(seed))))

    def best(run: np.ndarray, prio: np.ndarray) -> np.ndarray:
        out = np.full(seeds, NO_PRIORITY)
        if len(run):
            at = _runs(run)
            out[run[at]] = np.minimum.reduceat(prio, at)
        return out

    def least(run: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, none = np.zeros(seeds, np.int64), np.ones(seeds, bool)
        if len(run):
            at = _runs(run)
            out[run[at]], none[run[at]] = _least_by_name(x, at), False
        return out, none

    def different(run: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(seeds, np.int64)
        low, span = int(x.min()), int(x.max()) - int(x.min()) + 1
        if span * seeds < 1 << 62:
            k = np.sort(run * np.int64(span) + (x - np.int64(low)))
            return np.bincount(k[_runs(k)] // np.int64(span), minlength=seeds)
        order = np.lexsort((x, run))
        run, x = run[order], x[order]
        return np.bincount(run[np.append(True, (run[1:] != run[:-1]) | (x[1:] != x[:-1]))], minlength=seeds)

    known = node.is_valid().to_numpy(zero_copy_only=False)
    nodes = node.fill_null(0).to_numpy(zero_copy_only=False)
    near = different(run[known], nodes[known]) + (np.bincount(run[~known], minlength=seeds) > 0)
    near_first = least(run[known], nodes[known])
    near_best = best(run, prio.cast(pa.int64()).fill_null(NO_PRIORITY).to_numpy(zero_copy_only=False))

    has = sets.is_valid().to_numpy(zero_copy_only=False)
    sets, of = sets.drop_null(), run[has]
    far, far_first, far_best = np.zeros(seeds, np.int64), (np.zeros(seeds, np.int64), np.ones(seeds, bool)), np.full(seeds, NO_PRIORITY)
    if len(sets):
        ends = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
        b = np.frombuffer(sets.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        stop = np.cumsum(b < 128)[ends[1:] - ends[0] - 1]  # numbers up to the end of each set
        every, at = _from_bytes(b), np.append(0, stop[:-1])
        size = stop - at - 3
        flags = every[at]
        body = np.ones(len(every), bool)
        body[(at[:, None] + np.arange(3)).ravel()] = False
        steps = every[body].view(np.int64)
        begin, filled = np.cumsum(size) - size, size > 0
        steps[begin[filled]] = _unzigzag(steps[begin[filled]].view(np.uint64))
        x = np.cumsum(steps)
        x -= np.repeat((x[begin[filled]] - steps[begin[filled]]) if filled.any() else np.zeros(0, np.int64), size[filled])
        far = different(np.repeat(of, size), x) + (np.bincount(of[(flags & np.uint64(1)) > 0], minlength=seeds) > 0)
        far_first = least(of[filled], x[(begin + every[at + 2].view(np.int64))[filled]])
        far_best = best(of, np.where((flags & np.uint64(2)) > 0, _unzigzag(every[at + 1]), NO_PRIORITY))
    two = far > 0
    both = lambda a, b: np.concatenate([a, b[two]])
    firsts, nones, bests = both(near_first[0], far_first[0]), both(near_first[1], far_first[1]), both(near_best, far_best)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(both(seed[starts], seed[starts])), pa.array(np.concatenate([np.full(seeds, 1, np.int32), np.full(int(two.sum()), 2, np.int32)])), pa.array(both(near, far).astype(np.int64)),
            pa.array(firsts, mask=nones), pa.array(np.where(bests == NO_PRIORITY, 0, bests).astype(np.int32), mask=bests == NO_PRIORITY),
        ],
        ["seed", "hops", "nodes", "_first", "best"],
    )


def redated(edges: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """The edges with dst moved to the version of its lineage that is valid at a date, and ``stale`` where there is none.

    versions: node, lineage, valid_from, valid_to (null bounds are open, the end is not within). An edge keeps a stale dst as it is;
    nodes without a version are valid as they are.
    """
    within = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    now = versions.filter(within).groupBy("lineage").agg(F.max_by("node", F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))).alias("_now"))
    known = versions.select(F.col("node").alias("dst"), "lineage").join(now, "lineage", "left").select("dst", "_now", F.lit(True).alias("_known"))
    d = edges.join(known, "dst", "left")
    stale = F.col("_known").isNotNull() & F.col("_now").isNull()
    return d.withColumn("stale", stale).withColumn("dst", F.coalesce("_now", "dst")).drop("_now", "_known")


def evidence(edges: DataFrame, seeds: DataFrame, depth: int, most: int, seed: str = "seed") -> DataFrame:
    """(seed, node, hops, rank, via, stale, place): the ``most`` best nodes around each seed, by hops, then rank, then node.

    edges: src, dst, rank (small is good), stale (of dst; nothing is reached over it). Nearer nodes come first, so a seed that has
    enough is not expanded any further, and one that hasn't has fewer than ``most`` nodes to expand. Of a node's edges the 2 * most + 1
    best are enough: of those before one that is wanted at most ``most`` were found already, one is the seed, and the others are
    wanted themselves. So a hop moves seeds * most * (2 * most + 1) rows at most, whatever the degree of hubs.
    """
    best = Window.partitionBy("src").orderBy("rank", "dst")
    one = edges.groupBy("src", "dst").agg(F.min("rank").alias("rank"), F.max("stale").alias("stale"))
    few = one.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= 2 * most + 1).drop("_k")
    order = Window.partitionBy(seed).orderBy("hops", "rank", "node")
    reached, frontier = None, seeds.select(seed, "node").distinct()
    for hop in range(1, depth + 1):
        step = frontier.withColumnRenamed("node", "via").join(few.withColumnRenamed("src", "via"), "via").filter(F.col("dst") != F.col(seed))
        step = step.select(seed, F.col("dst").alias("node"), F.struct(F.lit(hop).alias("hops"), "rank", "via").alias("_at"), "stale")
        every = (step if reached is None else reached.select(seed, "node", F.struct("hops", "rank", "via").alias("_at"), "stale").unionByName(step)).repartition(seed)
        reached = every.groupBy(seed, "node").agg(F.min("_at").alias("_at"), F.max("stale").alias("stale")).select(seed, "node", "_at.*", "stale")
        reached = reached.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        held = F.count("*").over(Window.partitionBy(seed))
        frontier = reached.withColumn("_n", held).filter((F.col("_n") < most) & (F.col("hops") == hop) & ~F.col("stale")).select(seed, "node")
    return reached


def limited(nodes: DataFrame, seed: str, order: list, most: int) -> DataFrame:
    w = Window.partitionBy(seed).orderBy(*order)
    return nodes.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def ancestors(parents: DataFrame, levels: int) -> DataFrame:
    """(node, ancestor, distance) up to so many levels of (node, parent); the node itself is at distance 0."""
    up = parents.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    out = [up]
    for k in range(1, levels + 1):
        up = up.join(parents.select(F.col("node").alias("ancestor"), "parent"), "ancestor").filter("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(k).alias("distance"))
        out.append(up)
    return reduce(DataFrame.unionByName, out)


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per label and per relation."""
    v = vertices.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return v.unionByName(edges.groupBy(F.col("rel").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def changed_subgraphs(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose fingerprint is new, differs, or is gone: what an incremental projection has to redo."""
    j = before.select(key, F.col(digest).alias("_b")).join(after.select(key, F.col(digest).alias("_a")), key, "full_outer")
    how = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").otherwise("changed")
    return j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, how.alias("how"))
