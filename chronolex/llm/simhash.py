"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A covering family (Pagh) for radius r: bit position i gets a non-zero vector m(i) of r + 1 bits, and
every non-zero v of r + 1 bits is a table that keeps the positions with <m(i), v> = 1 (mod 2). Any r
positions leave some v orthogonal to all their vectors, so two fingerprints at distance r or less
agree on all positions that this table keeps: every such pair meets in some bucket.

Copies are collapsed to distinct fingerprints first. A bucket is searched from seed to seed: each
fingerprint found is compared with those not yet reached only, so a dense bucket costs little, and
links that span a bucket's parts are returned, never all its pairs. A task holds one bucket's distinct
fingerprints, 28 bytes each: they agree on half of the bits, so only a family of near copies fills a
bucket, and one text has at most 679,121 fingerprints within four bits (19 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import cut, slices
from chronolex.llm.components import components

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Buckets up to this size are compared side by side with their neighbours in sorted order.
SMALL = 4


def shingle_hashes(text: str | None, size: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words in lower case (A-Z only); a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """64-bit fingerprint of each text's shingle hashes: a bit is set if it is set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    if not hashes:
        return out
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(hashes)), counts)
    for k in range(8):
        byte = ((flat >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        seen = np.bincount(owner * 256 + byte, minlength=len(hashes) * 256).reshape(-1, 256) @ BIT_OF_BYTE
        bits = (2 * seen > counts[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def fingerprinted(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The kept columns with ``fp`` as a signed 64-bit integer; no shuffle."""
    names = [c.split(" ")[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            rows = b.column("text").to_pylist()
            fp = np.concatenate([fingerprints([shingle_hashes(t) for t in rows[i : i + 512]]) for i in range(0, len(rows), 512)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{keep}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks, as signed 64-bit integers."""
    n = (1 << radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if (i % n + 1 & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def covering_keys(fp: Column, radius: int = RADIUS) -> Column:
    """What each covering table keeps of the fingerprint: its bucket there."""
    return F.array(*[fp.bitwiseAND(F.lit(m)) for m in covering_masks(radius)])


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (root, other) that connect what links connect among the fingerprints."""
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        frontier = [root]
        while frontier and len(rest):
            p = frontier.pop()
            near = np.bitwise_count(fps[rest] ^ fps[p]) <= radius
            if near.any():
                hit = rest[near].tolist()
                links += [(root, h) for h in hit]
                frontier += hit
                rest = rest[~near]
    return links


def bucket_links(table: np.ndarray, part: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows that are sorted by bucket (table, part)."""
    new = np.concatenate([[True], (table[1:] != table[:-1]) | (part[1:] != part[:-1])])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fps)))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    us, vs = [], []
    for lag in range(1, SMALL):
        if len(fps) > lag:
            ok = (group[lag:] == group[:-lag]) & small[lag:]
            ok[ok] = np.bitwise_count(fps[lag:][ok] ^ fps[:-lag][ok]) <= radius
            us.append(ids[lag:][ok])
            vs.append(ids[:-lag][ok])
    for g in np.flatnonzero(sizes > SMALL):
        own = slice(starts[g], starts[g] + sizes[g])
        if found := spanning_links(fps[own], radius):
            pairs = ids[own][np.array(found)]
            us.append(pairs[:, 0])
            vs.append(pairs[:, 1])
    return (np.concatenate(us), np.concatenate(vs)) if us else (ids[:0], ids[:0])


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) over the ids of distinct fingerprints (columns fp, rep): links of distance ``radius`` or less, or a set that connects the same."""
    rows = classes.select("fp", "rep", F.posexplode(covering_keys(F.col("fp"), radius)).alias("table", "part"))
    rows = rows.repartition("table", "part").sortWithinPartitions("table", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the last bucket so far, as it may go on in the next batch
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in ("table", "part", "fp", "rep")]
            if not len(rows[0]):
                continue
            if held and (held[0][0][0] != rows[0][0] or held[0][1][0] != rows[1][0]):
                yield answer(held)
                held = []
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield answer([*held, [x[:end] for x in rows]])
                held = []
            held.append([x[end:] for x in rows])
        if held:
            yield answer(held)

    def answer(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip(*pieces, strict=True)]
        u, v = bucket_links(rows[0], rows[1], rows[2].view(np.uint64), rows[3], radius)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The kept columns (doc_id among them) with ``fp`` and ``component_id``, the smallest doc_id reachable over links.

    Null and blank texts have fingerprint zero and link like any other. A row without doc_id takes its
    component from the documents of its fingerprint (null if all lack ids) and links nothing itself.
    Rows that share an id count as one document. Ties, repeated rows and clashing extra columns don't
    matter; an empty table gives no rows.
    """
    d = cut(fingerprinted(docs, keep))
    classes = d.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(cut(classes.filter("rep IS NOT NULL")))).select(F.col("node").alias("rep"), "root")
    shared = d.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")).join(found, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return d.join(shared, "fp", "left")


def hex_of(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, fingerprint, component_id; nulls, empty and long texts, ties, repeated rows and empty tables as in ``near_duplicates``."""
    return near_duplicates(docs).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
