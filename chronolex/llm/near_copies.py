"""SimHash near-dedup under a rule of similarity: five-word shingles of exact Jaccard similarity 0.8 or more.

Documents with the same set of shingles collapse first. A pair of similarity SIMILARITY differs in each
bit of its fingerprints with a chance of 0.15, so 64 bits with a radius of four miss most such pairs;
the fingerprints here have BITS bits. They are cut into PARTS parts, and each part has the covering tables of
``simhash`` for radius COVERED: two fingerprints that differ in so many bits of some part meet in a
bucket for certain, which holds for all within PARTS * (COVERED + 1) - 1 bits; of pairs at SIMILARITY
3 in a million meet in none, of more similar ones fewer. What meets is compared by the distance of the
fingerprints' first WORDS_COMPARED words, as in ``simhash`` from seed to seed: up to RADIUS they link; a pair at
SIMILARITY has 29 in the mean, standard deviation 5, an unlike one 96 and 7. Components of more than CHUNK
documents go through the tables again with whole fingerprints, which link up to WHOLE_RADIUS (127 in the mean,
standard deviation 10), so that documents with a passage in common part.

The components of these links are then checked exactly, and only links that were checked on the whole sets are
returned. Components of up to CHUNK documents are searched whole. Larger ones are searched in chunks that share
one document; what this leaves in other components than that document is then compared with all chunks of
the large one, so no pair of it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import at_most, cut, slices
from chronolex.llm.components import components
from chronolex.llm.simhash import SEED, covering_keys, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Parts of a fingerprint, bits of a part, and the radius that a part's covering tables are for.
PARTS, PART_BITS, COVERED = 42, 20, 1
BITS = PARTS * PART_BITS
#: Words of a fingerprint.
ALL_WORDS = -(-BITS // 64)
#: Words whose distance is compared, and the largest one of a link.
WORDS_COMPARED, RADIUS = 3, 55
#: The largest distance of whole fingerprints.
WHOLE_RADIUS = 180
#: Fingerprint bits that are made from one byte of the shingles' hashes.
VOTED = 32
#: Fingerprints of a bucket up to this number are compared side by side.
SMALL = 128
#: Documents of a group that are searched side by side.
CHUNK = 128
#: Links that a task holds at most before it sends their stars.
LINKS_HELD = 1_000_000
#: Rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Links up to this number (2 MB) are connected in one task, more by rounds of joins.
FEW_LINKS = BROADCAST_ROWS // 2


def voters() -> np.ndarray:
    """[byte of the hashes, its value, bit]: how a shingle votes on a bit, normally distributed; votes of all values add up to zero.

    Whole numbers, so sums are exact and don't depend on their order.
    """
    votes = np.rint(np.random.default_rng(SEED).normal(0, 1000, (-(-BITS // VOTED), 256, VOTED)))
    return 256 * votes - votes.sum(1, keepdims=True)


def fingerprints(sets: list[np.ndarray], votes: np.ndarray) -> np.ndarray:
    """[set, bit]: SimHash bits of each set of shingle hashes, set where its votes are above zero."""
    out = np.zeros((len(sets), len(votes) * VOTED), bool)
    flat = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * 256, list(map(len, sets)))
    for k, vote in enumerate(votes):
        if k % 8 == 0:
            x = flat + np.uint64(k // 8 * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            octets = (x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8)
        seen = np.bincount(base + octets[:, k % 8], minlength=len(sets) * 256).reshape(-1, 256)
        out[:, k * VOTED : (k + 1) * VOTED] = seen.astype(np.float64) @ vote > 0
    return out[:, :BITS]


def parts(bits: np.ndarray) -> np.ndarray:
    """[fingerprint, part]: the parts as integers; neighbouring bits go to different parts."""
    return (bits.reshape(len(bits), PART_BITS, PARTS) << np.arange(PART_BITS, dtype=np.int32)[:, None]).sum(1, dtype=np.int32)


def as_words(bits: np.ndarray) -> np.ndarray:
    """[fingerprint, word]: the bits in words of 64, the last one filled up with zeros."""
    return np.packbits(np.pad(bits, ((0, 0), (0, 64 * ALL_WORDS - BITS))), axis=1).view(np.uint64)


def _lists(rows: np.ndarray, kind: pa.DataType, full: np.ndarray) -> pa.Array:
    """A list of each row, empty where not full (rows holds the full ones)."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * rows.shape[1])]), pa.int32()), pa.array(rows.ravel(), kind))


def sketched(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The kept columns with ``fp`` (which equal sets share), the fingerprint's first word ``sim``, its other words and its parts; no shuffle.

    An empty set has no parts.
    """
    names = [c.split(" ")[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = voters()
        for b in slices(batches, "text", 1 << 20):
            for i in range(0, b.num_rows, 512):
                own = b.slice(i, 512)
                sets = [np.unique(shingle_hashes(t, WORDS)) for t in own.column("text").to_pylist()]
                full = np.fromiter(map(len, sets), np.int64, len(sets)) > 0
                bits = fingerprints([s for s in sets if len(s)], votes) if full.any() else np.zeros((0, BITS), bool)
                words = as_words(bits).view(np.int64)
                sim = np.zeros(len(sets), np.int64)
                sim[full] = words[:, 0]
                fp = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
                arrays = [pa.array(fp), pa.array(sim), _lists(words[:, 1:], pa.int64(), full), _lists(parts(bits), pa.int32(), full)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), *arrays], [*names, "fp", "sim", "more", "parts"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{keep}, fp string, sim long, more array<long>, parts array<int>")


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, ``fp`` and the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = [np.unique(shingle_hashes(t, WORDS)) for t in b.column("text").to_pylist()]
            fp = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "fp", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp string, grams array<long>")


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Positions (root, other) that connect what links connect among the fingerprints (rows of words)."""
    words = list(fps.T)
    kind = np.uint8 if len(words) < 4 else np.uint16
    rest, links = np.arange(len(fps)), []
    if len(fps) <= SMALL:
        near = sum(np.bitwise_count(w[:, None] ^ w).astype(kind, copy=False) for w in words) <= radius
        rest = rest[near.sum(1) > 1]
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        frontier = [root]
        while frontier and len(rest):
            p = frontier.pop()
            close = sum(np.bitwise_count(w[rest] ^ w[p]).astype(kind, copy=False) for w in words) <= radius
            if close.any():
                hit = rest[close].tolist()
                links += [(root, h) for h in hit]
                frontier += hit
                rest = rest[~close]
    return links


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the smallest node of each component to its others, in place of the links."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            other = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[label[other]], nodes[other]
        label = new


def merged(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Stars in place of all links (u, v) of the batches; besides those still to be merged, memory holds one link of each node."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    n, room = 0, LINKS_HELD
    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        n += b.num_rows
        if n >= room:
            held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
            room = max(LINKS_HELD, 2 * n)
    return stars(*map(np.concatenate, zip(*held, strict=True)))


def connected(links: DataFrame) -> DataFrame:
    """``components`` of links that many tasks found, each with a root of its own for the same nodes.

    All links of a node as the larger end meet in a task first, which sends stars in their place: about a link for each node
    goes on, not one for each node and bucket. Up to FEW_LINKS of these are then connected in one task, more by ``components``.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = merged(batches)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = merged(batches)
        roots = np.unique(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, roots])), pa.array(np.concatenate([u, roots]))], ["node", "root"])

    ordered = links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = cut(ordered.repartition("v").mapInArrow(reduced, "u long, v long"))
    if at_most(edges, FEW_LINKS):
        return cut(edges.coalesce(1).mapInArrow(rooted, "node long, root long"))
    return components(edges)


def near_fingerprints(classes: DataFrame, radius: int, compared: int = WORDS_COMPARED) -> DataFrame:
    """(u, v) over rep: pairs that share a bucket and are within the radius, or such as connect the same.

    classes has rep, sim, more and parts; so many words are compared. A task sends the stars of what its links connect.
    """
    keys = F.flatten(F.transform("parts", lambda p: covering_keys(p.cast("long"), COVERED)))
    columns = ["bucket", "sim", *(f"w{k}" for k in range(1, compared)), "rep"]
    rows = classes.filter(F.size("parts") > 0).select("sim", *(F.col("more")[k - 1].alias(f"w{k}") for k in range(1, compared)), "rep", F.posexplode(keys).alias("table", "key"))
    rows = rows.withColumn("bucket", F.shiftleft(F.col("table").cast("long"), PART_BITS).bitwiseOR(F.col("key"))).select(*columns)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "rep")

    def answer(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        bucket, *fps, ids = (np.concatenate(x) for x in zip(*pieces, strict=True))
        fps = np.stack(fps, axis=1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        return [ids[a:z][np.array(found)] for a, z in zip(starts, [*starts[1:], len(bucket)], strict=True) if z - a > 1 and (found := spanning_links(fps[a:z], radius))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the last bucket so far, as it may go on in the next batch
        found: list[np.ndarray] = []
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if not len(rows[0]):
                continue
            if held and held[0][0][0] != rows[0][0]:
                found += answer(held)
                held = []
            same = rows[0] == rows[0][-1]
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                found += answer([*held, [x[:end] for x in rows]])
                held = []
            held.append([x[end:] for x in rows])
            if len(found) > 1 and sum(map(len, found)) >= LINKS_HELD:
                yield sent(found)
                found = []
        if held:
            found += answer(held)
        if found:
            yield sent(found)

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        links = np.concatenate(found)
        u, v = stars(links[:, 0], links[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def set_links(sets: list[np.ndarray], asks: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Positions that connect what similar pairs connect, of the pairs of two groups that hold one that asks."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    group, found = group.copy(), []
    marked = np.zeros(len(vocabulary), bool)
    for k in np.flatnonzero(asks):
        other = group != group[k]
        if other.any():
            own = codes[starts[k] : starts[k] + sizes[k]]
            marked[own] = True
            common = np.add.reduceat(marked[codes], starts, dtype=np.int64)
            marked[own] = False
            # common / (a + b - common) >= 4 / 5 in integers
            for h in np.flatnonzero(other & (9 * common >= 4 * (sizes + sizes[k]))).tolist():
                found.append((int(k), h))
                group[group == group[h]] = group[k]
    return found


def links_within(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v): links within the groups of rows (rep, own, asks, grams) by the keys; ``own`` is the component so far."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def answer(own: list[tuple]) -> list[tuple[int, int]]:
        if len(own) < 2:
            return []
        _, group = np.unique([r[1] for r in own], return_inverse=True)
        return [(own[a][0], own[b][0]) for a, b in set_links([r[3] for r in own], np.array([r[2] for r in own]), group)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for b in batches:
            found = []
            columns = [b.column(c).to_pylist() for c in (*keys, "rep", "own", "asks")]
            grams = b.column("grams")
            for k, (*key, rep, root, asks) in enumerate(zip(*columns, strict=True)):
                if key != last:
                    found += answer(own)
                    last, own = key, []
                own.append((rep, root, asks, grams[k].values.to_numpy()))
            yield pairs(found)
        yield pairs(answer(own))

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if at_most(df, BROADCAST_ROWS) else df


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) over the ids of distinct sets: classes has fp, rep, sim, more and parts, docs has doc_id and text, rep among the ids.

    Sets are made again for the documents with near fingerprints only, so those of all others are never stored.
    """
    node, key = F.col("node").alias("rep"), F.col("root").alias("key")
    near = connected(near_fingerprints(classes, RADIUS)).select(node, key)
    crowded = cut(near.groupBy("key").count().filter(F.col("count") > CHUNK).select("key"))
    if not crowded.isEmpty():
        crowd = few(crowded)
        inside = cut(near.join(crowd, "key").select("rep"))
        closer = connected(near_fingerprints(cut(classes.join(few(inside), "rep", "left_semi")), WHOLE_RADIUS, ALL_WORDS)).select(node, key)
        near = near.join(crowd, "key", "left_anti").select("rep", "key").unionByName(closer)
    rows = cut(classes.select("fp", "rep", F.xxhash64("fp").alias("h")).join(few(cut(near)), "rep"))
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("lead")))
    members = cut(rows.join(few(groups), "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    wanted = members.select("fp", F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(few(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    grams = cut(shingled(texts).join(few(wanted), ["fp", "doc_id"], "left_semi").dropDuplicates(["fp"]).select("fp", "grams"))
    chunk = F.pmod("h", F.col("chunks")).cast("int")
    spread = F.when(F.col("h") == F.col("lead"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    first = members.select("key", "fp", "rep", F.col("h").alias("own"), F.lit(True).alias("asks"), F.explode(spread).alias("chunk"))
    found = cut(links_within(first.join(grams, "fp"), ["key", "chunk"]))
    large = members.filter(F.col("n") > CHUNK)
    if large.isEmpty():
        return found
    rooted = large.join(connected(found).select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("own", F.coalesce("root", "rep")).drop("root")
    main = rooted.filter("h = lead").select("key", F.col("own").alias("main"))
    rooted = cut(rooted.join(few(cut(main)), ["key"]))
    others = rooted.filter("own <> main")
    left = cut(others.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks")))
    if left.isEmpty():
        return found
    rooted = rooted.join(few(left), ["key"])
    block = F.pmod(F.xxhash64(F.lit(2), "fp"), F.col("blocks")).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = rooted.filter("own <> main").select("key", "fp", "rep", "own", F.lit(True).alias("asks"), block.alias("block"), each("chunks").alias("chunk"))
    asked = rooted.select("key", "fp", "rep", "own", F.lit(False).alias("asks"), chunk.alias("chunk"), each("blocks").alias("block"))
    rest = links_within(asking.unionByName(asked).join(grams, "fp"), ["key", "chunk", "block"])
    return found.unionByName(rest)


def near_duplicates(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The kept columns (doc_id among them) with ``fp`` and ``component_id``, the smallest doc_id reachable over links.

    Null and blank texts have the empty set in common. A row without doc_id takes its component from the
    documents of its set (null if all lack ids) and links nothing itself. Rows that share an id count as
    one document. Ties, repeated rows and clashing extra columns don't matter; an empty table gives no rows.
    """
    names = [c.split(" ")[0] for c in keep.split(", ")]
    d = cut(sketched(docs, keep))
    classes = cut(d.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ("sim", "more", "parts"))))
    found = connected(links(classes, docs)).select(F.col("node").alias("rep"), "root")
    shared = classes.select("fp", "rep").join(found, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return d.select(*names, "fp").join(shared, "fp", "left")
