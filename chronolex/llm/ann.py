"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of hash bits (signs of random projections of the centred
unit vector) and keeps the vectors in the order of these strings, cut into parts by their leading
bits; a part is a sorted array. A search has two phases:

1. Strings only. In every tree a query goes down to its longest matching prefix in the sorted array
   and then comes up, all trees at once, one bit at a time, until the prefixes hold enough vectors.
   How many the trees hold below a prefix is counted in the query's own part; above the part, which is
   a prefix itself, the sample's counts stand for the rest. Equal strings are counted before they move.
2. Vectors. All those below the final prefix are compared exactly, in the parts that hold them; there
   is no cap on their number. A part that holds far more than PART_ROWS (a dense cluster shares its
   strings) is dealt out by hash, and the queries come to each of its pieces.

How many are enough is measured, not given: on a bounded sample the forest must find the target share
of true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import at_most, cut

#: Each tree holds a copy of the vectors in phase 2, so their number is what the shuffle pays for.
TREES, LABEL_BITS, SEED = 4, 48, 11
#: Sample rows (those whose hash is lowest), and how many of them are queries when the depth is set.
SAMPLE_ROWS, SAMPLE_QUERIES = 12_000, 400
TARGET_RECALL = 0.95
#: Vectors in a part of a tree, about: 5 MB of 64 floats. Those of twice as many are dealt out.
PART_ROWS = 20_000
#: Such parts that are sent to all tasks; more are joined.
LARGE_PARTS = 100_000
FOUND = ["h1", "h2", "i1", "i2", "first", "score"]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, h1, h2, dim): rows that have an id and a finite, non-zero vector. Equal vectors have equal hashes."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    v = v.filter(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0).cast(vectors.schema["embedding"].dataType))  # no negative zeros
    return v.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), F.size("embedding").alias("dim"))


def classes(v: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids; the group limit prunes copies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = v.withColumn("r", rank).filter(F.col("r") <= keep)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Forest:
    """Projections, depth rule and part depth for the vectors of one dimension, from a sample."""

    def __init__(self, sample: np.ndarray, rows: int, near: int):
        rng = np.random.default_rng(SEED)
        x = _unit(sample)
        self.rows = rows
        self.mean = x.mean(0)
        self.planes = rng.normal(size=(x.shape[1], TREES * LABEL_BITS))
        labels = self.labels(sample)
        self.sorted = np.sort(labels, axis=0)
        self.need = self._calibrate(x, labels, near)
        #: Leading bits that name a part.
        self.part_bits = min(LABEL_BITS, max(0, int(np.ceil(np.log2(rows / PART_ROWS)))))

    @classmethod
    def again(cls, state: dict) -> Forest:
        """The forest whose ``vars`` these are."""
        f = cls.__new__(cls)
        f.__dict__.update(state)
        return f

    def labels(self, vectors: np.ndarray) -> np.ndarray:
        """A LABEL_BITS-bit integer per vector and tree; its leading bits are the prefixes."""
        bits = ((_unit(vectors) - self.mean) @ self.planes > 0).reshape(len(vectors), TREES, LABEL_BITS)
        return bits @ (1 << np.arange(LABEL_BITS - 1, -1, -1, dtype=np.int64))

    def part(self, labels: np.ndarray) -> np.ndarray:
        return labels >> (LABEL_BITS - self.part_bits)

    def sampled(self, labels: np.ndarray, tree: int) -> np.ndarray:
        """[query, depth]: sample vectors below the query's prefix of that depth in a tree."""
        return _below(self.sorted[:, tree], np.arange(len(self.sorted) + 1), labels)

    def held(self, tree: int, strings: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """[query, depth]: vectors below the queries' prefixes; strings (sorted) and counts are those of the queries' part."""
        inside = _below(strings, np.concatenate([[0], np.cumsum(counts)]), labels).astype(np.float64)
        sample = self.sampled(labels, tree)
        around = sample[:, : self.part_bits] - sample[:, self.part_bits : self.part_bits + 1]
        inside[:, : self.part_bits] += around * (self.rows / len(self.sorted))
        return inside

    def _calibrate(self, x: np.ndarray, labels: np.ndarray, near: int) -> float:
        """Vectors below the prefixes, as a share of all, with which TARGET_RECALL of the sample's true neighbours are found."""
        q = np.arange(min(SAMPLE_QUERIES, len(x)))
        near = min(near, len(x) - 1)
        if near < 1:
            return TREES * 1.0
        cos = x[q] @ x.T
        cos[q, q] = -np.inf
        true = np.argpartition(-cos, near - 1, axis=1)[:, :near]
        common = np.zeros((len(q), near), np.int64)  # the longest prefix shared in any tree
        for t in range(TREES):
            differ = labels[q, t][:, None] ^ labels[true, t]
            common = np.maximum(common, LABEL_BITS - np.frexp(differ.astype(np.float64))[1])
        held = sum(self.sampled(labels[q, t], t) for t in range(TREES))
        for need in np.unique(np.geomspace(near * TREES, TREES * len(x), 200).astype(np.int64)):
            depth = np.where(held >= need, np.arange(held.shape[1]), 0).max(1)
            if (common >= depth[:, None]).mean() >= TARGET_RECALL:
                return need / len(x)
        return TREES * 1.0


def _below(strings: np.ndarray, sums: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """[query, depth]: what the sorted strings hold below the queries' prefixes of each depth; sums are running counts."""
    out = np.zeros((len(labels), LABEL_BITS + 1), np.int64)
    for d in range(LABEL_BITS + 1):
        rest = (1 << LABEL_BITS - d) - 1
        out[:, d] = sums[np.searchsorted(strings, labels | rest, "right")] - sums[np.searchsorted(strings, labels & ~rest)]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(q: pd.DataFrame, items: pd.DataFrame, near: int) -> pd.DataFrame:
    """For each query its best items of this part of a tree, by exact cosine, ties to the smaller first id."""
    order = np.argsort(items["label"].to_numpy(), kind="stable")
    labels = items["label"].to_numpy()[order]
    x = np.stack(items["embedding"].to_numpy()[order]).astype(np.float64)
    x_norm = np.sqrt((x * x).sum(1))
    first = items["first"].to_numpy()[order]
    out = []
    start = np.searchsorted(labels, q["low"].to_numpy())
    end = np.searchsorted(labels, q["high"].to_numpy(), "right")
    for k, (a, b) in enumerate(zip(start, end, strict=True)):
        if a < b:
            v = np.asarray(q["embedding"].iat[k], np.float64)
            norm = np.sqrt(v @ v)
            at = a + _leading((x[a:b] @ v) / (x_norm[a:b] * norm), near)
            # Again row by row, so that a score doesn't depend on the part that it is found in.
            cos = (x[at] * v).sum(1) / (x_norm[at] * norm)
            best = np.lexsort((first[at], -cos))[:near]
            out.append((np.full(len(best), k), order[at[best]], cos[best]))
    if not out:
        return pd.DataFrame([], columns=FOUND)
    who, at, cos = (np.concatenate(c) for c in zip(*out, strict=True))
    own, found = q.iloc[who], items.iloc[at]
    return pd.DataFrame(dict(zip(FOUND, (own["h1"].to_numpy(), own["h2"].to_numpy(), *(found[c].to_numpy() for c in ("h1", "h2", "first")), cos), strict=True)))


def _leading(cos: np.ndarray, near: int) -> np.ndarray:
    """Where the ``near`` largest are, with all that tie with the last but for rounding."""
    if len(cos) <= near:
        return np.arange(len(cos))
    return np.flatnonzero(cos >= np.partition(cos, len(cos) - near)[len(cos) - near] - 1e-12)


def search(vectors: DataFrame, is_query, near: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest of all other rows for every row that ``is_query`` selects.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id; only vectors of equal dimension are compared. Copies of a vector are searched once,
    by their smallest ids, which is all that ties to the smaller id can ask for. Repeated ids are rows
    of their own. Extra columns are ignored; an empty table gives no rows.
    """
    keep = near + 1
    v = usable(vectors)
    index = cut(classes(v, keep))
    sizes = index.groupBy("dim").count().collect()
    forests = {}
    for r in sizes:
        share = min(1.0, 1.3 * SAMPLE_ROWS / r["count"])
        rows = index.filter((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 40)) < int(share * (1 << 40)))).select("h1", "embedding").limit(2 * SAMPLE_ROWS).collect()
        sample = np.array([x["embedding"] for x in sorted(rows, key=lambda x: x["h1"])[:SAMPLE_ROWS]], np.float64)
        if len(sample):
            forests[r["dim"]] = Forest(sample, r["count"], near)
    # Numbers and arrays only: a broadcast names the classes it holds, which workers may not be able to import.
    sent = vectors.sparkSession.sparkContext.broadcast({d: vars(f) for d, f in forests.items()})

    def by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Forest, pa.RecordBatch]]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                if d in sent.value:
                    yield d, Forest.again(sent.value[d]), b.filter(pa.array(dims == d))

    def bins(dim: int, tree: int, part: np.ndarray) -> np.ndarray:
        """One number for dimension, tree and part; a part has at most 40 bits."""
        return (np.int64(dim * TREES + tree) << 40) + part

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per tree of every vector: its part and its string, with the vector's key."""
        for d, f, b in by_dim(batches):
            labels = f.labels(_matrix(b.column("embedding")))
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(bins(d, t, f.part(labels[:, t]))), pa.array(labels[:, t]), b.column("h1"), b.column("h2")], ["bin", "label", "h1", "h2"])

    def descend(key: tuple, q: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        """What a tree holds below each prefix of the queries, and how much is enough."""
        dim, tree = divmod(int(key[0]) >> 40, TREES)
        f = Forest.again(sent.value[dim])
        items = items.sort_values("label")
        held = f.held(tree, items["label"].to_numpy(np.int64), items["n"].to_numpy(np.int64), q["label"].to_numpy(np.int64))
        return pd.DataFrame({"h1": q["h1"], "h2": q["h2"], "held": list(held), "enough": f.need * f.rows})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per tree of every vector, with the vector."""
        for d, f, b in by_dim(batches):
            labels = f.labels(_matrix(b.column("embedding")))
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(bins(d, t, f.part(labels[:, t]))), pa.array(labels[:, t]), *(b.column(c) for c in ("h1", "h2", "first", "embedding"))], ["bin", "label", "h1", "h2", "first", "embedding"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per tree and part that a query's final prefix reaches."""
        for d, f, b in by_dim(batches):
            labels = f.labels(_matrix(b.column("embedding")))
            rest = (np.int64(1) << (LABEL_BITS - b.column("depth").to_numpy().astype(np.int64))) - 1
            for t in range(TREES):
                low, high = labels[:, t] & ~rest, labels[:, t] | rest
                a, z = f.part(low), f.part(high)
                who = np.repeat(np.arange(len(a)), z - a + 1)
                part = a[who] + np.arange(len(who)) - np.repeat(np.cumsum(z - a + 1) - (z - a + 1), z - a + 1)
                own = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(bins(d, t, part)), pa.array(low[who]), pa.array(high[who]), *(own.column(c) for c in ("h1", "h2", "embedding"))], ["bin", "low", "high", "h1", "h2", "embedding"])

    kind = dict(index.dtypes)["embedding"]
    asked = v.filter(is_query).dropDuplicates(["h1", "h2"])
    counted = cut(index.mapInArrow(strings, "bin long, label long, h1 long, h2 long").groupBy("bin", "label").agg(F.count("*").alias("n")))
    below = asked.mapInArrow(strings, "bin long, label long, h1 long, h2 long").groupBy("bin").cogroup(counted.groupBy("bin"))
    trees = below.applyInPandas(lambda key, q, i: descend(key, q, i) if len(q) else pd.DataFrame([], columns=["h1", "h2", "held", "enough"]), "h1 long, h2 long, held array<double>, enough double")
    together = trees.groupBy("h1", "h2").agg(F.collect_list("held").alias("held"), F.first("enough").alias("enough"))
    levels = F.sequence(F.lit(0), F.lit(LABEL_BITS))
    total = lambda d: F.aggregate("held", F.lit(0.0), lambda a, x: a + x[d])
    depths = together.select("h1", "h2", F.array_max(F.transform(levels, lambda d: F.when(total(d) >= F.col("enough"), d).otherwise(0))).alias("depth"))

    large = cut(counted.groupBy("bin").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * PART_ROWS).select("bin", F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int").alias("pieces")))
    large = F.broadcast(large) if at_most(large, LARGE_PARTS) else large
    items = index.withColumn("first", F.col("ids")[0]).mapInArrow(place, f"bin long, label long, h1 long, h2 long, first long, embedding {kind}")
    items = items.join(large, "bin", "left").withColumn("piece", F.coalesce(F.pmod("h1", "pieces").cast("int"), F.lit(0))).drop("pieces")
    asks = asked.join(depths, ["h1", "h2"]).mapInArrow(ask, f"bin long, low long, high long, h1 long, h2 long, embedding {kind}")
    asks = asks.join(large, "bin", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")

    def meet(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        return _best(q, i, keep) if len(q) and len(i) else pd.DataFrame([], columns=FOUND)

    found = asks.groupBy("bin", "piece").cogroup(items.groupBy("bin", "piece")).applyInPandas(meet, "h1 long, h2 long, i1 long, i2 long, first long, score double")
    once = found.groupBy("h1", "h2", "i1", "i2").agg(F.first("first").alias("first"), F.max("score").alias("score"))
    near_first = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "first")
    few = once.withColumn("r", F.row_number().over(near_first)).filter(F.col("r") <= keep).drop("r", "first")
    each = few.join(index.select(F.col("h1").alias("i1"), F.col("h2").alias("i2"), "ids"), ["i1", "i2"]).select("h1", "h2", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    queries = v.filter(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"])
    # A query's own row goes (its id once); the places after it move up.
    at = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id"))
    others = F.slice(F.filter("best", lambda x, k: k + 1 != at), 1, near)
    rows = queries.select("query_id", F.posexplode(others).alias("p", "x"))
    return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    """Rows of the query: the five nearest of every row whose vec_id is divisible by 50.

    Null, zero and non-finite vectors and rows without an id take no part; ties go to the smaller id, copies
    and repeated ids are rows of their own, extra columns are ignored, and an empty table gives no rows.
    """
    return search(vectors, F.col("vec_id") % 50 == 0)
