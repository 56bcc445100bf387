"""Vector retrieval by exact cosine, fusion with keyword hits (``operators/keywords``), grouping.

Query sets are stated and small (their number is checked before anything of them is broadcast); the
corpus side is only ever scanned, combined per task and shuffled by (query, document).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

WORD = "[a-zà-ÿß]+"
K1, B = 1.2, 0.75
#: Candidates per branch, those that are ranked again, matches shown per group; weights of the branches.
CANDIDATES, RERANKED, SHOWN = 100, 40, 5
KEYWORD_WEIGHT, VECTOR_WEIGHT = 0.4, 0.6
#: Query terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def tokens(text: Column) -> Column:
    """Words in lower case. The analyzer is a parameter of what calls this: any array of strings does."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if it has so many rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top(df: DataFrame, group: str, score: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """The best n of each group with their ranks; the group limit prunes within each task first."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def mean_vector(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Mean vector of each key, by position, combined before the shuffle."""
    d = df.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return d.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(name))


def nearest(vectors: DataFrame, queries: DataFrame, query_id: str, query_vector: str, row_id: str, vector: str, n: int, most: int = 1000) -> DataFrame:
    """(query, row, score, rank) by exact cosine of a stated query set against all rows.

    The queries go to the tasks in blocks of ``most`` at most, with a scan for each block; each Arrow batch
    of rows meets a block in one matrix product in double precision, and a task passes on what can still
    be among the best n of its batches.
    A zero vector scores 0; a null vector, or one of another length, isn't ranked.
    """
    asked = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    schema = StructType([queries.schema[query_id], vectors.schema[row_id], StructField("score", DoubleType())])
    head = asked.limit(most + 1).collect()
    if not head:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    width = len(head[0][1])
    rest = iter(head if len(head) <= most else asked.toLocalIterator())
    scored = None
    while block := list(islice(rest, most)):
        found = _scores(vectors.select(row_id, vector), block, width, schema, n)
        scored = found if scored is None else scored.unionAll(found)
    return top(scored.withColumn("score", F.round("score", 6)), query_id, "score", row_id, n)


def _scores(vectors: DataFrame, asked: list, width: int, schema: StructType, n: int) -> DataFrame:
    """(query, row, score) of what can be among the best n of a block of queries."""
    if any(len(r[1]) != width for r in asked):
        raise ValueError("query vectors differ in length")
    names = pa.array([r[0] for r in asked], to_arrow_type(schema[0].dataType))
    q = np.array([[np.nan if x is None else x for x in r[1]] for r in asked], dtype=np.float64)
    q_norm = np.sqrt(np.einsum("ij,ij->i", q, q))

    def meet(batches):
        floor = np.full(len(q), -np.inf)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            fit = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
            ids, column = ids.filter(fit), column.filter(fit)
            if not len(ids):
                continue
            rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
            norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None] * q_norm
            scores = np.divide(rows @ q.T, norm, out=np.zeros_like(norm), where=norm != 0)
            if len(scores) >= n:
                floor = np.fmax(floor, np.partition(scores, len(scores) - n, axis=0)[len(scores) - n])
            # half a unit of the sixth digit on both sides: what rounds to the same score may win by its id
            i, j = np.nonzero(~(scores < floor - 1e-6))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), ids.take(pa.array(i)), pa.array(scores[i, j])], names=schema.names)

    return vectors.mapInArrow(meet, schema)


def nearest_of_groups(vectors: DataFrame, queries: DataFrame, query_id: str, query_vector: str, row_id: str, vector: str, group: str, most: int = 1000) -> DataFrame:
    """(query, group, row, score): the row of largest cosine of every group but the query's own (column ``group`` of both sides).

    Queries travel in blocks as in ``nearest``; a batch passes on the best rows of each of its groups only.
    Rows and queries without a vector or a group take no part.
    """
    asked = queries.select(query_id, query_vector, group).dropna(subset=[query_vector, group])
    schema = StructType([queries.schema[query_id], vectors.schema[group], vectors.schema[row_id], StructField("score", DoubleType())])
    rows = vectors.select(row_id, vector, group).dropna(subset=[vector, group])
    found, rest = None, iter(asked.toLocalIterator())
    while block := list(islice(rest, most)):
        part = _group_scores(rows, block, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    best = F.min_by(F.struct(row_id, "score"), F.struct((-F.col("score")).alias("s"), row_id)).alias("_b")
    return found.withColumn("score", F.round("score", 6)).groupBy(query_id, group).agg(best).select(query_id, group, f"_b.{row_id}", "_b.score")


def _group_scores(rows: DataFrame, asked: list, schema: StructType) -> DataFrame:
    """(query, group, row, score) of what can be the best of a group that isn't the query's."""
    width = len(asked[0][1])
    if any(len(r[1]) != width for r in asked):
        raise ValueError("query vectors differ in length")
    names, own = pa.array([r[0] for r in asked], to_arrow_type(schema[0].dataType)), np.array([r[2] for r in asked], dtype=object)
    q = np.array([r[1] for r in asked], dtype=np.float64)
    q_norm = np.sqrt(np.einsum("ij,ij->i", q, q))

    def meet(batches):
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), width))
            if not batch.num_rows:
                continue
            ids, column, labels = batch.columns
            x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, width)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * q_norm
            scores = np.divide(x @ q.T, norm, out=np.zeros_like(norm), where=norm != 0)
            kinds, at = np.unique(np.array(labels.to_pylist(), dtype=object), return_inverse=True)
            best = np.full((len(kinds), len(q)), -np.inf)
            np.maximum.at(best, at, scores)
            best[kinds[:, None] == own[None, :]] = np.inf
            # as in _scores: what rounds to the same score may win by its id
            i, j = np.nonzero(scores >= best[at] - 1e-6)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), labels.take(pa.array(i)), ids.take(pa.array(i)), pa.array(scores[i, j])], names=schema.names)

    return rows.mapInArrow(meet, schema)


def classified(rows: DataFrame, centres: DataFrame, vector: str, label: str, centre: str, most: int = 1000) -> DataFrame:
    """The rows with ``nearest_label`` and ``score``: the centre of largest cosine, ties to the smaller label.

    Centres travel in blocks; each block goes over the rows with the best found before it beside them, so
    nothing is shuffled. A zero vector scores 0 everywhere; a null one, one of another length or one that isn't
    a number somewhere has no label.
    """
    kind = centres.schema[label].dataType
    d = rows.withColumns({"nearest_label": F.lit(None).cast(kind), "score": F.lit(None).cast("double")})
    rest = iter(centres.select(label, centre).dropna().orderBy(label).toLocalIterator())
    while block := list(islice(rest, most)):
        d = d.mapInArrow(_against(block, rows.columns.index(vector), to_arrow_type(kind)), d.schema)
    return d


def _against(block: list, at: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    labels = pa.array([r[0] for r in block], kind)
    q = np.array([r[1] for r in block], dtype=np.float64)
    q_norm = np.sqrt(np.einsum("ij,ij->i", q, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, had = batch.column(at), batch.column(batch.num_columns - 1)
            fit = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), q.shape[1]), False).to_numpy(zero_copy_only=False))
            x = np.asarray(column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, q.shape[1])
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * q_norm
            scores = np.round(np.divide(x @ q.T, norm, out=np.zeros_like(norm), where=norm != 0), 6)
            # labels ascend, within a block and from one to the next, so the first of equal scores has the smallest
            first = scores.argmax(axis=1)
            best, now = np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, dtype=np.int64)
            best[fit], now[fit] = scores[np.arange(len(fit)), first], first
            old = np.asarray(had.to_numpy(zero_copy_only=False), dtype=np.float64)
            better = np.isfinite(best) & (np.isnan(old) | (best > old))
            label = pc.if_else(pa.array(better), labels.take(pa.array(now)), batch.column(batch.num_columns - 2).cast(kind))
            score = pc.if_else(pa.array(better), pa.array(best), had)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], label, score], names=batch.schema.names)

    return run


def fuse(keyword: DataFrame, vector: DataFrame, query_id: str, row_id: str) -> DataFrame:
    """Min-max normalised scores of both branches, weighted; a row missing from a branch has 0 there."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(query_id)
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select(query_id, row_id, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(keyword, "k").join(scaled(vector, "v"), [query_id, row_id], "full_outer")
    score = F.coalesce("k", F.lit(0.0)) * KEYWORD_WEIGHT + F.coalesce("v", F.lit(0.0)) * VECTOR_WEIGHT
    return both.select(query_id, row_id, F.round(score, 6).alias("score"))


def grouped(ranked: DataFrame, query_id: str, group: str, row_id: str) -> DataFrame:
    """Hits collapsed to groups: each group stands where its best member does and shows a few of its members."""
    best = ranked.groupBy(query_id, group).agg(F.max("score").alias("best"), F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(row_id).alias("r")))).alias("_m"))
    w = Window.partitionBy(query_id).orderBy(F.desc("best"), group)
    return best.select(query_id, group, "best", "members", F.transform(F.slice("_m", 1, SHOWN), lambda x: x["r"]).alias("shown")).withColumn("place", F.row_number().over(w))


def least_matches(n: Column) -> Column:
    """How many of n query terms must match: all of two, else three quarters, rounded down."""
    return F.when(n <= 2, n).otherwise(F.floor(n * 0.75)).cast("int")


def highlight(text: Column, words: list[str], mark: str = "mark") -> Column:
    """Whole words marked, case aside."""
    return F.regexp_replace(text, f"(?i)\\b({'|'.join(words)})\\b", f"<{mark}>$1</{mark}>")
