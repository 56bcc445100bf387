"""Nearest vectors by clusters whose radius bounds what they can hold: exact answers, clusters that can't matter left out.

Centres come from a bounded sample by spherical k-means; every row goes to its nearest centre, and a cluster's radius is the largest angle
between its centre and a row. For a question at angle a from a centre of radius r no row of the cluster is nearer than max(0, a - r).
The questions' nearest clusters are searched first; what their n-th best row scores leaves out the clusters whose bound is below
it. A filter on the rows goes into the clusters before they are searched, so that it can't empty a list of hits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from chronolex.operators.retrieval import top

# Tasks get these functions with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that centres are learnt from, those whose hash is lowest; rounds of k-means; how far bounds may be off by rounding.
SAMPLE, ROUNDS, SLACK = 20_000, 8, 1e-5
#: Rows for each cluster aimed at, and clusters at most; a cluster of more than PIECE rows is searched in pieces.
ROWS, CLUSTERS, PIECE = 2_000, 2_000, 20_000
#: Cells of a matrix of scores at once.
CELLS = 4_000_000


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite numbers, not all of them zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.filter(F.col(vector).isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(rows: DataFrame, vector: str, clusters: int) -> np.ndarray:
    """[centre, dimension]: spherical k-means on the sample, CLUSTERS at most; vectors of one length are wanted."""
    clusters = min(clusters, CLUSTERS)
    got = usable(rows, vector).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(vector), vector).limit(SAMPLE).toArrow()
    x = _unit(np.array(got.column("v").to_pylist(), np.float64)) if got.num_rows else np.zeros((0, 1))
    centres = x[:: max(len(x) // max(clusters, 1), 1)][:clusters]
    for _ in range(ROUNDS if len(centres) else 0):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def assigned(rows: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """The usable rows with their ``cluster`` and their ``angle`` to its centre: the inverted lists, to be written by cluster."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    out = StructType([*rows.schema.fields, *StructType.fromDDL("cluster int, angle double").fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            if b.num_rows:
                cos = _unit(np.array(b.column(vector).to_pylist(), np.float64)) @ c.T
                own = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(angle)], schema=schema)

    return usable(rows, vector).mapInArrow(run, out)


class Search:
    """One search over assigned rows: ``hits`` and ``report`` share the bounds."""

    def __init__(self, lists: DataFrame, centres: np.ndarray, queries: DataFrame, query_id: str, asked: str, row_id: str, vector: str, n: int, allowed: Column | None = None):
        """``allowed`` filters the rows. Questions without a usable vector have no hits."""
        self.lists = lists if allowed is None else lists.filter(allowed)
        self.query_id, self.row_id, self.vector, self.n = query_id, row_id, vector, n
        self.queries = usable(queries, asked).select(F.col(query_id).alias("q"), F.col(asked).cast("array<double>").alias("v"))
        self.radius = self.lists.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("rows")).persist()
        self.bounds = self._bounds(centres).persist()
        first = self.bounds.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "cluster"))).filter("k = 1")
        tried = self._scored(first.select("q", "cluster"))
        enough = tried.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("held")).filter(F.col("held") >= n)
        floor = F.coalesce("least", F.lit(-2.0)) - SLACK
        self.chosen = self.bounds.join(enough, "q", "left").filter(F.col("bound") >= floor).select("q", "cluster").persist()

    def _bounds(self, centres: np.ndarray) -> DataFrame:
        """(q, cluster, bound): a row per question and cluster, which is the price of the bound; clusters are few."""
        sent = self.queries.sparkSession.sparkContext.broadcast(centres)
        out = StructType([self.queries.schema["q"], *StructType.fromDDL("cluster int, to_centre double").fields])
        schema = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for b in batches:
                if b.num_rows and len(c):
                    angle = np.arccos(np.clip(_unit(np.array(b.column("v").to_pylist(), np.float64)) @ c.T, -1, 1))
                    who = np.repeat(np.arange(b.num_rows), len(c))
                    yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(who)), pa.array(np.tile(np.arange(len(c), dtype=np.int32), b.num_rows)), pa.array(angle.ravel())], schema=schema)

        d = self.queries.mapInArrow(run, out).join(self.radius, "cluster")
        return d.select("q", "cluster", F.cos(F.greatest(F.col("to_centre") - F.col("radius"), F.lit(0.0))).alias("bound"))

    def _scored(self, wanted: DataFrame) -> DataFrame:
        """(q, row, score): the n best rows of each question in each piece of its wanted clusters."""
        n, vector, cells = self.n, self.vector, CELLS
        pieces = F.broadcast(self.radius.select("cluster", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces")))  # CLUSTERS rows at most
        asks = wanted.join(self.queries, "q").join(pieces, "cluster")
        asks = asks.select("q", "v", F.col("cluster").alias("of"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("of_piece"))
        rows = self.lists.select("cluster", F.col(self.row_id).alias("row"), F.col(vector).alias("x")).join(wanted.select("cluster").distinct(), "cluster", "left_semi")
        rows = rows.join(pieces, "cluster").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).drop("pieces")
        out = StructType([self.queries.schema["q"], StructField("row", self.lists.schema[self.row_id].dataType), *StructType.fromDDL("score double").fields])
        schema = to_arrow_schema(out)

        def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
            if not rows.num_rows or not asks.num_rows:
                return schema.empty_table()
            x = np.array(rows.column("x").to_pylist(), np.float64)
            norm, ids = np.linalg.norm(x, axis=1), rows.column("row").to_pylist()
            v, q = np.array(asks.column("v").to_pylist(), np.float64), asks.column("q").to_pylist()
            found = []
            step = max(1, cells // len(x))
            for first in range(0, len(v), step):
                part = v[first : first + step]
                cos = np.round((part @ x.T) / (np.linalg.norm(part, axis=1)[:, None] * norm), 6)
                for k, line in enumerate(cos):
                    some = np.arange(len(line))
                    if len(line) > n:
                        some = np.flatnonzero(line >= np.partition(line, len(line) - n)[len(line) - n])
                    found += [(q[first + k], ids[j], float(line[j])) for j in sorted(some.tolist(), key=lambda j: (-line[j], ids[j]))[:n]]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        return rows.groupBy("cluster", "piece").cogroup(asks.groupBy("of", "of_piece")).applyInArrow(meet, out)

    def hits(self) -> DataFrame:
        """(query, row, score, rank): the n best rows by cosine (six digits), ties to the smaller id."""
        found = self._scored(self.chosen).withColumnsRenamed({"q": self.query_id, "row": self.row_id})
        return top(found, self.query_id, "score", self.row_id, self.n)

    def report(self) -> DataFrame:
        """(query, rows, compared): allowed rows, and how many of them lie in clusters that were not left out."""
        total = self.radius.agg(F.sum("rows").alias("rows"))
        each = self.chosen.join(self.radius, "cluster").groupBy("q").agg(F.sum("rows").alias("compared"))
        return each.crossJoin(F.broadcast(total)).withColumnRenamed("q", self.query_id).select(self.query_id, "rows", "compared")  # one row
