"""Source divergence audit: how far the sources of a language are apart in their terms, by DuckDB over shards.

1. Tasks count terms as they read: a byte map makes terms of whole columns, DuckDB counts them per text and then per
   group (lang, source), FLUSH_ROWS counted terms at a time. No (document, term) row leaves a task.
2. The counts are dealt to shards by hash of lang and term. A shard's SQL adds them up, drops terms that too few documents of
   the lang hold, and writes a row per kept term with its sources' counts.
3. Spark adds up each group's occurrences N and each lang's kept terms V, and sends them.
4. The kept terms are read again as they lie, nothing is shuffled: SQL turns counts into shares in whole numbers, adds the
   absolute differences of each pair of sources, and keeps the best terms of each group in the task.
5. Spark merges the partial sums of pairs and the partial rankings of terms.

A frequent term or a lang that holds most rows is spread: by terms in 2 and by files in 4, and each task sends at most
one row per group and term, one per pair of groups, or ``top`` per group. Pair sums take V times the square of a lang's
sources, which is also the number of its result rows for V = 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm import bytewords
from chronolex.llm.common import at_most, cut, slices

MIN_DOCS, TOP, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
TERMS = bytewords.table(bytewords.LETTERS)
#: Counted terms that a task holds before it passes them on, and rows that go through SQL at once.
FLUSH_ROWS = 1_000_000
#: Groups (lang, source) that are sent to the tasks; beyond it they are joined to the terms.
SENT_GROUPS = 100_000
MEMORY = "300MB"

PARTIAL = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, term string, total long, sources array<string>, counts array<long>"


def _connect() -> duckdb.DuckDBPyConnection:
    """An engine in the task's own process, with one thread and no files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


def _batches(found: duckdb.DuckDBPyRelation, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from found.to_arrow_table().select(schema.names).cast(schema).to_batches(max_chunksize=50_000)


def _words(p: bytewords.Piece) -> pa.Array:
    """The piece's words as an Arrow array of strings."""
    raw = np.frombuffer(p.data, np.uint8)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[p.starts] += 1
    edge[p.ends] -= 1
    offsets = np.concatenate([[0], np.cumsum(p.ends - p.starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(p.starts), pa.py_buffer(offsets), pa.py_buffer(raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]))


def counter(schema: pa.Schema, flush_rows: int, piece_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: texts to occurrences and documents of each term in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connect()
        db.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        db.execute("CREATE TABLE found (doc BIGINT, term VARCHAR, n BIGINT)")
        total = "SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM held GROUP BY ALL"
        rows = 0
        for batch in slices(batches, "text"):
            db.register("groups", pa.table({"doc": np.arange(batch.num_rows), "lang": batch.column("lang"), "source": batch.column("source")}))
            for p in bytewords.pieces(*bytewords.texts(batch.column("text")), TERMS, 0, piece_bytes):
                db.register("words", pa.table({"doc": p.rows, "term": _words(p)}))
                db.execute("INSERT INTO found SELECT doc, term, count(*) FROM words GROUP BY doc, term")
                db.unregister("words")
            per_doc = "SELECT doc, term, sum(n) AS n FROM found GROUP BY doc, term"
            rows += db.execute(f"INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM ({per_doc}) JOIN groups USING (doc) GROUP BY ALL").fetchall()[0][0]
            db.execute("DELETE FROM found")
            db.unregister("groups")
            if rows > flush_rows:
                db.execute(f"CREATE OR REPLACE TABLE held AS SELECT lang, source, term, n::BIGINT AS n, docs::BIGINT AS docs FROM ({total})")
                rows = db.execute("SELECT count(*) FROM held").fetchall()[0][0]
                if rows > flush_rows // 2:
                    yield from _batches(db.sql("FROM held"), schema)
                    db.execute("DELETE FROM held")
                    rows = 0
        yield from _batches(db.sql(total), schema)

    return run


def shard(schema: pa.Schema, min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: all counts of a shard's terms to a row per kept term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connect()
        db.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            db.register("more", pa.table(batch))
            db.execute("INSERT INTO held FROM more")
            db.unregister("more")
        summed = "SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM held GROUP BY ALL"
        kept = f"SELECT lang, term, sum(n)::BIGINT AS total, list(source ORDER BY source) AS sources, list(n::BIGINT ORDER BY source) AS counts FROM ({summed}) GROUP BY lang, term HAVING sum(docs) >= {min_docs}"
        yield from _batches(db.sql(kept), schema)

    return run


#: The share of n among the (N, V) of a group or lang, in parts of UNIT.
SHARE = f"(1 + ({UNIT}::HUGEINT * (n + {SMOOTHING})) // (N_ + {SMOOTHING} * V_))::BIGINT"


def audit(groups, schema: pa.Schema, top: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: kept terms to partial sums of pairs (the smaller source first) and the best terms of each group."""

    def best(table: str) -> str:
        return f"SELECT part, lang, source, item, value FROM {table} WHERE part = 'term' QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _connect()
        db.register("sent", groups.value)
        db.execute("CREATE TABLE g AS SELECT row_number() OVER () AS gid, lang, source, n AS N_, v AS V_ FROM sent")
        db.execute("CREATE TABLE l AS SELECT lang, sum(N_)::BIGINT AS N_, any_value(V_) AS V_ FROM g GROUP BY lang")
        db.execute("CREATE TABLE held (part VARCHAR, lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")

        def add(terms: pa.Table) -> None:
            db.register("terms", terms.append_column("tid", pa.array(np.arange(terms.num_rows))))
            db.execute("CREATE OR REPLACE TEMP TABLE cells AS SELECT tid, gid, n FROM (SELECT tid, lang, unnest(sources) AS source, unnest(counts) AS n FROM terms) JOIN g USING (lang, source)")
            db.execute(f"CREATE OR REPLACE TEMP TABLE p AS SELECT tid, gid, n, {SHARE} AS p FROM (SELECT t.tid, g.gid, coalesce(c.n, 0) AS n, N_, V_ FROM terms t JOIN g ON t.lang = g.lang LEFT JOIN cells c ON c.tid = t.tid AND c.gid = g.gid)")
            pairs = "SELECT a.gid AS a, b.gid AS b, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.tid = b.tid AND a.gid < b.gid GROUP BY ALL"
            db.execute(f"INSERT INTO held SELECT 'pair', x.lang, x.source, y.source, value FROM ({pairs}) JOIN g x ON x.gid = a JOIN g y ON y.gid = b")
            q = f"SELECT tid, term, {SHARE} AS q FROM (SELECT tid, term, total AS n, N_, V_ FROM terms JOIN l USING (lang))"
            db.execute(f"CREATE OR REPLACE TEMP TABLE above AS SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM p JOIN ({q}) USING (tid) JOIN g USING (gid) WHERE n > 0 AND p > q")
            db.execute(f"INSERT INTO held {best('above')}")
            db.execute(f"CREATE OR REPLACE TABLE held AS SELECT part, lang, source, item, sum(value)::BIGINT AS value FROM held WHERE part = 'pair' GROUP BY ALL UNION ALL {best('held')}")
            db.unregister("terms")

        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= step:
                add(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            add(pa.Table.from_batches(waiting))
        yield from _batches(db.sql("FROM held"), schema)

    return run


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, piece_bytes: int = bytewords.PIECE_BYTES) -> DataFrame:
    """(lang, term, total, sources, counts) of the terms in min_docs documents of a lang or more, written."""
    d = docs.select("text", "lang", "source").select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    counts = d.mapInArrow(counter(_arrow(PARTIAL), FLUSH_ROWS, piece_bytes), PARTIAL)
    dealt = counts.repartition("lang", "term")  # as many shards as the session has shuffle partitions, or fewer by size
    return cut(dealt.mapInArrow(shard(_arrow(KEPT), min_docs), KEPT))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **options) -> DataFrame:
    """(lang, source, part, item, value, rank): how far apart sources are, and by which terms each stands out of its lang.

    Null text, lang and source are empty; a text without a term counts for its group, which still has its
    pairs. Rows count as documents, whatever their ids, repeated ones as well. Very long texts are
    counted in pieces. Ties of value go by item. Other columns are left behind, so their names can't
    clash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = kept_terms(docs, min_docs, **options)
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = cut(groups.join(cells, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "v"]))
    out = "part string, lang string, source string, item string, value long"
    blocks = 1 if at_most(groups, SENT_GROUPS) else -(-2 * groups.count() // SENT_GROUPS)
    partial = None
    for k in range(blocks):  # langs in blocks, should there be too many groups to send at once
        mine = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k
        sent = spark.sparkContext.broadcast(groups.filter(mine).toArrow())
        more = kept.filter(mine).mapInArrow(audit(sent, _arrow(out), top, 5_000), out)
        partial = more if partial is None else partial.unionByName(more)
    partial = cut(partial)
    sums = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    sums = sums.select("lang", both.alias("b"), "value").select("lang", "b.source", "b.item", "value")
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = partial.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM t GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(n) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS ng FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (ng + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (nl + 5 * v) AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: lang, source, part, item, value, rank; see ``divergence`` for the awkward rows."""
    return divergence(docs)
