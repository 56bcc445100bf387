"""Line de-duplication across documents (native: DataFrame functions only).

Each text is split once, into hashes of its line keys, and these are written. They are partitioned by
range of hash and document and sorted by hash, document and position, so a key held by a third of all
documents spreads over many partitions. A window over that order, which moves nothing more, streams
the first occurrence of every key in every document; counting these per key, after a map-side
combine, tells the repeated keys and the document that keeps them. The result is a compressed keep
bitmap per document (runs of kept lines), not text; ``apply_bitmaps`` joins it to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import BLANKS, at_most, bind, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A repeated key takes about 40 bytes in memory: 20 MB at most are broadcast, more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def fold(text: Column) -> Column:
    """A-Z in lower case and nothing else; for pure ASCII the plain function does the same, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of every line whose key has min_chars code points or more.

    th tells apart rows that share a doc_id. The two seeds make a 128-bit hash of the key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(F.split(fold(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(keys).alias("pos", "key"))
    return rows.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def first_occurrences(lines: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, th, pos) of the first line of every key in every document, in the order of a sorted stream."""
    ordered = lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos", "th")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "th"))
    return ordered.withColumn("place", place).filter("place = 1").drop("place")


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper) of the keys in min_docs documents or more; keeper is the largest doc_id."""
    by_key = first_occurrences(lines).groupBy("h1", "h2").agg(F.count("pos").alias("n"), F.max("doc_id").alias("keeper"))
    return by_key.filter(F.col("n") >= min_docs).drop("n")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, th, dropped, kept_runs) of the documents that lose lines.

    kept_runs is the keep bitmap as runs: array of struct(start, len) over line positions from 0, the
    last run open-ended (len null). Nulls: a row without doc_id holds no keys and loses nothing; a null
    text is one empty line. Rows that share a doc_id count as one document. Extra columns are ignored.
    """
    lines = cut(line_hashes(docs, min_chars))
    keys = cut(repeated_keys(lines, min_docs))
    small = F.broadcast(keys) if at_most(keys, BROADCAST_KEYS) else keys
    lost = lines.join(small, ["h1", "h2"]).filter(F.col("doc_id") != F.col("keeper"))
    runs = lambda p: F.filter(  # noqa: E731  the gaps before, between and after the lost positions
        F.transform(
            F.sequence(F.lit(0), F.size(p)),
            lambda k: bind(
                F.coalesce(F.get(p, k - 1) + 1, F.lit(0)),
                lambda start: F.struct(start.alias("start"), (F.get(p, k) - start).alias("len")),
            ),
        ),
        lambda r: r["len"].isNull() | (r["len"] > 0),
    )
    by_doc = lost.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    return by_doc.select("doc_id", "th", F.size("p").cast("long").alias("dropped"), bind(F.col("p"), runs).alias("kept_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with ``text`` rebuilt from the kept lines, and the columns n_lines and n_dropped.

    Adaptive execution broadcasts the bitmaps where they are small; else the join shuffles by doc_id.
    """
    marks = bitmaps.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    own = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(marks, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    lines = F.split(own, "\n")
    kept = bind(
        lines,
        lambda x: F.array_join(
            F.flatten(F.transform("kept_runs", lambda r: F.slice(x, r["start"] + 1, F.coalesce(r["len"], F.size(x))))), "\n"
        ),
    )
    n_lines = F.char_length(own) - F.char_length(F.replace(own, F.lit("\n"))) + 1
    rebuilt = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", F.coalesce("dropped", F.lit(0)).cast("long"))
    return out.withColumn("text", rebuilt).drop("_id", "_th", "dropped", "kept_runs")


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line, a very long one is split like any other. Rows that share an
    id count as one document, repeated rows as well; each gives a row. A row without an id keeps all
    its lines. Extra columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select("doc_id", "text")
    out = apply_bitmaps(narrow, keep_bitmaps(narrow))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
