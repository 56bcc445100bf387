"""Mixing sources to target weights by weighted sampling with exponential keys.

Each document gets the key -ln(u) / weight, u being uniform and fixed by its id (Efraimidis and
Spirakis). A source's target is spent on complete epochs first; the rest of the budget goes to its
documents in key order, by prefix sums. Prefix sums are two-level: the keys' range is cut into equal
parts, the parts are summed first (map-side combined), and only documents of the part in which the
budget ends are sorted, so no source is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import SYMBOLS, WORD_RE, cut, without

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Parts of the key range for each factor of e. Whatever the weights, the logarithm of an exponential key has a density
#: of 1 / e at most, so a part, and with it what is sorted, is expected to hold 1 / (e * PARTS) of a source's documents at most.
PARTS = 1024


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more symbols come per word."""
    t = F.coalesce(text, F.lit(""))
    return 1.0 / (1.0 + (F.char_length(t) - F.char_length(without(t, SYMBOLS))) / F.greatest(size, F.lit(1)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source, size, key, part) of each document. Reruns give the same keys; without an id the text gives one."""
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "source", size_of(F.col("text")).alias("size"), "text")
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 13), 16, 10).cast("double")
    d = d.withColumn("key", -F.log((bits + 0.5) / float(1 << 52)) / quality_weight(F.col("text"), F.col("size"))).drop("text")
    return d.withColumn("part", F.floor(F.log("key") * PARTS).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    One row per source, so the unpartitioned windows are small. Sources are filled in order of their
    cap per weight: one whose cap is below its share of what is left gets the cap, the others share.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(after))
    s = s.withColumn("capped", F.col("cap") * F.col("ws") <= (F.col("total") - F.col("caps")) * F.col("w"))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
    share = F.col("left").cast("double") * F.col("w").cast("double") / F.col("open").cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, th, size, source_size, target, taken) per document, taken counting repeats.

    A null text has size 0, a null source is a source of its own (the last). Rows with equal ids have
    equal keys and are ordered by size. A document is taken whole; the one at the end of the budget is
    taken if that brings the source nearer to its target. An empty table gives no rows.
    """
    d = cut(keyed(docs))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    goals = goals.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    goals = goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.withColumn("upto", F.sum("part_size").over(up_to)).alias("p").join(goals.alias("g"), F.expr("p.source <=> g.source"))
    # The first part whose end reaches the budget; without one (a budget of 0 included) it is the first.
    ending = ends.groupBy("g.source", "source_size", "target", "epochs", "budget").agg(
        F.min_by(F.struct("p.part", (F.col("upto") - F.col("part_size")).alias("before")), F.when(F.col("upto") >= F.col("budget"), F.col("p.part"))).alias("c")
    )
    ending = ending.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "budget", F.col("c.part").alias("_part"), F.col("c.before").alias("_before"))
    rows = d.join(ending, F.expr("source <=> _source"))
    inner = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.filter("part = _part").withColumn("upto", F.sum("size").over(inner) + F.col("_before"))
    over, under = F.col("upto") - F.col("budget"), F.col("budget") - (F.col("upto") - F.col("size"))
    edge = edge.withColumn("more", ((over <= 0) | ((under > 0) & (over < under))).cast("long")).drop("upto")
    rest = rows.filter("part <> _part").withColumn("more", (F.col("part") < F.col("_part")).cast("long"))
    both = rest.unionByName(edge)
    return both.select("doc_id", "th", "size", "source_size", "target", ((F.col("epochs") + F.col("more")) * F.col("size")).cast("long").alias("taken"), (F.col("epochs") + F.col("more")).cast("int").alias("copies"))


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents repeated as often as the mix takes them; those not taken go.

    Rows with the same id and text are told apart by their number only, so each is counted once: the
    join is on id and text hash with the mix pre-aggregated to the copies of such a group's row.
    """
    n = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    one = docs.join(n, F.expr("doc_id <=> _id") & (F.xxhash64("text") == F.col("_th")))
    base = F.floor(F.col("_all") / F.col("_rows")).cast("int")
    again = F.when(F.col("_rows") > 1, F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.lit(1))) <= F.col("_all") % F.col("_rows")).otherwise(F.lit(False))
    plain = one.filter("_rows = 1").withColumn("_n", base)
    twins = one.filter("_rows > 1").withColumn("_n", base + again.cast("int"))
    return plain.unionByName(twins).filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS sym,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
k AS (SELECT *, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + CAST(sym AS DOUBLE) / greatest(size, 1))) AS key FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps,
    CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM s1),
s3 AS (SELECT *, cap * ws <= (total - caps) * w AS capped FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) * w / CAST(sum(w) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM s4),
r AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS budget,
    CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto
    FROM k JOIN s5 ON k.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto <= budget OR (upto - size < budget AND upto - budget < budget - (upto - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, size, source_size, target, taken.

    A null text has size 0, a null source is one of its own and the last, a row without an id is keyed by its
    text. Repeated rows are taken or left alike, but for the one at the end of the budget; a very long
    text counts whole; extra columns are ignored; an empty table gives no rows.
    """
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
