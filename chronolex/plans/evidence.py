"""Evidence and reconciliation queries: order lines say limits and values, orders arrive late, events wait in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import evidence as E
from chronolex.operators import reconcile as R
from chronolex.plans.catalog import query, table


@query(
    "quote_span",
    r"""WITH q AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(substr(text, 101, 40), '\s+', '', 'g'), '(?s).') AS c FROM documents),
    m AS (SELECT doc_id, text, regexp_extract(text, array_to_string(list_transform(c, lambda x: '\Q' || x || '\E'), '\s*')) AS piece FROM q WHERE len(c) > 0)
    SELECT doc_id, strpos(text, piece) - 1 AS span_start, strpos(text, piece) - 1 + length(piece) AS span_end FROM m WHERE piece <> ''""",
)
def quote_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a text's own passage, quoted without white space, first stands in it."""
    span = E.quote_span(F.regexp_replace(F.substring("text", 101, 40), "\\s+", ""), F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", span.alias("s")).filter("s IS NOT NULL")
    return d.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a clause with quantities, and the clause before it of the same part."""
    unit = F.element_at(F.array(F.lit("days"), F.lit("weeks"), F.lit("months")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    clause = F.concat(F.lit("within "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit, F.lit(" at "), (F.col("l_partkey") % 4).cast("string"), F.lit(" %"), F.when(F.col("l_returnflag") == "R", ", or 3 days").otherwise(""))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", clause.alias("clause"))
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return line.withColumn("before", F.lag("clause").over(w)).select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "clause", "before")


TERMS_SQL = """t0 AS (SELECT *, 'within ' || CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) || ' ' || ['days', 'weeks', 'months'][l_linenumber % 3 + 1] || ' at ' || CAST(l_partkey % 4 AS VARCHAR) || ' %' || CASE WHEN l_returnflag = 'R' THEN ', or 3 days' ELSE '' END AS clause FROM lineitem),
t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, clause, lag(clause) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS before FROM t0)"""


@query(
    "value_change_summary",
    f"""WITH {TERMS_SQL}, q AS (SELECT *, regexp_extract_all(before, '[0-9]+(?:\\.[0-9]+)? ?(?:days?|weeks?|months?|years?|%)') AS a, regexp_extract_all(clause, '[0-9]+(?:\\.[0-9]+)? ?(?:days?|weeks?|months?|years?|%)') AS b FROM t WHERE before IS NOT NULL),
    c AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x)) AS gone, list_filter(b, lambda x: NOT list_contains(a, x)) AS come FROM q)
    SELECT l_partkey, gone[1] || ' → ' || come[1] AS change, count(*) AS n FROM c WHERE len(gone) = 1 AND len(come) = 1 GROUP BY ALL""",
)
def value_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms(spark, sf_dir).select("l_partkey", E.value_change(F.col("before"), F.col("clause")).alias("change"))
    return t.filter("change IS NOT NULL").groupBy("l_partkey", "change").agg(F.count("*").alias("n"))


@query(
    "deadline_verdicts",
    f"""WITH {TERMS_SQL}, e AS (SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS elapsed, regexp_extract_all(clause, '([0-9]+) ?(day|week|month)s?', 1) AS n, regexp_extract_all(clause, '([0-9]+) ?(day|week|month)s?', 2) AS u FROM t JOIN orders ON o_orderkey = l_orderkey),
    s AS (SELECT *, list_distinct(list_transform(range(1, len(n) + 1), lambda k: [CAST(n[k] AS BIGINT) * CASE u[k] WHEN 'day' THEN 1 WHEN 'week' THEN 7 ELSE 28 END, CAST(n[k] AS BIGINT) * CASE u[k] WHEN 'day' THEN 1 WHEN 'week' THEN 7 ELSE 31 END])) AS spans FROM e)
    SELECT l_linenumber, CASE WHEN len(spans) <> 1 THEN 'open' WHEN elapsed <= spans[1][1] THEN 'met' WHEN elapsed > spans[1][2] THEN 'missed' ELSE 'conditional' END AS verdict, count(*) AS n FROM s GROUP BY ALL""",
)
def deadline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within the limit that they state, after it, or in what months leave open; open if two limits are stated."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    v = E.deadline_verdict(F.datediff("l_shipdate", "o_orderdate"), F.col("clause"))
    return terms(spark, sf_dir).join(o, "l_orderkey").groupBy("l_linenumber", F.coalesce(v, F.lit("open")).alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "split_notes",
    r"""WITH s AS (SELECT o_orderkey, 'Fee <New ' || strftime(o_orderdate, '%Y') || '> of ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' <Amended ' || strftime(o_orderdate, '%Y-%m-%d') || '>' ELSE ' ' END || ' <kept>' AS t FROM orders)
    SELECT o_orderkey, trim(regexp_replace(regexp_replace(t, '<(?:Amended|New|Deleted)[^<>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS rest, array_to_string(regexp_extract_all(t, '<(?:Amended|New|Deleted)[^<>]*>'), ';') AS notes FROM s""",
)
def split_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda f: F.date_format("o_orderdate", f)
    amended = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" <Amended "), day("yyyy-MM-dd"), F.lit(">"))).otherwise(" ")
    text = F.concat(F.lit("Fee <New "), day("yyyy"), F.lit("> of "), "o_orderpriority", amended, F.lit(" <kept>"))
    s = table(spark, sf_dir, "orders").select("o_orderkey", E.split_notes(text).alias("s"))
    return s.select("o_orderkey", F.col("s.text").alias("rest"), F.array_join("s.notes", ";").alias("notes"))


@query(
    "region_assignment",
    """WITH r AS (SELECT l_orderkey, l_linenumber % 2 AS page, l_linenumber AS region, l_partkey % 100 AS y0, l_partkey % 100 + 30 AS y1 FROM lineitem WHERE l_returnflag = 'N'),
    i AS (SELECT l_orderkey, l_linenumber % 2 AS page, l_suppkey, l_suppkey % 100 AS centre FROM lineitem WHERE l_returnflag <> 'N')
    SELECT i.l_orderkey, i.page, l_suppkey, centre, min(region) AS region FROM i JOIN r ON i.l_orderkey = r.l_orderkey AND i.page = r.page AND centre BETWEEN y0 AND y1 GROUP BY ALL""",
)
def region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as tables and regions on the two pages of an order."""
    line = table(spark, sf_dir, "lineitem").withColumn("page", F.col("l_linenumber") % 2)
    regions = line.filter("l_returnflag = 'N'").select("l_orderkey", "page", F.col("l_linenumber").alias("no"), (F.col("l_partkey") % 100).alias("y0"), (F.col("l_partkey") % 100 + 30).alias("y1"))
    items = line.filter("l_returnflag <> 'N'").select("l_orderkey", "page", "l_suppkey", (F.col("l_suppkey") % 100).alias("centre"))
    return R.assign_regions(items, regions, ["l_orderkey", "page"], "centre", "y0", "y1", F.col("no"), ["l_suppkey"])


@query(
    "row_set_equality",
    """WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, count(*) FILTER (WHERE l_discount <= 0.08) AS a, count(*) FILTER (WHERE l_tax <= 0.07) AS b FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS missing, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS extra FROM s WHERE a <> b GROUP BY l_orderkey""",
)
def row_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return R.row_set_changes(line.filter("l_discount <= 0.08D"), line.filter("l_tax <= 0.07D"), "l_orderkey", ["l_partkey", "l_linenumber"])


@query("overlap_scan", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < '2001-01-01') - INTERVAL 7 DAY AND NOT (o_orderstatus = 'F' AND o_orderdate < '2001-01-01')")
def overlap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    seen = o.filter("o_orderstatus = 'F' AND o_orderdate < '2001-01-01'")
    return R.overlap_scan(o, seen, "o_orderkey", "o_orderdate", 7).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query(
    "changed_owners",
    """SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')
    OR (SELECT max(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus <> 'P') > (SELECT min(o_orderdate) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')""",
)
def changed_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose pending orders stand for cells: none, or older than the newest other order."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.outdated(table(spark, sf_dir, "customer"), o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus = 'P'"), "c_custkey", "o_orderdate", "o_orderdate")


@query("seeded_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('0.42' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, "0.42")


@query("event_batches", "SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, CAST(sum(event_id) AS BIGINT) AS key_sum FROM events WHERE value > 50 GROUP BY ALL")
def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batches(table(spark, sf_dir, "events").filter("value > 50"), ["user_id", "event_type"], "event_id", "ts")


@query("distinct_by_bucket", "SELECT o_orderpriority AS bucket, count(*) AS n, count(DISTINCT o_custkey) AS owners, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS closed_owners FROM orders GROUP BY 1")
def distinct_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bucket"))
    return o.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("owners"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("closed_owners"))


@query("approx_distinct_facets")
def approx_distinct_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers per priority within two per cent (standard error), in constant memory a group."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("owners"))


@query("word_diff")
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept, gone and new between the turns of a conversation and the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).filter("before IS NOT NULL")
    d = t.select("conv_id", "turn", R.word_diff("before", "text").alias("ops"))
    return d.select("conv_id", "turn", *[c.alias(n) for n, c in R.counted(F.col("ops")).items()], F.md5(R.applied(F.col("ops"), "-")).alias("digest"))
