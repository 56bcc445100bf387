"""Version-chain queries: orders stand for the versions of a customer's record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import diff as D
from chronolex.operators import versions as V
from chronolex.plans.catalog import query, table

TODAY = "1997-01-01"

CHAIN_SQL = f"""
v AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS valid_from,
        lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) NULLS LAST, o_orderkey) AS valid_to
      FROM orders),
c AS (SELECT *, CASE WHEN valid_from IS NULL THEN 'UNDATED' WHEN valid_from > DATE '{TODAY}' THEN 'FUTURE'
        WHEN valid_to IS NULL OR valid_to > DATE '{TODAY}' THEN 'CURRENT' ELSE 'HISTORICAL' END AS state FROM v)
"""


def orders_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("start")
    )
    return V.chain(o, "o_custkey", "start", ["o_orderkey"], F.lit(TODAY).cast("date")).drop("start")


@query(
    "flagship_current_version",
    f"""WITH {CHAIN_SQL}, k AS (SELECT *, lag(o_orderstatus) OVER w AS ps, lag(o_totalprice) OVER w AS pp FROM c
        WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from NULLS LAST, o_orderkey))
    SELECT o_custkey, o_orderkey, valid_from, valid_to, o_totalprice,
      CASE WHEN pp IS NULL THEN 'ADDED' WHEN ps IS DISTINCT FROM o_orderstatus THEN 'MODIFIED' ELSE 'ANNOTATION_ONLY' END AS change_kind
    FROM k WHERE state = 'CURRENT' AND (valid_to IS NULL OR valid_to > valid_from)""",
)
def flagship_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("valid_from").asc_nulls_last(), "o_orderkey")
    d = orders_chain(spark, sf_dir).withColumn("ps", F.lag("o_orderstatus").over(w)).withColumn("pp", F.lag("o_totalprice").over(w))
    kind = F.when(F.col("pp").isNull(), "ADDED").when(~F.col("ps").eqNullSafe(F.col("o_orderstatus")), "MODIFIED").otherwise("ANNOTATION_ONLY")
    return d.filter((F.col("state") == "CURRENT") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))).select(
        "o_custkey", "o_orderkey", "valid_from", "valid_to", "o_totalprice", kind.alias("change_kind")
    )


@query("version_chain", f"WITH {CHAIN_SQL} SELECT o_custkey, o_orderkey, valid_from, valid_to, state FROM c")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_chain(spark, sf_dir).select("o_custkey", "o_orderkey", "valid_from", "valid_to", "state")


@query("version_state_counts", f"WITH {CHAIN_SQL} SELECT state, count(*) AS n, count(DISTINCT o_custkey) AS works FROM c GROUP BY state")
def version_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_chain(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("works"))


@query("asof_half_open", f"WITH {CHAIN_SQL} SELECT o_custkey, o_orderkey, valid_from, valid_to FROM c WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to > DATE '1998-06-30')")
def asof_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1998-06-30").cast("date")
    return V.valid_at(orders_chain(spark, sf_dir), day).select("o_custkey", "o_orderkey", "valid_from", "valid_to")


@query(
    "asof_latest_before",
    f"""WITH {CHAIN_SQL} SELECT o_custkey, o_orderkey, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from DESC, o_orderkey DESC) AS r
    FROM c WHERE valid_from <= DATE '1998-06-30') WHERE r = 1""",
)
def asof_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("1998-06-30").cast("date")
    return V.latest_before(orders_chain(spark, sf_dir), "o_custkey", "o_orderkey", day).select("o_custkey", "o_orderkey", "valid_from")


@query(
    "asof_bulk_dated_targets",
    f"""WITH {CHAIN_SQL}, s AS (SELECT o_orderkey AS source, o_custkey + 1 AS cited, valid_from AS d FROM c),
    h AS (SELECT source, cited, d, max(struct_pack(f := valid_from, o := t.o_orderkey)) AS hit FROM s LEFT JOIN c t ON t.o_custkey = cited AND t.valid_from <= d GROUP BY ALL),
    r AS (SELECT o_custkey AS cited, max(struct_pack(f := valid_from, o := o_orderkey)) FILTER (WHERE state = 'CURRENT') AS cur, max(struct_pack(f := valid_from, o := o_orderkey)) AS last FROM c GROUP BY ALL)
    SELECT source, h.cited, d, coalesce(hit.o, cur.o, last.o) AS target, CASE WHEN hit.o IS NOT NULL THEN 'as_of' WHEN cur.o IS NOT NULL THEN 'current' WHEN last.o IS NOT NULL THEN 'historical' ELSE 'missing' END AS "match"
    FROM h LEFT JOIN r ON h.cited = r.cited""",
)
def asof_bulk_dated_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = orders_chain(spark, sf_dir)
    sources = c.select(F.col("o_orderkey").alias("source"), (F.col("o_custkey") + 1).alias("cited"), F.col("valid_from").alias("d"))
    return V.dated_targets(sources, c.withColumnRenamed("o_custkey", "cited"), "cited", "d", "o_orderkey").select("source", "cited", "d", "target", "match")


@query(
    "version_pairs",
    f"WITH {CHAIN_SQL}, p AS (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY valid_from, o_orderkey) AS prev, o_orderkey AS version FROM c) SELECT * FROM p WHERE prev IS NOT NULL",
)
def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey")
    p = orders_chain(spark, sf_dir).select("o_custkey", F.lag("o_orderkey").over(w).alias("prev"), F.col("o_orderkey").alias("version"))
    return p.filter("prev IS NOT NULL")


@query(
    "version_id_alloc",
    """SELECT o_custkey, o_orderkey, CAST(o_custkey AS VARCHAR) || '@' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || CASE WHEN n > 1 THEN '.' || CAST(n AS VARCHAR) ELSE '' END AS version_id
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders)""",
)
def version_id_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return V.version_ids(o, "o_custkey", "d", ["o_orderkey"]).drop("d")


PARTS_SQL = """
l0 AS (SELECT l_orderkey AS version, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
    'a' || CAST(l_linenumber AS VARCHAR) AS base, substr(sha256(l_returnflag || '|' || CAST(l_partkey % 40 AS VARCHAR)), 1, 32) AS hash FROM lineitem),
l1 AS (SELECT *, row_number() OVER (PARTITION BY version, base ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM l0),
parts AS (SELECT version, l_linenumber * 1000 + n AS ord, base || CASE WHEN n > 1 THEN '~' || CAST(n AS VARCHAR) ELSE '' END AS path, hash, l_returnflag AS heading, l_linestatus AS notes FROM l1),
pairs AS (SELECT * FROM (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS prev, o_orderkey AS version FROM orders) WHERE prev IS NOT NULL)
"""


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the parts of a version: a path that is unique in it, a content hash, notes."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("version"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_returnflag").alias("heading"), F.col("l_linestatus").alias("notes"),
        F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("path"), D.content_hash(F.col("l_returnflag"), (F.col("l_partkey") % 40).cast("string")).alias("hash"),
    )
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    line = V.number_in_group(line, ["version", "l_linenumber"], order, "n")
    return V.suffix_duplicates(line, ["version"], "path", order).select("version", (F.col("l_linenumber") * 1000 + F.col("n")).alias("ord"), "path", "hash", "heading", "notes")


@query("duplicate_suffix", f"WITH {PARTS_SQL} SELECT version, ord, path, hash FROM parts")
def duplicate_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_parts(spark, sf_dir).select("version", "ord", "path", "hash")


CHANGES_SQL = """
o AS (SELECT o_custkey, p.prev, p.version, x.* EXCLUDE (version) FROM pairs p JOIN parts x ON x.version = p.prev),
n AS (SELECT p.o_custkey, p.prev, x.* FROM pairs p JOIN parts x ON x.version = p.version),
j AS (SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.prev, n.prev) AS prev, coalesce(o.version, n.version) AS version, o.path AS op, n.path AS np, o.hash AS oh, n.hash AS nh,
    o.heading AS oe, n.heading AS ne, o.notes AS ot, n.notes AS nt, o.ord AS oo, n.ord AS no_ FROM o FULL JOIN n ON o.version = n.version AND o.path = n.path),
g AS (SELECT *, row_number() OVER (PARTITION BY version, oh ORDER BY oo, op) AS k FROM j WHERE np IS NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY version, nh ORDER BY no_, np) AS k FROM j WHERE op IS NULL),
m AS (SELECT coalesce(g.o_custkey, c.o_custkey) AS o_custkey, coalesce(g.prev, c.prev) AS prev, coalesce(g.version, c.version) AS version, g.op AS old_path, c.np AS new_path,
    CASE WHEN g.op IS NULL THEN 'ADDED' WHEN c.np IS NULL THEN 'DELETED' ELSE 'RENUMBERED' END AS change_kind FROM g FULL JOIN c ON g.version = c.version AND g.oh = c.nh AND g.k = c.k),
s AS (SELECT o_custkey, prev, version, op AS old_path, np AS new_path, CASE WHEN oh <> nh OR oe <> ne THEN 'MODIFIED' WHEN ot <> nt THEN 'ANNOTATION_ONLY' END AS change_kind FROM j WHERE op IS NOT NULL AND np IS NOT NULL),
changes AS (SELECT * FROM m UNION ALL SELECT * FROM s WHERE change_kind IS NOT NULL)
"""
DIFF_SQL = f"{PARTS_SQL}, {CHANGES_SQL}"


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sequential(order_parts(spark, sf_dir), version_pairs(spark, sf_dir), "o_custkey", F.lit(True))


@query("diff_sequential", f"WITH {DIFF_SQL} SELECT * FROM changes")
def diff_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_changes(spark, sf_dir)


@query("change_summary", f"WITH {DIFF_SQL} SELECT version, change_kind, count(*) AS n, min(coalesce(new_path, old_path)) AS first_path FROM changes WHERE change_kind <> 'ANNOTATION_ONLY' GROUP BY ALL")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_changes(spark, sf_dir).filter("change_kind <> 'ANNOTATION_ONLY'")
    return d.groupBy("version", "change_kind").agg(F.count("*").alias("n"), F.min(F.coalesce("new_path", "old_path")).alias("first_path"))


@query(
    "diff_two_versions",
    f"""WITH {PARTS_SQL}, e AS (SELECT o_custkey, min_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS a, max_by(o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS b FROM orders GROUP BY ALL),
    o AS (SELECT o_custkey, x.*, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) AS ident FROM e JOIN parts x ON x.version = a),
    n AS (SELECT o_custkey, x.*, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) AS ident FROM e JOIN parts x ON x.version = b),
    j AS (SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.ident, n.ident) AS ident, o.path AS op, n.path AS np, n.ord AS no_, o.ord AS oo,
      CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'DELETED' WHEN o.hash <> n.hash OR o.heading <> n.heading THEN 'MODIFIED' WHEN o.path <> n.path THEN 'RENUMBERED' WHEN o.notes <> n.notes THEN 'ANNOTATION_ONLY' END AS change_kind
      FROM o FULL JOIN n ON o.o_custkey = n.o_custkey AND o.ident = n.ident)
    SELECT o_custkey, ident, change_kind, coalesce(op <> np, false) AS moved, coalesce(CAST(no_ AS DOUBLE), oo + 0.5::DOUBLE) AS place FROM j WHERE change_kind IS NOT NULL""",
)
def diff_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(F.col("o_orderdate").cast("date"), "o_orderkey")
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("a"), F.max_by("o_orderkey", order).alias("b"))
    parts = order_parts(spark, sf_dir)
    side = lambda c: V.number_in_group(ends.select("o_custkey", F.col(c).alias("version")).join(parts, "version"), ["o_custkey"], ["ord"], "ident")
    return D.any_two(side("a"), side("b"), "o_custkey")


@query(
    "subtree_hash_changelog",
    f"""WITH {PARTS_SQL}, h AS (SELECT version, md5(string_agg(path || '=' || hash, ';' ORDER BY path || '=' || hash)) AS subtree FROM parts GROUP BY version)
    SELECT o_custkey, p.prev, p.version, CASE WHEN a.subtree IS NULL THEN 'added' WHEN b.subtree IS NULL THEN 'deleted' WHEN a.subtree <> b.subtree THEN 'modified' ELSE 'same' END AS change
    FROM pairs p LEFT JOIN h a ON a.version = p.prev LEFT JOIN h b ON b.version = p.version WHERE a.subtree IS NOT NULL OR b.subtree IS NOT NULL""",
)
def subtree_hash_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = D.subtree_hash(order_parts(spark, sf_dir), ["version"], "path", "hash")
    p = version_pairs(spark, sf_dir)
    d = p.join(h.select(F.col("version").alias("prev"), F.col("subtree").alias("a")), "prev", "left").join(h.withColumnRenamed("subtree", "b"), "version", "left")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return d.filter("a IS NOT NULL OR b IS NOT NULL").select("o_custkey", "prev", "version", change.alias("change"))


@query(
    "lineage_history",
    f"""WITH {PARTS_SQL}, v AS (SELECT o_custkey, path, o_orderkey AS version, CAST(o_orderdate AS DATE) AS d, hash FROM orders JOIN parts ON version = o_orderkey),
    w AS (SELECT *, lag(hash) OVER (PARTITION BY o_custkey, path ORDER BY d, version) AS before, lead(version) OVER (PARTITION BY o_custkey, path ORDER BY d, version) AS later FROM v)
    SELECT o_custkey, path, version, CASE WHEN before IS NULL THEN 'ADDED' WHEN before <> hash THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change_kind, later IS NULL AS last_seen FROM w""",
)
def lineage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("date").alias("d"))
    w = Window.partitionBy("o_custkey", "path").orderBy("d", "version")
    v = o.join(order_parts(spark, sf_dir), "version").withColumn("before", F.lag("hash").over(w)).withColumn("later", F.lead("version").over(w))
    kind = F.when(F.col("before").isNull(), "ADDED").when(F.col("before") != F.col("hash"), "MODIFIED").otherwise("UNCHANGED")
    return v.select("o_custkey", "path", "version", kind.alias("change_kind"), F.col("later").isNull().alias("last_seen"))


@query(
    "amendment_events",
    f"""WITH {CHAIN_SQL}, s AS (SELECT *, max(valid_from) FILTER (WHERE o_orderkey % 3 <> 0) OVER (PARTITION BY o_custkey) AS known FROM c)
    SELECT o_custkey, o_orderkey, valid_from FROM s WHERE o_orderkey % 3 = 0 AND known IS NOT NULL AND valid_from > known""",
)
def amendment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the versions that arrive (order numbers divisible by three), those newer than all that were there before."""
    c = orders_chain(spark, sf_dir)
    known = F.max(F.when(F.col("o_orderkey") % 3 != 0, F.col("valid_from"))).over(Window.partitionBy("o_custkey"))
    return c.withColumn("known", known).filter("o_orderkey % 3 = 0 AND valid_from > known").select("o_custkey", "o_orderkey", "valid_from")


@query(
    "validity_envelope",
    f"""WITH {CHAIN_SQL} SELECT o_custkey, o_orderpriority, min(valid_from) AS first_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS last_to,
    bool_or(state = 'CURRENT') AS is_current, count(*) AS n FROM c GROUP BY ALL""",
)
def validity_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each content (customer, priority) was in force: open-ended if any of its versions is."""
    open_end = F.bool_or(F.col("valid_to").isNull())
    return orders_chain(spark, sf_dir).groupBy("o_custkey", "o_orderpriority").agg(
        F.min("valid_from").alias("first_from"), F.when(~open_end, F.max("valid_to")).alias("last_to"), F.bool_or(F.col("state") == "CURRENT").alias("is_current"), F.count("*").alias("n")
    )


LEDGER_SQL = """
d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events),
n AS (SELECT *, lead(day) OVER (PARTITION BY user_id, event_type ORDER BY day) AS back FROM d)
"""


@query(
    "abolition_ledger",
    f"""WITH {LEDGER_SQL}, g AS (SELECT user_id, event_type, day + 1 AS missing_since, back, coalesce(back, DATE '2024-01-31') - (day + 1) AS days FROM n)
    SELECT user_id, event_type, missing_since, back AS seen_again, CAST(days AS INTEGER) AS days_missing, CASE WHEN back IS NOT NULL THEN 'RESET' ELSE 'CANDIDATE' END AS state FROM g WHERE days >= 3""",
)
def abolition_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (user, kind) not seen on three listing days running: candidates for removal, reset when they come back."""
    d = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day")).distinct()
    n = d.withColumn("back", F.lead("day").over(Window.partitionBy("user_id", "event_type").orderBy("day"))).withColumn("missing_since", F.date_add("day", 1))
    days = F.datediff(F.coalesce("back", F.lit("2024-01-31").cast("date")), "missing_since")
    state = F.when(F.col("back").isNotNull(), "RESET").otherwise("CANDIDATE")
    return n.withColumn("days_missing", days).filter("days_missing >= 3").select("user_id", "event_type", "missing_since", F.col("back").alias("seen_again"), "days_missing", state.alias("state"))


@query(
    "shrink_guard",
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), f AS (SELECT user_id, min(day) AS first FROM d GROUP BY ALL),
    s AS (SELECT day, count(*) AS seen FROM d GROUP BY ALL), a AS (SELECT first AS day, count(*) AS fresh FROM f GROUP BY ALL),
    k AS (SELECT s.day, seen, CAST(sum(coalesce(fresh, 0)) OVER (ORDER BY s.day) AS BIGINT) AS known FROM s LEFT JOIN a ON s.day = a.day)
    SELECT day, seen, known, known >= 10 AND seen * 2 < known AS rejected FROM k""",
)
def shrink_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that shows less than half of ten or more known items is not believed. The running sum is over days only."""
    d = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    fresh = d.groupBy("user_id").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("fresh"))
    k = d.groupBy("day").agg(F.count("*").alias("seen")).join(fresh, "day", "left").withColumn("known", F.sum(F.coalesce("fresh", F.lit(0))).over(Window.orderBy("day")))
    return k.select("day", "seen", "known", ((F.col("known") >= 10) & (F.col("seen") * 2 < F.col("known"))).alias("rejected"))
