"""Table maintenance: the events before a day are a table (last row per user and kind), those after it the changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import upsert as U
from chronolex.plans.catalog import query, table
from chronolex.sources import releases as R
from chronolex.sources.storage import shared_folder

CUT = "2024-01-15"
KEYS = ["user_id", "event_type"]

SIDES_SQL = f"""
t AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY ALL),
n AS (SELECT user_id, event_type, max(event_id) AS event_id, CASE WHEN max(event_id) % 3 = 0 THEN NULL ELSE arg_max(value, event_id) END AS value FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY ALL)
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, cut = table(spark, sf_dir, "events"), F.lit(CUT).cast("timestamp_ntz")
    last = lambda d: d.groupBy(*KEYS).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    new = last(e.filter(F.col("ts") >= cut))
    return last(e.filter(F.col("ts") < cut)), new.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


@query("insert_absent", f"WITH {SIDES_SQL} SELECT * FROM t UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = n.user_id AND t.event_type = n.event_type)")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.insert_absent(*sides(spark, sf_dir), KEYS)


def _upsert_sql(value: str, guard: str = "true") -> str:
    return f"""WITH {SIDES_SQL} SELECT coalesce(t.user_id, n.user_id) AS user_id, coalesce(t.event_type, n.event_type) AS event_type,
    CASE WHEN t.user_id IS NULL THEN n.event_id WHEN n.user_id IS NULL OR NOT ({guard}) THEN t.event_id ELSE n.event_id END AS event_id,
    CASE WHEN t.user_id IS NULL THEN n.value WHEN n.user_id IS NULL OR NOT ({guard}) THEN t.value ELSE {value} END AS value,
    CASE WHEN t.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL OR NOT ({guard}) THEN 'kept' WHEN n.event_id = t.event_id AND {value} IS NOT DISTINCT FROM t.value THEN 'same' ELSE 'updated' END AS action
    FROM t FULL JOIN n ON t.user_id = n.user_id AND t.event_type = n.event_type"""


@query("upsert_latest_wins", _upsert_sql("n.value"))
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upsert(*sides(spark, sf_dir), KEYS)


@query("upsert_keep_null", _upsert_sql("coalesce(n.value, t.value)"))
def upsert_keep_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upsert(*sides(spark, sf_dir), KEYS, keep_when_null=("value",))


@query("upsert_guarded", _upsert_sql("n.value", "coalesce(t.value < 50, false)"))
def upsert_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of a small value may be overwritten."""
    return U.upsert(*sides(spark, sf_dir), KEYS, guard=F.col("_o.value") < 50)


@query(
    "update_guard_changed",
    f"WITH {SIDES_SQL} SELECT t.event_type, count(*) AS changed FROM t JOIN n ON t.user_id = n.user_id AND t.event_type = n.event_type WHERE floor(t.value / 100) IS DISTINCT FROM floor(n.value / 100) GROUP BY ALL",
)
def update_guard_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows an update of the value's class (hundreds) really changes, nulls compared as values."""
    old, new = (d.select(*KEYS, F.floor(F.col("value") / 100).alias("class")) for d in sides(spark, sf_dir))
    return U.upsert(old, new, KEYS).filter("action = 'updated'").groupBy("event_type").agg(F.count("*").alias("changed"))


@query(
    "map_merge",
    f"""WITH {SIDES_SQL} SELECT coalesce(t.user_id, n.user_id) AS user_id, coalesce(t.event_type, n.event_type) AS event_type,
    'id=' || CAST(coalesce(n.event_id, t.event_id) AS VARCHAR) || CASE WHEN n.user_id IS NOT NULL THEN ';new=yes' ELSE '' END || CASE WHEN t.user_id IS NOT NULL THEN ';old=yes' ELSE '' END AS entries
    FROM t FULL JOIN n ON t.user_id = n.user_id AND t.event_type = n.event_type""",
)
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids as maps: the entries of both sides, the newer side winning."""
    ids = lambda d, tag: d.select(*KEYS, F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit(tag), F.lit("yes")).alias(f"_{tag}"))
    old, new = sides(spark, sf_dir)
    both = ids(old, "old").join(ids(new, "new"), KEYS, "full_outer")
    entries = F.array_sort(F.transform(F.map_entries(U.merge_maps(F.col("_old"), F.col("_new"))), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return both.select(*KEYS, F.array_join(entries, ";").alias("entries"))


@query("replace_keys", f"WITH {SIDES_SQL} SELECT * FROM t WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n")
def replace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = sides(spark, sf_dir)
    return U.replace_keys(old, new, ["user_id"])


@query("mark_unseen", f"WITH {SIDES_SQL} SELECT t.user_id, t.event_type, n.user_id IS NULL AS gone FROM t LEFT JOIN n ON t.user_id = n.user_id AND t.event_type = n.event_type")
def mark_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = sides(spark, sf_dir)
    return U.mark_unseen(old, new, KEYS, "gone").select(*KEYS, "gone")


@query(
    "review_task_sync",
    f"""WITH {SIDES_SQL}, o AS (SELECT user_id, event_type FROM t WHERE value > 100), w AS (SELECT user_id, event_type FROM n WHERE value > 100)
    SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(o.event_type, w.event_type) AS event_type, CASE WHEN o.user_id IS NULL THEN 'opened' WHEN w.user_id IS NULL THEN 'resolved' ELSE 'refreshed' END AS status
    FROM o FULL JOIN w ON o.user_id = w.user_id AND o.event_type = w.event_type""",
)
def review_task_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = sides(spark, sf_dir)
    return U.sync_tasks(old.filter("value > 100"), new.filter("value > 100"), KEYS)


@query("recomputed_keys", "SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.09 AND o_custkey IS NOT NULL")
def recomputed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose lines are no longer the same after a rule changed (discounts above nine per cent are cut)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    stored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(o, "l_orderkey")
    again = stored.withColumn("l_discount", F.least("l_discount", F.lit(0.09)))
    return U.row_set_difference(stored, again, ["o_custkey"])


@query("retention", "SELECT event_id, event_type FROM events WHERE CAST(DATE '2024-02-10' - CAST(ts AS DATE) AS INT) < CASE event_type WHEN 'view' THEN 14 WHEN 'click' THEN 21 WHEN 'error' THEN 30 ELSE 100000 END")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("date").alias("day"))
    return U.retained(e, "event_type", "day", F.lit("2024-02-10").cast("date"), {"view": 14, "click": 21, "error": 30}).drop("day")


RELEASES_SQL = """
r AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'P' THEN 'building' ELSE 'failed' END AS status FROM orders),
k AS (SELECT *, rank() OVER (PARTITION BY o_custkey, status ORDER BY o_orderdate DESC) AS place FROM r)
"""


@query(
    "release_prune",
    f"WITH {RELEASES_SQL} SELECT o_orderkey, status FROM k WHERE NOT ((status = 'published' AND place <= 2) OR (status = 'building' AND date_diff('second', o_orderdate, TIMESTAMP '1999-01-01 03:00:00') < 21600))",
)
def release_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases of a customer's index: what may be removed on the first of January 1999, three in the morning."""
    status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "building").otherwise("failed")
    r = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"), status.alias("status"))
    return U.pruned(r, "o_custkey", "status", "at", F.lit("1999-01-01 03:00:00").cast("timestamp")).select("o_orderkey", "status")


@query(
    "promotion_plan",
    """SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'cited' ELSE 'configured' END AS why FROM part
    WHERE (p_partkey IN (SELECT l_partkey FROM lineitem) OR p_size > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_partkey IS NOT NULL) AND p_partkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL)""",
)
def promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cited or configured, but neither loaded (returned once in a large lot) nor waiting (signed up)."""
    line = table(spark, sf_dir, "lineitem")
    cited = line.select(F.col("l_partkey").alias("p_partkey")).distinct()
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(cited.withColumn("_c", F.lit(True)), "p_partkey", "left")
    loaded = line.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    waiting = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("p_partkey"))
    plan = part.filter("_c OR p_size > 45").join(loaded, "p_partkey", "left_anti").join(waiting, "p_partkey", "left_anti")
    return plan.select("p_partkey", F.when(F.col("_c"), "cited").otherwise("configured").alias("why"))


@query("unhandled_topics", "SELECT event_type AS topic, count(*) AS pending, min(event_id) AS oldest FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY ALL")
def unhandled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with pending events that no handler is registered for."""
    handlers = spark.createDataFrame([(t,) for t in ("click", "view", "purchase")], "topic string")
    pending = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("pending"), F.min("event_id").alias("oldest"))
    return pending.join(handlers, "topic", "left_anti")


@query(
    "keyed_releases",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders), c AS (SELECT DISTINCT o_custkey FROM o WHERE o_totalprice > 440000), g AS (SELECT o_custkey FROM o GROUP BY 1 HAVING min(o_totalprice) > 150000)
    SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (FROM c) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM o WHERE o_custkey IN (FROM c) OR o_custkey NOT IN (FROM g)""",
)
def keyed_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table keyed by customer: some customers' orders come anew, some customers go; their buckets are rewritten, the rest is taken over."""
    root = f"{shared_folder(spark)}/releases-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    R.publish(o, root, keys=["o_custkey"], buckets=16)
    dear = o.filter("o_totalprice > 440000").select("o_custkey").distinct()
    gone = o.groupBy("o_custkey").agg(F.min("o_totalprice").alias("least")).filter("least > 150000")
    changes = o.join(dear, "o_custkey", "left_semi").withColumn("o_orderstatus", F.lit("X"))
    R.replace_keys(changes, root, gone=gone.join(dear, "o_custkey", "left_anti"))
    return R.read(spark, root)
