"""Queries that run a stream over the events to its end and return the snapshot it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.plans.catalog import query
from chronolex.streaming import outbox
from chronolex.streaming import retries as R


@query("stream_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user and kind."""
    s = outbox.read_events(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return outbox.upserted(s, ["user_id", "event_type"], "event_id")


@query(
    "outbox_claim_park",
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events),
    l AS (SELECT *, bad AND lag(bad) OVER w AND lag(bad, 2) OVER w AS third FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    p AS (SELECT user_id, min(event_id) FILTER (WHERE third) AS parked_at FROM l GROUP BY ALL)
    SELECT e.user_id, count(*) FILTER (WHERE parked_at IS NULL OR event_id <= parked_at) AS handled, count(*) FILTER (WHERE bad AND (parked_at IS NULL OR event_id <= parked_at)) AS failed,
    count(*) FILTER (WHERE event_id > parked_at) AS skipped, any_value(parked_at) AS parked_at FROM e JOIN p ON p.user_id = e.user_id GROUP BY ALL""",
)
def outbox_claim_park(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events fail (errors) three times running are parked; what comes after is skipped."""
    s = outbox.read_events(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    marks = outbox.with_strikes(s, "user_id", "event_id", "bad").withColumn("seen", F.col("handled") + F.col("skipped"))
    return outbox.upserted(marks, ["user_id"], "seen", "update").drop("seen")


@query(
    "retry_queue",
    """WITH e AS (SELECT user_id, {'a': 0, 'o': 0, 'p': CAST(NULL AS BIGINT), 's': 0, 'k': event_type, 'i': event_id} AS x FROM events WHERE event_type IN ('error', 'signup') AND user_id IS NOT NULL),
    l AS (SELECT user_id, [{'a': 0, 'o': 0, 'p': CAST(NULL AS BIGINT), 's': 0, 'k': '', 'i': CAST(0 AS BIGINT)}] || list(x ORDER BY x.i) AS xs FROM e GROUP BY ALL),
    r AS (SELECT user_id, list_reduce(xs, lambda t, x: CASE WHEN t.p IS NOT NULL THEN {'a': t.a, 'o': t.o, 'p': t.p, 's': t.s + 1, 'k': '', 'i': t.i}
      WHEN x.k = 'error' OR t.o = 2 THEN {'a': t.a + 1, 'o': 0, 'p': CASE WHEN t.a = 2 THEN x.i END, 's': 0, 'k': '', 'i': t.i} ELSE {'a': t.a, 'o': t.o + 1, 'p': NULL, 's': 0, 'k': '', 'i': t.i} END) AS t FROM l)
    SELECT user_id, CAST(t.a AS BIGINT) AS attempts, CAST(t.o AS BIGINT) AS outages, CASE WHEN t.p IS NULL THEN 'waiting' ELSE 'parked' END AS status, t.p AS ended_at, CAST(t.s AS BIGINT) AS skipped FROM r""",
)
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: errors are failures, sign-ups outages; three attempts park a job, three outages running are one attempt."""
    outcome = F.when(F.col("event_type") == "error", R.FAILED).when(F.col("event_type") == "signup", R.OUTAGE)
    s = outbox.read_events(spark, sf_dir, "events").select("user_id", "event_id", "ts", outcome.alias("outcome"))
    marks = R.queued(s, "user_id", "event_id", "outcome", "ts", "3650 days").filter("NOT due")
    with R.with_store(spark):
        return outbox.upserted(marks, ["user_id"], "changes", "update").drop("changes", "due")
