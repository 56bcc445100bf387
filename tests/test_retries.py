"""Jobs that are tried again: whatever the order of arrival, where the order of the numbers leads."""

import datetime as dt
import itertools
import random
import time

import pytest

from chronolex.streaming import outbox
from chronolex.streaming import retries as R

SCHEMA = "job string, n long, outcome string"
TIMED = f"{SCHEMA}, at timestamp"


def timed(rows, hour=0):
    return [(*x, dt.datetime(2024, 1, 1, hour, x[1] % 60)) for x in rows]


def test_rules():
    r = R.Rules()
    fold = lambda s: r.fold(enumerate({"f": R.FAILED, "o": R.OUTAGE, "d": R.DONE}[c] for c in s))
    assert fold("")[0] == R.Job(0, 0, "waiting", None)
    assert fold("oo")[0] == R.Job(0, 2, "waiting", None) and fold("ooo")[0] == R.Job(1, 0, "waiting", None)
    assert fold("oofoo")[0] == R.Job(1, 2, "waiting", None) and fold("fofof")[0] == R.Job(3, 0, "parked", 4)
    assert fold("fdff") == (R.Job(1, 0, "done", 1), [2, 3])
    # The end never moves back by an event that comes late, so those after it need not be kept.
    for s in map("".join, itertools.product("fod", repeat=6)):
        end = fold(s)[0].ended_at
        for k in range(6):
            less = [(i, {"f": R.FAILED, "o": R.OUTAGE, "d": R.DONE}[c]) for i, c in enumerate(s) if i != k]
            before = r.fold(less)[0].ended_at
            assert before is None or (end is not None and end <= before)


@pytest.mark.parametrize("seed", range(2))
def test_batches_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    events = [(f"j{j}", n, r.choice([R.FAILED, R.OUTAGE, R.OUTAGE, R.OUTAGE, R.DONE if j % 4 == 0 else "noise"])) for j in range(12) for n in range(r.randint(1, 12))]
    want = {}
    for j in {e[0] for e in events}:
        own = sorted((n, o) for k, n, o in events if k == j and o != "noise")
        if own:
            job, late = R.Rules().fold(own)
            want[j] = (job.attempts, job.outages, job.status, job.ended_at, len(late))
    r.shuffle(events)
    for k in range(4):
        spark.createDataFrame(timed(events[k::4] + [(None, k, R.FAILED)]), TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches = []

    def take(batch, number):
        batches.append([r.asDict() for r in batch.collect()])

    with R.with_store(spark):
        run = R.queued(stream, "job", "n", "outcome", "at", "1 hour", R.Rules()).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        assert run.awaitTermination(90)
    last = {}
    for rows in batches:
        last |= {x["job"]: (x["attempts"], x["outages"], x["status"], x["ended_at"], x["skipped"]) for x in rows}
    assert last == want


def test_timers(spark, tmp_path):
    """When later events move the time on, jobs that wait are due; one that has ended isn't."""
    rows = [timed([("a", 1, R.FAILED), ("b", 1, R.FAILED), ("b", 2, R.DONE), ("c", 1, R.OUTAGE)]), timed([("d", 5, R.FAILED)], 5), timed([("d", 6, R.FAILED)], 9)]
    for part in rows:
        spark.createDataFrame(part, TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    due = []
    with R.with_store(spark):
        run = R.queued(stream, "job", "n", "outcome", "at", "1 minute").writeStream.foreachBatch(lambda b, _: due.extend(r["job"] for r in b.filter("due").collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        assert run.awaitTermination(90)
    assert sorted(due) == ["a"]


def test_a_run_goes_on(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(timed(rows), TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(TIMED).parquet(str(tmp_path / "in"))
        marks = R.queued(s, "job", "n", "outcome", "at", "1 hour")
        with R.with_store(spark):
            return sorted((r["job"], r["attempts"], r["status"]) for r in outbox.upserted(marks, ["job"], "changes", "update", str(tmp_path / "home")).collect())

    assert run([("a", 1, R.FAILED), ("b", 1, R.OUTAGE)]) == [("a", 1, "waiting"), ("b", 0, "waiting")]
    assert run([("a", 3, R.FAILED), ("a", 2, R.FAILED)]) == [("a", 3, "parked"), ("b", 0, "waiting")]
