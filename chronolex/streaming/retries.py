"""A queue of jobs that are tried again: failures, outages of the service, parking, timers.

A failure is an attempt; so many outages running are one attempt, as the service and not the job is to blame for each. After so many
attempts a job is parked. What counts is the order of the events' numbers, not that of their arrival: a job's
state keeps the events that led to where it is (at most attempts times outages of them, later ones are only counted), so that an
event that comes late is put where it belongs. A job that waits has a timer, in the time of the events, that says when it is due.
(Timers by the clock would keep a run over what is there now from ending.)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that keeps maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
FAILED, OUTAGE, DONE = "failed", "outage", "done"


class Job(NamedTuple):
    attempts: int
    outages: int
    #: waiting, parked or done, and the number of the event that made it so.
    status: str
    ended_at: int | None


class Rules(NamedTuple):
    attempts: int = 3
    #: Outages running that are one attempt.
    outages: int = 3
    #: Milliseconds to the next try after one attempt; twice as long after each further one.
    wait_ms: int = 60_000

    def fold(self, events: Iterable[tuple[int, str]]) -> tuple[Job, list[int]]:
        """Where events in order lead, and the numbers of those that come after the end."""
        attempts = outages = 0
        status, ended_at, after = "waiting", None, []
        for number, outcome in events:
            if ended_at is not None:
                after.append(number)
                continue
            if outcome == DONE:
                status, ended_at = "done", number
                continue
            outages = outages + 1 if outcome == OUTAGE else 0
            if outcome == FAILED or outages == self.outages:
                attempts, outages = attempts + 1, 0
            if attempts == self.attempts:
                status, ended_at = "parked", number
        return Job(attempts, outages, status, ended_at), after


class Queue(StatefulProcessor):
    def __init__(self, key: str, rules: Rules):
        self.key, self.rules = key, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "number long", "outcome string, at long")
        self.after = handle.getValueState("after", "skipped long, changes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: tuple(v) for k, v in self.events.iterator()}
        new: dict[int, tuple[str, int]] = {}
        for frame in rows:
            new.update(zip(frame["number"].tolist(), zip(frame["outcome"].tolist(), frame["ms"].tolist(), strict=True), strict=True))
        known = held | new
        job, late = self.rules.fold((n, known[n][0]) for n in sorted(known))
        for number in late:
            if number in held:
                self.events.removeKey((number,))
        gone = set(late)
        for number, event in new.items():
            if number not in gone:
                self.events.updateValue((number,), event)
        skipped, changes = self.after.get() if self.after.exists() else (0, 0)
        skipped, changes = skipped + len(late), changes + 1
        self.after.update((skipped, changes))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.status == "waiting" and job.attempts:
            last = max(at for _, at in known.values())
            self.handle.registerTimer(last + self.rules.wait_ms * 2 ** (job.attempts - 1))
        yield self._row(key, job, skipped, changes, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, _ = self.rules.fold(sorted((k[0], v[0]) for k, v in self.events.iterator()))
        yield self._row(key, job, *self.after.get(), True)

    def _row(self, key, job: Job, skipped: int, changes: int, due: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "attempts": [job.attempts], "outages": [job.outages], "status": [job.status], "ended_at": pd.array([job.ended_at], dtype="Int64"), "skipped": [skipped], "changes": [changes], "due": [due]})

    def close(self) -> None:
        pass


def queued(stream: DataFrame, key: str, number: str, outcome: str, at: str, delay: str, rules: Rules = Rules()) -> DataFrame:
    """(key, attempts, outages, status, ended_at, skipped, changes, due): a row for each job whenever events or its timer change it; ``changes`` counts the former.

    ``outcome`` is failed, outage or done; other events and null keys are nothing. Numbers are distinct within a job; an event that
    comes again while it counts is the same one. An event may come later than one that is ``delay`` younger by their times
    ``at``; what comes later still is lost, as everywhere in streams. Needs the state store STORE (see ``with_store``).
    """
    time = F.col(at).cast("timestamp")
    rows = stream.filter(F.col(outcome).isin(FAILED, OUTAGE, DONE) & F.col(key).isNotNull() & time.isNotNull())
    rows = rows.select(key, F.col(number).cast("long").alias("number"), F.col(outcome).alias("outcome"), time.alias("at"), F.unix_millis(time).alias("ms")).withWatermark("at", delay)
    out = StructType([stream.schema[key], *StructType.fromDDL("attempts long, outages long, status string, ended_at long, skipped long, changes long, due boolean").fields])
    return rows.groupBy(key).transformWithStateInPandas(Queue(key, rules), out, "Update", "EventTime")


class with_store:  # noqa: N801
    """Streams that start inside use the state store that keeps maps and timers."""

    def __init__(self, spark) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE_KEY, None)
        self.spark.conf.set(STORE_KEY, STORE)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(STORE_KEY)
        else:
            self.spark.conf.set(STORE_KEY, self.before)
