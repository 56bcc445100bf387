"""The outbox as a stream: keyed snapshots from micro-batches, and consumers that park after strikes.

A run takes what is there (availableNow) and ends, as a scheduled consumer does. Progress and state
are in the checkpoint of the stream, snapshots in numbered folders beside it, all in the shared
folder; a micro-batch that is run again writes the same folder again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolex.sources.storage import shared_folder

STRIKES = 3


def read_events(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over the files of one table in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The complete snapshots in a folder, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f"{folder}/{f.getPath().getParent().getName()}" for f in found or [])


def upserted(stream: DataFrame, keys: list[str], order: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """The last row of every key (by ``order``), after all that the stream holds now.

    Each micro-batch is reduced to its own last rows and merged with the snapshot before it. ``folder`` is
    shared and belongs to this consumer; a later run with it goes on where the last one ended. Without it
    the run stands alone, in a folder of its own.
    """
    spark = stream.sparkSession
    home = folder or f"{shared_folder(spark)}/outbox-{uuid.uuid4().hex}"

    def merge(batch: DataFrame, number: int) -> None:
        path = f"{home}/snapshot-{number:09d}"
        own = batch.sparkSession
        before = [p for p in snapshots(own, home) if p < path]
        both = batch.unionByName(own.read.schema(batch.schema).parquet(before[-1])) if before else batch
        latest(both, keys, order).select(*batch.columns).write.mode("overwrite").parquet(path)

    run = stream.writeStream.foreachBatch(merge).outputMode(mode).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    written = snapshots(spark, home)
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)


def with_strikes(stream: DataFrame, key: str, order: str, failed: str, strikes: int = STRIKES) -> DataFrame:
    """(key, handled, failed, skipped, parked_at): each key's events in order; so many failures running park the key.

    A success clears the strikes; after parking, events are skipped, not tried. The state of a key is
    four numbers. A micro-batch of a key is sorted in memory, so bound it at the source
    (maxFilesPerTrigger) where keys are hot.
    """
    names = ["handled", "failed", "skipped", "strikes", "parked_at"]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        handled, bad, skipped, running, parked = state.get if state.exists else (0, 0, 0, 0, None)
        rows = pd.concat([f[[order, failed]] for f in frames]).sort_values(order, kind="stable")
        for at, fails in zip(rows[order].tolist(), rows[failed].tolist(), strict=True):
            if parked is not None:
                skipped += 1
                continue
            handled += 1
            bad, running = (bad + 1, running + 1) if fails else (bad, 0)
            if running >= strikes:
                parked = at
        state.update((handled, bad, skipped, running, parked))
        yield pd.DataFrame({key: [group[0]], "handled": [handled], "failed": [bad], "skipped": [skipped], "parked_at": pd.array([parked], dtype="Int64")})

    kind = dict(stream.dtypes)[key]
    state = ", ".join(f"{n} long" for n in names)
    out = f"{key} {kind}, handled long, failed long, skipped long, parked_at long"
    narrow = stream.select(key, order, failed)
    return narrow.groupBy(key).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)
