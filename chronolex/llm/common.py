"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import chronolex.llm

# Functions of this package go to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(chronolex.llm)

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Symbols of the contracts.
SYMBOLS = "#*$%&|<>"
BLANK_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
HELD_OUT_FOLD = 2


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learnt from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT_FOLD, F.lit(False))


def window(text: Column, doc_id: Column, max_bytes: int) -> Column:
    """The text if it has max_bytes at most, else a quarter as many of its characters, from a place that the id's hash picks."""
    chars = max_bytes // 4
    start = F.pmod(F.xxhash64(doc_id, F.lit("window")), F.greatest(F.char_length(text) - chars + 1, F.lit(1))) + 1
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.substring(text, start.cast("int"), F.lit(chars)))


def without(text: Column, chars: str) -> Column:
    """The text without the characters; each replace is one linear pass in the JVM."""
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def words(text: Column) -> Column:
    """Array of the text's words; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RE), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as lambda variables are not inlined."""
    return F.transform(F.array(value), body)[0]


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the (already written) frame has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text column of a piece has about max_bytes at most (one row at least)."""
    for batch in batches:
        lens = batch.column(column).nbytes
        if lens <= max_bytes or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where the setting is absent, a local master gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    if (folder := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")) is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that what follows doesn't depend on what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
