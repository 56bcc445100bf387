"""Tables in releases: a manifest of files per release, numbers that only one writer can take, buckets that are rewritten alone.

Data files are written under a name of their own first and never changed. A release is a manifest: its number, schema, key columns
and the files of each bucket (a bucket is what the keys hash to). The manifest is put in place in one step that fails if another
writer took the number, so readers see one release or the next, and keep the one they opened. A change reads
and writes the buckets of its keys; the other buckets' files are taken over by name.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from typing import NamedTuple
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer published the number first."""


class Release(NamedTuple):
    number: int
    note: str
    schema: str
    keys: list[str]
    buckets: int
    #: Files below the root by bucket.
    files: dict[str, list[str]]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not be there yet, whole or not at all."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _fs(spark, temporary)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    url = urlparse(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    jvm = spark._jvm
    if url.scheme == "file":  # a rename replaces here, a hard link doesn't
        try:
            os.link(url.path, urlparse(jvm.org.apache.hadoop.fs.Path(path).toString()).path)
        except FileExistsError:
            raise Conflict(path) from None
        finally:
            fs.delete(p, False)
        return
    none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(p, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as e:
        fs.delete(p, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(path) from None
        raise


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The published releases, oldest first."""
    return [int(n[:-5]) for n in _names(spark, f"{root}/manifests") if n.endswith(".json")]


def release(spark: SparkSession, root: str, number: int | None = None) -> Release:
    """A release by its number, or the last one."""
    if number is None:
        number = max(numbers(spark, root), default=-1)
    if number < 0:
        raise FileNotFoundError(f"no release below {root}")
    return Release(**json.loads(spark.read.text(f"{root}/manifests/{number:09d}.json", wholetext=True).first()[0]))


def _publish(spark: SparkSession, root: str, r: Release) -> Release:
    _put(spark, f"{root}/manifests/{r.number:09d}.json", json.dumps(r._asdict()))
    return r


def _written(df: DataFrame, root: str, keys: list[str], buckets: int) -> dict[str, list[str]]:
    """Write the rows by bucket and tell the files; a bucket without rows has none."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = df.withColumn(BUCKET, bucket_of(keys, buckets))
    dealt = dealt.repartition(buckets, BUCKET) if buckets > 1 else dealt
    dealt.write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    out = {}
    for name in _names(spark, f"{root}/{folder}"):
        if name.startswith(f"{BUCKET}="):
            out[name.split("=")[1]] = [f"{folder}/{name}/{f}" for f in _names(spark, f"{root}/{folder}/{name}") if f.endswith(".parquet")]
    return out


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


def publish(df: DataFrame, root: str, keys: Iterable[str] = (), buckets: int = 1, note: str = "", after: int | None = None) -> Release:
    """The rows as the next release. With ``after`` it must follow that number (-1: be the first), else ``Conflict``."""
    spark = df.sparkSession
    keys = list(keys)
    files = _written(df, root, keys, buckets)
    last = max(numbers(spark, root), default=-1) if after is None else after
    return _publish(spark, root, Release(last + 1, note, df.schema.json(), keys, buckets, files))


def read(spark: SparkSession, root: str, number: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The rows of a release, pinned to its files: releases that come later don't change what is read. ``keys`` (rows of the key columns): only their buckets' files are read, and only their rows."""
    r = release(spark, root, number)
    schema = StructType.fromJson(json.loads(r.schema))
    wanted = None if keys is None else {str(b) for b in _touched(keys, r)}
    paths = [f"{root}/{f}" for b, fs in r.files.items() if wanted is None or b in wanted for f in fs]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows if keys is None else rows.join(keys.select(*r.keys).distinct(), r.keys, "left_semi")


def _touched(rows: DataFrame, r: Release) -> list[int]:
    """Buckets of the rows' keys, at most as many as there are."""
    return sorted(x[0] for x in rows.select(bucket_of(r.keys, r.buckets)).distinct().collect())


def replace_keys(changes: DataFrame, root: str, gone: DataFrame | None = None, note: str = "", after: int | None = None) -> Release:
    """The next release, in which the rows of the changes' keys are those of the changes, and those of the ``gone`` keys are none.

    A key may have several rows. Columns and their types must be those of the table, in any order. Only buckets with such a key are written anew.
    """
    spark = changes.sparkSession
    r = release(spark, root, after)
    schema = StructType.fromJson(json.loads(r.schema))
    if {f.name: f.dataType for f in changes.schema} != {f.name: f.dataType for f in schema}:
        raise ValueError(f"columns are {changes.schema.simpleString()}, the table has {schema.simpleString()}")
    changes = changes.select(*schema.names)
    keys = changes.select(*r.keys)
    keys = keys.unionByName(gone.select(*r.keys)) if gone is not None else keys
    touched = {str(b) for b in _touched(keys, r)}
    paths = [f"{root}/{f}" for b in sorted(touched) for f in r.files.get(b, ())]
    old = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    same = F.lit(True)
    lost = keys.distinct().select(*[F.col(k).alias(f"_{k}") for k in r.keys])
    for k in r.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    kept = old.join(lost, same, "left_anti")
    files = {b: f for b, f in r.files.items() if b not in touched} | _written(kept.unionByName(changes), root, r.keys, r.buckets)
    return _publish(spark, root, r._replace(number=r.number + 1, note=note, files=files))


def upsert(changes: DataFrame, root: str, order: str, note: str = "", after: int | None = None) -> Release:
    """The next release, in which each of the changes' keys has one row: the last by ``order`` of the old and the new ones, a new one of a tie."""
    spark = changes.sparkSession
    r = release(spark, root, after)
    both = changes.withColumn("_new", F.lit(1)).unionByName(read(spark, root, r.number, changes).withColumn("_new", F.lit(0)))
    last = Window.partitionBy(*r.keys).orderBy(F.desc(order), F.desc("_new"))
    rows = both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_new")
    return replace_keys(rows, root, note=note, after=r.number)


def roll_back(spark: SparkSession, root: str, number: int, note: str = "") -> Release:
    """The next release has what an earlier one has; nothing is written but its manifest."""
    last = max(numbers(spark, root))
    return _publish(spark, root, release(spark, root, number)._replace(number=last + 1, note=note or f"as {number}"))


def rewritten(before: Release, after: Release) -> list[str]:
    """Buckets whose files differ between two releases."""
    return sorted((b for b in {*before.files, *after.files} if before.files.get(b) != after.files.get(b)), key=int)
