"""Writing changes into keyed tables: upserts as one outer join each, set updates and clean-up rules.

A table here is a frame with one row per key. Parquet has no row-level update, so every function
returns the new table (or what changed), to be written as a new version of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows and those new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_when_null: tuple[str, ...] = (), guard: Column | None = None) -> DataFrame:
    """(keys, columns, action): new rows written over the old ones.

    A column in ``keep_when_null`` keeps its old value where the new one is null. ``guard`` (over the
    structs ``_o`` and ``_n``) tells which old rows may be overwritten; all without it. action is
    inserted, updated, same (nothing differs) or kept (no new row, or guarded).
    """
    rest = [c for c in old.columns if c not in keys]
    side = lambda d, name: d.select(*keys, F.struct(*rest).alias(name))
    both = side(old, "_o").join(side(new, "_n"), keys, "full_outer")
    free = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)
    value = lambda c: F.coalesce(f"_n.{c}", f"_o.{c}") if c in keep_when_null else F.col(f"_n.{c}")
    fresh, absent = F.col("_o").isNull(), F.col("_n").isNull()
    merged = [F.when(fresh, F.col(f"_n.{c}")).when(absent | ~free, F.col(f"_o.{c}")).otherwise(value(c)).alias(c) for c in rest]
    same = F.lit(True)
    for c in rest:
        same = same & value(c).eqNullSafe(F.col(f"_o.{c}"))
    action = F.when(fresh, "inserted").when(absent | ~free, "kept").when(same, "same").otherwise("updated")
    return both.select(*keys, *merged, action.alias("action"))


def merge_maps(old: Column, new: Column) -> Column:
    """The entries of both maps; the new one's win. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the new frame's keys are replaced by its own (delete and insert)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def mark_unseen(known: DataFrame, seen: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The known rows with a flag that is true where the key was not seen."""
    flag = seen.select(*keys, F.lit(True).alias("_seen")).distinct()
    return known.join(flag, keys, "left").withColumn(name, F.col("_seen").isNull()).drop("_seen")


def sync_tasks(open_tasks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): open what is new, refresh what is still wanted, resolve what no longer is."""
    o = open_tasks.select(*keys, F.lit(True).alias("_o")).distinct()
    w = wanted.select(*keys, F.lit(True).alias("_w")).distinct()
    status = F.when(F.col("_o").isNull(), "opened").when(F.col("_w").isNull(), "resolved").otherwise("refreshed")
    return o.join(w, keys, "full_outer").select(*keys, status.alias("status"))


def row_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ as multisets, by a sum of row hashes that combines before the shuffle."""
    h = lambda d, name: d.groupBy(*keys).agg(F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)")).alias(name), F.count("*").alias(f"{name}_n"))
    j = h(a, "_a").join(h(b, "_b"), keys, "full_outer")
    return j.filter(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_a_n").eqNullSafe(F.col("_b_n")))).select(*keys)


def retained(df: DataFrame, kind: str, at: str, now: Column, days: dict[str, int]) -> DataFrame:
    """Rows younger than their kind's number of days; other kinds stay for good."""
    limit = F.lit(None).cast("int")
    for k, n in days.items():
        limit = F.when(F.col(kind) == k, n).otherwise(limit)
    return df.filter(limit.isNull() | (F.datediff(now, F.col(at)) < limit))


def pruned(releases: DataFrame, line: str, status: str, at: str, now: Column, keep: int = 2, building_hours: int = 6) -> DataFrame:
    """Releases that may go: all but the last ``keep`` published ones of a line and what has been building for a short time."""
    w = Window.partitionBy(line, status).orderBy(F.desc(at))
    young = (F.col(status) == "building") & (F.unix_timestamp(now) - F.unix_timestamp(F.col(at).cast("timestamp")) < building_hours * 3600)
    return releases.withColumn("_r", F.rank().over(w)).filter(~(((F.col(status) == "published") & (F.col("_r") <= keep)) | young)).drop("_r")
