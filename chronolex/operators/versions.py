"""Version chains: half-open validity intervals, states and as-of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(df: DataFrame, key: str, start: str, tie: list[str], today: Column) -> DataFrame:
    """Add ``valid_from``, ``valid_to`` and ``state`` to one row per version.

    Versions of a key are ordered by start (nulls last) and the tie columns. An interval ends where
    the next dated version starts, so the earlier of two same-day versions is empty. One shuffle on
    the key; groups are the versions of one document.
    """
    w = Window.partitionBy(key).orderBy(F.col(start).asc_nulls_last(), *tie)
    to = F.when(F.col(start).isNull(), None).otherwise(F.lead(start).over(w))
    state = (
        F.when(F.col("valid_from").isNull(), "UNDATED")
        .when(F.col("valid_from") > today, "FUTURE")
        .when(F.col("valid_to").isNull() | (F.col("valid_to") > today), "CURRENT")
        .otherwise("HISTORICAL")
    )
    return df.withColumn("valid_from", F.col(start)).withColumn("valid_to", to).withColumn("state", state)


def valid_at(df: DataFrame, day: Column) -> DataFrame:
    """Rows whose half-open interval holds the day."""
    return df.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))


def latest_before(df: DataFrame, key: str, tie: str, day: Column) -> DataFrame:
    """The last version of each key that started by the day, without an upper bound; ties go to the larger tie column."""
    best = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct("valid_from", tie))
    return df.filter(F.col("valid_from") <= day).groupBy(key).agg(best.alias("v")).select(key, "v.*")


def dated_targets(sources: DataFrame, chains: DataFrame, key: str, day: str, version: str, start: str = "valid_from", tie: str | None = None) -> DataFrame:
    """For every source row (key, day) the target version of the key valid then, with a tag how it was found.

    ``as_of``: the version in force on the day; else ``current`` (the chain's CURRENT one); else
    ``historical`` (the latest start); ``missing`` if the key has no dated version. Sources and versions
    are merged into one ordered stream per key, so nothing is joined by range.
    """
    tie = tie or version
    v = chains.filter(F.col(start).isNotNull())
    points = v.select(key, F.col(start).alias("_d"), F.lit(0).alias("_k"), F.col(tie).alias("_t"), F.col(version).alias("_v"))
    asks = sources.withColumn("_d", F.col(day)).withColumn("_k", F.lit(1))
    both = points.unionByName(asks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_d", "_k", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).filter("_k = 1").drop("_d", "_k", "_t", "_v")
    rest = v.groupBy(key).agg(
        F.max_by(F.when(F.col("state") == "CURRENT", F.col(version)), F.when(F.col("state") == "CURRENT", F.struct(start, tie))).alias("_cur"),
        F.max_by(version, F.struct(start, tie)).alias("_last"),
    )
    tag = F.when(F.col("_hit").isNotNull(), "as_of").when(F.col("_cur").isNotNull(), "current").when(F.col("_last").isNotNull(), "historical").otherwise("missing")
    return found.join(rest, key, "left").withColumn("target", F.coalesce("_hit", "_cur", "_last")).withColumn("match", tag).drop("_hit", "_cur", "_last")


def number_in_group(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def suffix_duplicates(df: DataFrame, keys: list[str], path: str, order: list) -> DataFrame:
    """The n-th row with the same path in its group gets ``~n`` behind its path."""
    d = number_in_group(df, [*keys, path], order, "_n")
    return d.withColumn(path, F.when(F.col("_n") == 1, F.col(path)).otherwise(F.concat(path, F.lit("~"), F.col("_n").cast("string")))).drop("_n")


def version_ids(df: DataFrame, key: str, day: str, order: list) -> DataFrame:
    """``key@date`` for the first version of a day, ``key@date.n`` for the n-th; ``key@undated-order`` without a date."""
    d = number_in_group(df, [key, day], order, "_n")
    dated = F.concat(F.col(key).cast("string"), F.lit("@"), F.col(day).cast("string"), F.when(F.col("_n") > 1, F.concat(F.lit("."), F.col("_n").cast("string"))).otherwise(""))
    undated = F.concat(F.col(key).cast("string"), F.lit("@undated-"), F.col(order[-1]).cast("string"))
    return d.withColumn("version_id", F.when(F.col(day).isNull(), undated).otherwise(dated)).drop("_n")
