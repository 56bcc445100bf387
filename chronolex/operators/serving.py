"""Serving-side relational operators: preferred rows, facets, paging, prefix joins, majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.sources.storage import shared_folder


def preferred(df: DataFrame, keys: list[str], preference: Column) -> DataFrame:
    """One row per key: the one with the largest preference (a struct). An aggregate, so it combines before the shuffle."""
    best = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), preference)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def facets(df: DataFrame, filters: dict[str, Column], counted: Column) -> DataFrame:
    """(axis, value, n): each axis counted under all filters but its own, in one pass.

    Every row is exploded to its axes, so there is one scan and one map-side combined shuffle.
    """
    rows = []
    for axis in filters:
        ok = F.lit(True)
        for other, keep in filters.items():
            if other != axis:
                ok = ok & keep
        rows.append(F.struct(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("value"), ok.alias("ok")))
    d = df.withColumn("_counted", counted).select("_counted", F.inline(F.array(*rows))).filter("ok")
    return d.groupBy("axis", "value").agg(F.countDistinct("_counted").alias("n"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values with their counts; ties go to the smaller value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Rows of a page (from 1) with the total beside them; only a page's depth is sorted, not the table."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(size * (number - 1)).limit(size)
    return rows.crossJoin(F.broadcast(total))


def places(df: DataFrame, order: list, name: str) -> DataFrame:
    """Every row with its place (from 1) in the order, a total one: ranges are sorted apart and counted, and only the counts come together."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    shared_folder(df.sparkSession)
    d = d.checkpoint()
    part = F.shiftright("_id", 33)
    counts = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row per partition
    at = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return d.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, at).drop("_id", "_part", "_before")


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """Value at index round(share * (n - 1)) of the sorted values of each key."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_m"))  # equal values combine before any of a key come together
    up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = n.withColumn("_upto", F.sum("_m").over(up_to)).withColumn("_n", F.sum("_m").over(Window.partitionBy(*keys)))
    at = F.round(F.lit(share) * (F.col("_n") - 1)).cast("long")
    return d.filter((F.col("_upto") > at) & (F.col("_upto") - F.col("_m") <= at)).select(*keys, F.col(value).alias(name))


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, winner, count, total) over non-null values; the winner must occur twice at least and lead alone."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    g = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.max(F.struct("n", value)).alias("best"), F.max("n").alias("top"), F.collect_list("n").alias("all"))
    alone = F.size(F.filter("all", lambda x: x == F.col("top"))) == 1
    return g.filter(alone & (F.col("top") >= 2)).select(*keys, F.col(f"best.{value}").alias("winner"), F.col("top").alias("count"), "total")


def longest_prefix(paths: DataFrame, known: DataFrame, keys: list[str], path: str, separator: str = ".") -> DataFrame:
    """The most specific ancestor-or-self of each path that exists, by an equi-join on all its prefixes."""
    parts = F.split(path, f"\\{separator}")
    tries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), separator).alias("prefix")))
    d = paths.withColumn("_t", F.explode(tries)).select(*paths.columns, "_t.*")
    hit = d.join(known.select(*keys, F.col(path).alias("prefix")).distinct(), [*keys, "prefix"])
    found = hit.groupBy(*paths.columns).agg(F.max_by("prefix", "depth").alias("ancestor"))
    return paths.distinct().join(found, paths.columns, "left")


def gaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, missing): the numbers from 1 to each key's largest that don't occur, as array set difference."""
    g = df.groupBy(*keys).agg(F.collect_set(number).alias("have"), F.max(number).alias("top"))
    return g.select(*keys, F.array_except(F.sequence(F.lit(1), F.col("top").cast("int")), F.col("have").cast("array<int>")).alias("missing"))


def ranges(df: DataFrame, keys: list[str], number: str, name: str) -> DataFrame:
    """Distinct numbers of each key as text, runs joined: 48-50,60 (gaps and islands)."""
    d = df.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    runs = d.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias(name))
