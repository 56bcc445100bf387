"""A search as users meet it: who is asked about, which place is cited, ranked hits below the cited place.

Questions are a stated set; candidate hits come ranked from any search of this library. All joins are on works, owners or questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import citations as C
from chronolex.operators import names as N

#: So many places answer a citation at most; the first of them is shown on top.
LOOKED_UP = 3


def mentioned(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ask, owner, name): whom a question names if it names one owner alone, with the words it uses.

    aliases: name, owner. A name that several owners have tells nothing.
    """
    keyed = aliases.withColumn("key", N.key_of(F.col("name"))).groupBy("key").agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("_n"))
    hits = N.names_in(asked, "ask", "question", keyed.select("key")).join(keyed.filter("_n = 1"), "key")
    one = hits.groupBy("ask").agg(F.min("owner").alias("owner"), F.min_by("name", "start").alias("name"), F.count_distinct("owner").alias("_n"))
    return one.filter("_n = 1").drop("_n")


def understood(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ask, owner, said_owner, title, path): the owner that was chosen or else named, and the citation without its owner's name.

    asked: ask, question, chosen (an owner or null; it counts before what the question says).
    """
    said = mentioned(asked, aliases)
    d = asked.join(said.select("ask", F.col("owner").alias("said_owner"), "name"), "ask", "left").withColumn("_c", C.parse(F.col("question")))
    title = F.nullif(F.btrim(F.replace(F.col("_c.title"), F.coalesce("name", F.lit("")), F.lit(""))), F.lit(""))
    return d.select("ask", F.coalesce("chosen", "said_owner").alias("owner"), "said_owner", F.when(F.col("_c.path").isNotNull(), title).alias("title"), F.col("_c.path").alias("path"))


def looked_up(cited: DataFrame, works: DataFrame, places: DataFrame) -> DataFrame:
    """(ask, work, path, relaxed, found): the first three places that a citation may mean, the exact ones first, then by work.

    cited: ask, owner, title, path; works: work, title, owner; places: work, path. A title and an owner must both agree where both are
    said; a citation with neither finds nothing. Titles count without white space and middle dots.
    """
    w = works.withColumn("_key", C.bare(F.col("title"))).select("work", "_key", F.col("owner").alias("_owner"))
    d = cited.filter("path IS NOT NULL").withColumn("_key", C.bare(F.col("title")))
    by_title = d.filter("title IS NOT NULL").join(w, "_key").filter("owner IS NULL OR owner = _owner")
    by_owner = d.filter("title IS NULL").drop("_key").join(w.drop("_key"), F.expr("owner = _owner"))
    may = by_title.select("ask", "work", "path").unionByName(by_owner.select("ask", "work", "path")).distinct()
    best = Window.partitionBy("ask").orderBy("relaxed", "work")
    return C.lookup(may, places, "ask").withColumn("found", F.row_number().over(best)).filter(F.col("found") <= LOOKED_UP)


def searched(asked: DataFrame, hits: DataFrame, works: DataFrame, places: DataFrame, aliases: DataFrame, size: int = 10) -> DataFrame:
    """(ask, place, work, article, score, pinned, path): ``size`` results of each question.

    hits: ask, work, article, score. If an owner was chosen or named, only its works are shown, and the article of the cited place comes first,
    with its own score if the search found it too (else null), whatever the ranking says; without an owner the ranking stands.
    Ties go by work and article.
    """
    q = understood(asked, aliases)
    owners = works.select("work", F.col("owner").alias("_owner"))
    ranked = hits.join(q.select("ask", "owner"), "ask").join(owners, "work").filter("owner IS NULL OR owner = _owner").select("ask", "work", "article", "score")
    meant = q.withColumn("owner", F.coalesce("said_owner", "owner"))
    top = looked_up(meant, works, places).filter("found = 1").join(q.filter("owner IS NOT NULL").select("ask"), "ask", "left_semi")
    pin = top.select("ask", "work", F.substring_index("path", ".", 1).alias("article"), F.lit(None).cast(hits.schema["score"].dataType).alias("score"), F.lit(True).alias("pinned"), "path")
    every = ranked.select("*", F.lit(False).alias("pinned"), F.lit(None).cast("string").alias("path")).unionByName(pin)
    one = every.groupBy("ask", "work", "article").agg(F.max("score").alias("score"), F.max("pinned").alias("pinned"), F.max("path").alias("path"))
    order = Window.partitionBy("ask").orderBy(F.desc("pinned"), F.desc_nulls_last("score"), "work", "article")
    return one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select("ask", "place", "work", "article", "score", "pinned", "path")
