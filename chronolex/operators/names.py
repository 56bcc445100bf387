"""Known names of several words in texts: an automaton over all titles, leftmost and longest matches that don't overlap.

Titles and texts are compared without white space. A name begins where a word does and ends where one does, or before a
particle. Titles are the stated set: they go to the tasks as one trie; a set too large for that is dealt into
shards by the first letters of the names, so that all names that can begin at one place are in one shard, and the shards'
matches are put in order by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.patterns import one_of

#: Particles that may stand right behind a name (fixed values).
PARTICLES = "은 는 이 가 을 를 의 에 도 만 과 와 로 으로 에서 에게 부터 까지 보다 처럼 및 상 중 등".split()
LETTER = re.compile(r"\w")
#: Names in one trie, some 100 bytes a letter at most; first letters that choose a shard.
SHARD_NAMES, FIRST = 50_000, 2
#: A number or a note in brackets before a title.
NUMBERED = "^\\s*(?:\\[[^\\[\\]]*\\]\\s*|(?:\\p{L}-)?[0-9][0-9.\\-]+\\s+)"
HIT = "start int, end int, name string, key string"


def key_of(title: Column) -> Column:
    return F.lower(F.regexp_replace(title, "\\s", ""))


def keys_of(titles: DataFrame, work: str, title: str, least: int = 3) -> DataFrame:
    """(key, works, work): what works are called, with and without a number before the title; work is null if several are called so."""
    bare = F.regexp_replace(title, NUMBERED, "")
    both = F.array_distinct(F.array(key_of(F.col(title)), key_of(bare)))
    d = titles.select(F.col(work).alias("_w"), F.explode(F.filter(both, lambda k: F.char_length(k) >= least)).alias("key"))
    d = d.groupBy("key").agg(F.count_distinct("_w").alias("works"), F.min("_w").alias("_w"))
    return d.select("key", "works", F.when(F.col("works") == 1, F.col("_w")).alias("work"))


class Automaton:
    """A trie of names, entered at the beginning of a word or behind a prefix."""

    def __init__(self, names: list[str], prefixes: list[str], particles: list[str]):
        self.names, self.prefixes = self._trie(names), self._trie(prefixes)
        self.behind = re.compile(one_of(particles, r"\W", "$")) if particles else re.compile(r"\W|$")

    @staticmethod
    def _trie(words: list[str]) -> dict:
        root: dict = {}
        for w in words:
            node = root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = True
        return root

    def _longest(self, root: dict, letters: str, at: list[int], k: int, text: str, whole: bool) -> Iterator[int]:
        """Where names that begin with letter k end, shortest first."""
        node = root
        for n in range(k, len(letters)):
            node = node.get(letters[n])
            if node is None:
                return
            if "" in node and (not whole or self.behind.match(text, at[n] + 1)):
                yield n + 1

    def matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, key), leftmost and longest; a prefix belongs to the name behind it, not to its key."""
        at = [k for k, c in enumerate(text) if not c.isspace()]
        letters = "".join(text[k].lower() if len(text[k].lower()) == 1 else text[k] for k in at)
        k = 0
        while k < len(letters):
            if at[k] and LETTER.match(text[at[k]]) and LETTER.match(text[at[k] - 1]):
                k += 1
                continue
            found = [(e, k) for e in self._longest(self.names, letters, at, k, text, True)]
            for p in self._longest(self.prefixes, letters, at, k, text, False):
                found += [(e, p) for e in self._longest(self.names, letters, at, p, text, True)]
            if found:
                end, begin = max(found, key=lambda x: (x[0], -x[1]))
                yield at[k], at[end - 1] + 1, letters[begin:end]
                k = end
            else:
                k += 1


def names_in(texts: DataFrame, doc: str, text: str, keys: DataFrame, prefixes: list[str] = (), particles: list[str] = PARTICLES, shard_names: int = SHARD_NAMES) -> DataFrame:
    """(doc, start, end, name, key): the known names of each text, in code points from 0; ``keys`` has the column key.

    A null text has no names. A prefix (as an owner's name) before a name is part of the match, but not of the key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = texts.sparkSession
    out = StructType([texts.schema[doc], *StructType.fromDDL(HIT).fields])
    schema = to_arrow_schema(out)
    bare = ["".join(p.split()).lower() for p in prefixes]
    known = keys.select("key").filter("key <> ''").distinct()
    shards = max(-(-known.count() // shard_names), 1)
    result = None
    for k in range(shards):
        mine = known.filter(F.pmod(F.xxhash64(F.substring("key", 1, FIRST)), F.lit(shards)) == k)
        sent = spark.sparkContext.broadcast([r["key"] for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(sent.value, bare, particles)
            for b in batches:
                found = [(d, s, e, t[s:e], key) for d, t in zip(b.column(doc).to_pylist(), b.column(text).to_pylist(), strict=True) if t for s, e, key in automaton.matches(t)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        more = texts.select(doc, text).mapInArrow(run, out)
        result = more if result is None else result.unionByName(more)
    return result if shards == 1 else leftmost(result, doc)


def leftmost(hits: DataFrame, doc: str) -> DataFrame:
    """Of overlapping matches of a document the leftmost, then the longest: one pass over each document's matches in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = object(), 0
        for b in batches:
            keep = []
            for d, s, e in zip(b.column(doc).to_pylist(), b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True):
                if d != last:
                    last, end = d, 0
                keep.append(s >= end)
                if s >= end:
                    end = e
            yield b.filter(pa.array(keep, pa.bool_()))

    return hits.repartition(doc).sortWithinPartitions(doc, "start", F.desc("end")).mapInArrow(run, hits.schema)


def marked(texts: DataFrame, doc: str, text: str, keys: DataFrame, **options) -> DataFrame:
    """The texts with known names of several words in 『』, unless they stand in brackets or quotes already; other columns stay.

    ``doc`` names a text. The names of a text are gathered, as many as it has.
    """
    hits = names_in(texts, doc, text, keys, **options).filter(F.col("name").rlike("\\s"))
    own = hits.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_hits"))
    free = lambda t, h: ~F.substring(t, h["start"], F.lit(1)).isin("「", "『", "“") | (h["start"] == 0)
    d = texts.join(own, doc, "left").withColumn("_hits", F.filter("_hits", lambda h: free(F.col(text), h)))
    n = F.size("_hits")
    begin = lambda k: F.get("_hits", k)["start"]
    parts = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: F.concat(
            F.when(k > 0, F.concat(F.lit("『"), F.substring(text, begin(k - 1) + 1, F.get("_hits", k - 1)["end"] - begin(k - 1)), F.lit("』"))).otherwise(""),
            F.substring(text, F.coalesce(F.get("_hits", k - 1)["end"], F.lit(0)) + 1, F.coalesce(begin(k), F.char_length(text)) - F.coalesce(F.get("_hits", k - 1)["end"], F.lit(0))),
        ),
    )
    return d.withColumn(text, F.when(n > 0, F.array_join(parts, "")).otherwise(F.col(text))).drop("_hits").select(*texts.columns)
