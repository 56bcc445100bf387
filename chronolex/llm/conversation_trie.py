"""Prefix trie of conversations in preorder intervals, by ranks and distributed prefix sums.

1. Turns are put in one global order; a running count gives each its place, whatever the length of its conversation.
2. Rebuilt conversations become rows of at most BLOCK turns, a digest of 16 bytes for each. Rows that are equal get
   equal names that sort like them, and BLOCK names make the next row, until a conversation is one row: sorting these
   rows sorts the conversations turn by turn, however long they are.
3. Equal conversations collapse to one sequence with a count; the sequences are ranked. Each yields the nodes on its
   path, named by a digest of the path; a node is the interval [lo, hi] of the ranks of the sequences through it,
   from one aggregation.
4. Nodes in order of (lo, depth) are in preorder, and a subtree ends where the sequence hi does. Running sums of leaves
   and savings over that order are taken at both ends of the subtree, and their difference is the subtree's sum.
5. Ids of conversations that end in a node are joined in sorted pieces by range; pieces, not ids, meet in the hash.

A very common first turn, or copies of one conversation, are combined before they are shuffled, or stay spread by range.
Digests are MD5 over role and text; two different paths are taken for one with a chance of about 2 ** -64 at 2 ** 32 paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import cut
from chronolex.llm.running import running_sums

#: Turns in one row, and names in the next; a row is 16 bytes a turn.
BLOCK = 256
#: Conversations share the head of the first of each FAMILY; the head has a hash modulo HEADS turns.
FAMILY, HEADS = 5, 9
PIECE_CHARS = 1 << 16

PATH = "node binary, parent binary, depth long, n_bytes long, r long, n long, conv_id long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, n_bytes, up_to_one): all turns in order of conversation, turn (null first), role and text, counted from 1."""
    t = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    t = t.withColumn("one", F.lit(1).cast("long"))
    turn = F.col("turn").asc_nulls_first()
    ranges = [F.col("conv_id"), turn, F.substring("role", 1, 32), F.substring("text", 1, 64)]
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest")
    return running_sums(t, ranges, [F.col("conv_id"), turn, F.col("role"), F.col("text")], ["one"], ["conv_id", digest, F.octet_length("text").cast("long").alias("n_bytes")])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and its turns (conv_id, length, d, digest, n_bytes), d from 1."""
    convs = turns.groupBy("conv_id").agg(F.min("up_to_one").alias("first"), F.count("*").alias("own"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    placed = turns.join(convs, "conv_id").withColumn("pos", F.col("up_to_one") - F.col("first") + 1)
    tail = placed.filter("pos > h").select("conv_id", "length", (F.col("head") + F.col("pos") - F.col("h")).alias("d"), "digest", "n_bytes")
    heads = placed.filter((F.col("conv_id") == F.col("base")) & (F.col("pos") < HEADS)).select("base", "pos", "digest", "n_bytes")
    head = convs.join(heads, "base").filter("pos <= head").select("conv_id", "length", F.col("pos").alias("d"), "digest", "n_bytes")
    return convs.select("conv_id", "length"), tail.unionByName(head)


def blocks_of(convs: DataFrame, turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, length, b, key, n_bytes): the turns in rows of at most ``size``; a conversation without a turn has one empty row."""
    row = F.sort_array(F.collect_list(F.struct("d", "digest", "n_bytes")))
    rows = turns.groupBy("conv_id", F.expr(f"(d - 1) div {size}").alias("b")).agg(F.max("length").alias("length"), row.alias("x"))
    rows = rows.select("conv_id", "length", "b", F.unhex(F.array_join("x.digest", "")).alias("key"), F.col("x.n_bytes").alias("n_bytes"))
    none = convs.filter("length = 0").select("conv_id", "length", F.lit(0).cast("long").alias("b"), F.unhex(F.lit("")).alias("key"), F.array().cast("array<long>").alias("n_bytes"))
    return cut(rows.unionByName(none))


def sequences(blocks: DataFrame, size: int) -> DataFrame:
    """(conv_id, length, key): one key for each conversation, equal for equal ones, in the order of their turns' digests."""
    keys = blocks.select("conv_id", "length", "b", "key")
    while (keys.agg(F.max("b")).first()[0] or 0) > 0:
        different = keys.select("key").distinct().withColumn("one", F.lit(1).cast("long"))
        names = running_sums(different, [F.col("key")], [F.col("key")], ["one"], [F.md5("key").alias("kh")])
        names = names.select("kh", F.lpad(F.hex("up_to_one"), 16, "0").alias("name"))
        named = keys.withColumn("kh", F.md5("key")).join(names, "kh")
        row = F.sort_array(F.collect_list(F.struct("b", "name")))
        keys = named.groupBy("conv_id", F.expr(f"b div {size}").alias("up")).agg(F.max("length").alias("length"), row.alias("x"))
        keys = cut(keys.select("conv_id", "length", F.col("up").alias("b"), F.unhex(F.array_join("x.name", "")).alias("key")))
    return keys.drop("b")


def paths(blocks: DataFrame, ranked: DataFrame, size: int) -> DataFrame:
    """(node, parent, depth, n_bytes, r, n, conv_id): the nodes on the path of each different sequence, the root included.

    A node's name is a digest of the row's digests so far and of sums of hashes of the rows before, each with its number.
    """
    rows = blocks.join(ranked.select("conv_id", "r", "n"), "conv_id")
    total = lambda w, seed: F.sum(F.xxhash64(F.lit(seed), "b", F.md5("key")).cast("decimal(38,0)")).over(w)
    of_conv = Window.partitionBy("r").orderBy("b")
    both = lambda w: F.concat_ws(",", total(w, 1), total(w, 2))
    before = both(of_conv.rowsBetween(Window.unboundedPreceding, -1))
    after = both(of_conv.rowsBetween(Window.unboundedPreceding, 0))
    short = rows.filter(F.col("length") < size).withColumns({"before": F.lit(""), "after": F.lit("")})
    long = rows.filter(F.col("length") >= size).withColumns({"before": before, "after": after})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = PATH.replace(" long", "").replace(" binary", "").split(", ")
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 5]
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                mine = (x["r"], x["n"], x["conv_id"])
                node = hashlib.md5(x["before"].encode()).digest()
                if x["b"] == 0:
                    out.append((node, None, 0, 0, *mine))
                state = hashlib.md5(f"{x['before']}|".encode())
                for k, n_bytes in enumerate(x["n_bytes"]):
                    state.update(x["key"][16 * k : 16 * k + 16])
                    parent, depth = node, x["b"] * size + k + 1
                    node = state.digest() if depth % size else hashlib.md5(x["after"].encode()).digest()
                    out.append((node, parent, depth, n_bytes, *mine))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    columns = ["r", "n", "conv_id", "b", "key", "n_bytes", "before", "after"]
    return short.select(columns).unionByName(long.select(columns)).mapInArrow(walk, PATH)


def joined_ids(members: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(kh, ends_sha256) of (kh, conv_id): SHA-256 of each kh's ids in decimal, ascending, joined by commas."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, chars = None, [], 0
        done: list[tuple] = []

        def close() -> None:
            if ids:
                done.append((key, ids[0], ",".join(map(str, ids))))

        for b in batches:
            for k, c in zip(b.column("kh").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if k != key or chars > piece_chars:
                    close()
                    key, ids, chars = k, [], 0
                ids.append(c)
                chars += 20
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["kh", "first", "piece"])
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["kh", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, piece in zip(b.column("kh").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + piece.encode())
                    continue
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["kh", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["kh", "ends_sha256"])

    pieces = members.repartitionByRange("kh", "conv_id").sortWithinPartitions("kh", "conv_id").mapInArrow(cut_up, "kh string, first long, piece string")
    return pieces.repartition("kh").sortWithinPartitions("kh", "first").mapInArrow(hashed, "kh string, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The nodes of the rebuilt conversations' trie.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the preorder
    interval: lo, hi (ranks of the sequences through the node).

    Turns without a conv_id belong to no conversation. Null turns come first, turns with equal numbers in
    order of role and text; repeated rows are turns of their own. A null role or text is empty. Texts of any
    length count as 16 bytes. Other columns are left behind, so their names can't clash. An empty table
    gives no rows, not even a root, as a node needs a member.
    """
    turns = ordered_turns(conversations)
    convs, rows = rebuilt(turns)
    blocks = blocks_of(convs, rows, block)
    keyed = sequences(blocks, block)
    distinct = keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("length"), F.count("*").alias("n"), F.lit(1).cast("long").alias("one"))
    ranked = running_sums(distinct, [F.col("key")], [F.col("key")], ["one"], ["conv_id", "length", "n", F.md5("key").alias("kh")]).withColumnRenamed("up_to_one", "r")
    ends = joined_ids(keyed.select(F.md5("key").alias("kh"), "conv_id"), piece_chars)
    ends = cut(ranked.select("r", "length", "kh").join(ends, "kh").drop("kh"))

    nodes = paths(blocks, ranked, block).groupBy("node").agg(
        F.first("parent").alias("parent"), F.max("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    nodes = cut(nodes)
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(kids, "node", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")})
    preorder = [F.col("lo"), F.col("depth")]
    nodes = running_sums(nodes, preorder, preorder, ["leaf", "saved"], ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "lo", "hi"])
    nodes = cut(nodes.join(ends.withColumnRenamed("r", "lo"), "lo", "left"))
    stops = nodes.filter("depth = length").select(F.col("lo").alias("hi"), F.col("up_to_leaf").alias("end_leaf"), F.col("up_to_saved").alias("end_saved"))
    return nodes.join(stops, "hi").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("end_leaf") - F.col("up_to_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("up_to_saved") + F.col("saved")).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        "lo",
        "hi",
    )


SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY pos) AS xs, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, c: list_reduce([xor(crc, c)] || list_transform(range(8), lambda i: CAST(i AS BIGINT)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM t GROUP BY conv_id),
seq AS (SELECT own.conv_id, list_concat(coalesce(b.xs, own.xs[1:0])[1:own.h], own.xs[own.h + 1:]) AS xs FROM own LEFT JOIN own b ON b.conv_id = own.base),
p AS (SELECT conv_id, d, xs[1:d] AS path, len(xs) = d AS whole FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM seq)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256 FROM p GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[d].text) END AS own_saved FROM n LEFT JOIN k USING (path)),
s AS (SELECT up, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens FROM (SELECT path[1:a] AS up, n_children, own_saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v)) GROUP BY up)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.up = v.path LEFT JOIN n u ON v.d > 0 AND u.path = v.path[1:v.d - 1]
"""


def digest(conversations: DataFrame, **options) -> DataFrame:
    """Rows of the query: the trie without the intervals; see ``trie`` for the awkward rows."""
    return trie(conversations, **options).drop("lo", "hi")
