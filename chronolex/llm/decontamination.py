"""Benchmark decontamination: a broadcast set of the benchmark's word windows, met with the windows of every text.

Items and documents are cut into words by one byte map. Every window of ten item words (a shorter item
is one window) is hashed; the sorted hashes go to the tasks with the items' words. A task hashes the
windows of whole columns by numpy, drops those whose hash is unknown by a bit table, looks up the
rest, and compares the words themselves, so no hit rests on a hash. Documents are never shuffled and
meet nothing but the set, whatever their windows have in common.

The benchmark is sent in blocks of BLOCK_BYTES of text, GROUP of them at a time; a larger one takes
several passes over rows that are written in between, so what is sent is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.llm import bytewords
from chronolex.llm.common import cut, slices

WINDOW = 10
WORDS = bytewords.table(bytewords.LETTERS + bytewords.DIGITS)
#: Benchmark text in one block: at most some 4 million one-letter words, 100 MB with hashes and places.
BLOCK_BYTES = 8 << 20
GROUP = 4
TABLE_BITS = 22
SPAN = "struct<first_word:long,end_word:long,first_byte:long,end_byte:long>"
HITS = f"n_words long, spans array<{SPAN}>, items array<string>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words and windows of pieces, equal for equal words wherever they stand."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, size: int) -> None:
        self.grow(size)

    def grow(self, size: int) -> None:
        self.up = _powers(self.BASE, size + 1)
        self.down = _powers(pow(self.BASE, -1, 1 << 64), size + 1)

    def words(self, piece: bytewords.Piece) -> np.ndarray:
        """A polynomial of each word's bytes modulo 2 ** 64, mixed: differences of one running sum."""
        n = len(piece.data)
        if n >= len(self.up):
            self.grow(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(np.frombuffer(piece.data, np.uint8) * self.up[:n], out=total[1:])
        h = (total[piece.ends] - total[piece.starts]) * self.down[piece.starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    @staticmethod
    def windows(words: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size if len(out) else 0):
            out = out * np.uint64(0x94D049BB133111EB) + words[k : k + len(out)]
        return out ^ (out >> np.uint64(31))


def window_set(ids: list, column: pa.Array, size: int = WINDOW) -> dict:
    """The items' windows as plain arrays, to be sent: for each window size the sorted hashes and the windows behind them."""
    data, at = bytewords.texts(column)
    pieces = list(bytewords.pieces(data, at, WORDS, 0, max(len(data), 1)))
    hasher = Hasher(max((len(p.data) for p in pieces), default=1))
    seen: dict[bytes, int] = {}
    owners: list[set[int]] = []
    entries: dict[int, list[tuple[int, int]]] = {}
    for p in pieces:
        h, starts, ends = hasher.words(p), p.starts.tolist(), p.ends.tolist()
        rows, first = np.unique(p.rows, return_index=True)
        for row, a, b in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(starts)][: len(rows)], strict=True):
            k = min(size, b - a)
            for i, x in enumerate(hasher.windows(h[a:b], k).tolist(), a):
                text = b" ".join(p.data[starts[i] : ends[i + k - 1]].split())
                if (w := seen.get(text)) is None:
                    w = seen[text] = len(owners)
                    owners.append(set())
                    entries.setdefault(k, []).append((x, w))
                owners[w].add(row)
    texts = list(seen)
    return {
        "ids": [None if i is None else str(i) for i in ids],
        "texts": b"\n".join(texts),
        "text_at": np.cumsum([0, *(len(t) + 1 for t in texts)]),
        "owners": np.fromiter((o for s in owners for o in sorted(s)), np.int64),
        "owner_at": np.cumsum([0, *map(len, owners)]),
        "sizes": {k: tuple(np.array(c, t) for c, t in zip(zip(*sorted(e), strict=True), (np.uint64, np.int64), strict=True)) for k, e in entries.items()},
    }


class Matcher:
    """Looks the windows of pieces up in one set."""

    def __init__(self, known: dict) -> None:
        self.known = known
        self.tables = {}
        for k, (hashes, _) in known["sizes"].items():
            self.tables[k] = np.zeros(1 << TABLE_BITS, bool)
            self.tables[k][hashes >> np.uint64(64 - TABLE_BITS)] = True

    def find(self, p: bytewords.Piece, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, size, window) of every window of the piece that is in the set."""
        texts, text_at = self.known["texts"], self.known["text_at"]
        for k, (hashes, windows) in self.known["sizes"].items():
            h = Hasher.windows(words, k)
            if not len(h):
                continue
            maybe = np.flatnonzero(self.tables[k][h >> np.uint64(64 - TABLE_BITS)] & (p.rows[: len(h)] == p.rows[k - 1 :]))
            lo = np.searchsorted(hashes, h[maybe])
            met = hashes[np.minimum(lo, len(hashes) - 1)] == h[maybe]
            for i, at in zip(maybe[met].tolist(), lo[met].tolist(), strict=True):
                if i + k <= p.shared:
                    continue
                own = b" ".join(p.data[p.starts[i] : p.ends[i + k - 1]].split())
                while at < len(hashes) and hashes[at] == h[i]:
                    w = int(windows[at])
                    if texts[text_at[w] : text_at[w + 1] - 1] == own:
                        yield i, k, w
                    at += 1

    def items(self, windows: set[int]) -> set[str]:
        """Ids of the items that hold one of the windows; an item without an id has none to give."""
        owners, at, ids = self.known["owners"], self.known["owner_at"], self.known["ids"]
        return {ids[o] for w in windows for o in owners[at[w] : at[w + 1]].tolist() if ids[o] is not None}


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], s[1]), last[2], max(last[3], s[3]))
        else:
            out.append(s)
    return out


def scanner(sent: list, schema: pa.Schema, size: int, piece_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of the tasks: adds what the sent sets find in each text to the rows' n_words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, hasher = [Matcher(b.value) for b in sent], Hasher(piece_bytes)
        for batch in slices(batches, "text"):
            data, at = bytewords.texts(batch.column("text"))
            counts = np.zeros(batch.num_rows, np.int64)
            spans: dict[int, list] = {}
            items: dict[int, set[str]] = {}
            for p in bytewords.pieces(data, at, WORDS, size - 1, piece_bytes):
                counts += np.bincount(p.rows[p.shared :], minlength=batch.num_rows)
                words = hasher.words(p)
                first_word = np.searchsorted(p.rows, np.arange(batch.num_rows))
                for m in matchers:
                    windows: dict[int, set[int]] = {}
                    for i, k, w in m.find(p, words):
                        row = int(p.rows[i])
                        number, byte = i - int(first_word[row]) + p.before, p.origin - int(at[row])
                        spans.setdefault(row, []).append((number, number + k, byte + int(p.starts[i]), byte + int(p.ends[i + k - 1])))
                        windows.setdefault(row, set()).add(w)
                    for row, found in windows.items():
                        items.setdefault(row, set()).update(m.items(found))
            old = {c: batch.column(c).to_pylist() for c in ("spans", "items")}
            names = [f.strip().split(":")[0] for f in SPAN[7:-1].split(",")]
            for row, found in spans.items():
                found += [tuple(s[n] for n in names) for s in old["spans"][row] or ()]
                old["spans"][row] = [dict(zip(names, s, strict=True)) for s in _merged(found)]
                old["items"][row] = sorted({*(old["items"][row] or ()), *items.get(row, ())})
            new = {"n_words": pa.array(counts), "spans": pa.array(old["spans"], schema.field("spans").type), "items": pa.array(old["items"], schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name) for f in schema], schema=schema)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, piece_bytes: int = bytewords.PIECE_BYTES) -> DataFrame:
    """The documents (doc_id and text) with n_words, spans and items: what of them stands in the benchmark.

    spans are the longest runs of hit words, by word number and by byte of the UTF-8 text, in order;
    items are the ids (as text, sorted) of the items with a window in the text. A null text has no
    words, nor has an item with a null text or without a word. A very long text is scanned in pieces
    that share size - 1 words. An item without an id marks words but isn't listed; items that share an
    id count as one. Repeated rows give equal rows. An empty benchmark marks nothing, an empty table
    gives no rows. Other columns are left behind, so their names can't clash.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(-(-total // block_bytes), 1)
    d = docs.select("doc_id", "text").withColumns({"n_words": F.lit(None).cast("long"), "spans": F.array().cast(f"array<{SPAN}>"), "items": F.array().cast("array<string>")})
    schema = to_arrow_schema(d.schema)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for first in range(0, blocks, GROUP):
        if first:
            d = cut(d)
        sent = []
        for k in range(first, min(first + GROUP, blocks)):
            block = items.filter(place == k).toArrow()
            sent.append(spark.sparkContext.broadcast(window_set(block.column("item_id").to_pylist(), block.column("text"), size)))
        d = d.mapInArrow(scanner(sent, schema, size, piece_bytes), d.schema)
    return d


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of the spans, which start and end between characters."""
    raw = F.encode(text, "UTF-8")
    start = lambda k: F.coalesce(F.get(spans, k - 1)["end_byte"], F.lit(0)).cast("int")
    end = lambda k: F.coalesce(F.get(spans, k)["first_byte"], F.octet_length(text)).cast("int")
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring(raw, start(k) + 1, end(k) - start(k)).cast("string"))
    return F.array_join(gaps, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, documents: bool = False, **options) -> DataFrame:
    """(doc_id, text) without the hit words, from the first to the last of each span; or without the documents that hold any."""
    hits = contamination(docs, benchmark, **options)
    if documents:
        return hits.filter(F.size("spans") == 0).select("doc_id", "text")
    return hits.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(without_spans(F.col("text"), F.col("spans"))).alias("text"))


SQL = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
b AS (SELECT id, w, least(len(w), 10) AS k FROM words WHERE kind = 'b' AND len(w) > 0),
bw AS (SELECT DISTINCT id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, ks WHERE kind = 'd' AND len(w) >= k)),
m AS (SELECT rid, i, dw.k, id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT rid, i, k FROM m)) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(id AS VARCHAR) AS item FROM m WHERE id IS NOT NULL) GROUP BY rid)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN h USING (rid) LEFT JOIN s USING (rid) WHERE kind = 'd'
"""


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of the query: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see ``contamination`` for the awkward rows."""
    hits = contamination(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
