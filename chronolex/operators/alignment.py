"""Quotes aligned with texts: those whose text is known, and those that may stand in any text.

With a known text the pairs come from a join by key and are aligned row by row in Arrow batches. In the
open search the quotes are the stated query set: their seeds go to the tasks in blocks, and each task meets the seeds of
its texts by hash, in whole columns, so quotes and texts are never paired but where they share a seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.functions import alignment as A

COVERAGE, MIN_CHARS = 0.9, 8
#: Quotes sent to the tasks at once, and characters of text whose seeds are looked up at once.
BLOCK, SLICE = 20_000, 1 << 20
SPAN = "start int, end int, edits int, piece string"


def aligned(pairs: DataFrame, quote: str, text: str, coverage: float = COVERAGE, min_chars: int = MIN_CHARS, one_line: bool = False, counted: str | None = None, tail: str | None = None) -> DataFrame:
    """The pairs with start, end (code points from 0), edits and the piece of the text; null where the quote isn't in it.

    A null or short quote and a null text align with nothing. White space doesn't count. Numbers must be equal
    and whole. ``counted`` (a pattern, as of negations) must match as often in the quote as in the piece with what the
    pattern ``tail`` matches behind it; with ``one_line`` a piece has no line end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([*pairs.schema.fields, *StructType.fromDDL(SPAN).fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, rest = counted and re.compile(counted), tail and re.compile(tail)
        for b in batches:
            found = []
            for q, t in zip(b.column(quote).to_pylist(), b.column(text).to_pylist(), strict=True):
                w, p = None, A.prepared(q, coverage, min_chars)
                if p and t:
                    bare, at = A.bare(t)
                    w = A.best(p, bare, at, t, A.diagonals(p, bare), one_line and "\n" not in q, marks, rest)
                found.append((w.start, w.end, w.edits, t[w.start : w.end]) if w else (None,) * 4)
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[-4:], strict=True))], schema=schema)

    return pairs.mapInArrow(run, out)


class Seeds:
    """Hashed seeds of a block of quotes, by length: sorted hashes with quote and offset beside them."""

    def __init__(self, quotes: list[A.Quote | None]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k, q in enumerate(quotes):
            for offset, seed in q.seeds if q else ():
                rows.setdefault(len(seed), []).append((int(grams(points(seed), len(seed))[0]), k, offset))
        self.tables = {n: tuple(np.array(c, t) for c, t in zip(zip(*sorted(r), strict=True), (np.uint64, np.int64, np.int64), strict=True)) for n, r in rows.items()}

    def met(self, text: np.ndarray) -> dict[int, set[int]]:
        """Diagonals in the text by quote."""
        out: dict[int, set[int]] = {}
        for n, (hashes, quote, offset) in self.tables.items():
            h = grams(text, n)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            for at in np.flatnonzero(lo < hi).tolist():
                for k in range(lo[at], hi[at]):
                    out.setdefault(int(quote[k]), set()).add(at - int(offset[k]))
        return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each place on."""
    out = np.zeros(max(len(text) - n + 1, 0), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + text[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


def found_quotes(texts: DataFrame, doc: str, text: str, quotes: DataFrame, quote_id: str, quote: str, coverage: float = COVERAGE, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(doc, quote_id, start, end, edits, piece): for every text the quotes that it has, its best window of each.

    Quotes travel in blocks of a bounded number, one pass over the texts each; nothing is shuffled. A seed that is met is
    only a place to look: distances decide. Long texts are looked through a slice at a time, slices sharing a quote's length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = texts.sparkSession
    asked = quotes.select(quote_id, quote).filter(F.col(quote).isNotNull())
    blocks = max(-(-asked.count() // block), 1)
    ids = texts.select(doc).schema.fields + asked.select(quote_id).schema.fields
    out = StructType([*ids, *StructType.fromDDL(SPAN).fields])
    schema = to_arrow_schema(out)
    result = None
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64(quote_id, quote), F.lit(blocks)) == k).toArrow()
        sent = spark.sparkContext.broadcast((rows.column(quote_id).to_pylist(), rows.column(quote).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, said = sent.value
            prepared = [A.prepared(q, coverage, min_chars) for q in said]
            seeds, longest = Seeds(prepared), max((len(q.text) + q.edits for q in prepared if q), default=0)
            for b in batches:
                found = []
                for d, t in zip(b.column(doc).to_pylist(), b.column(text).to_pylist(), strict=True):
                    bare, at = A.bare(t or "")
                    met: dict[int, set[int]] = {}
                    for start in range(0, len(bare), SLICE):
                        for q, places in seeds.met(points(bare[start : start + SLICE + longest])).items():
                            met.setdefault(q, set()).update(start + p for p in places)
                    for q in sorted(met):
                        p = prepared[q]
                        if w := A.best(p, bare, at, t, A.stretches(p, sorted(met[q]), len(bare)), False, None, None):
                            found.append((d, names[q], w.start, w.end, w.edits, t[w.start : w.end]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        more = texts.select(doc, text).mapInArrow(run, out)
        result = more if result is None else result.unionByName(more)
    return result
