"""Removal of long repeated substrings, as a suffix array would find them, by bucket-pointer refinement.

Wanted are the strings of LENGTH bytes that start at two places or more. Suffixes fall into initial
buckets by a q-gram. A bucket is refined by the identifiers that later offsets have by then: what is
in one bucket by its first h bytes is told apart by the pair of its own identifier and that of the
bucket h bytes on, so each round doubles the length told apart and reuses what the rounds before it
have found. A bucket of one is done and takes no part in later rounds. The rounds:

1. Every LENGTH-byte string is filed under one q-gram it holds, the smallest by hash (the leftmost of
   equals). Equal strings choose the same one, so only these anchors, about one position in a hundred
   and fifty, are bucketed.
2. Anchors in buckets of two or more are refined by the q-gram after them and by that before them:
   every string holds one of the two pairs whole, and goes if a pair that it holds is alone.
3. The strings still open are bucketed in blocks of BLOCK neighbouring starts, by the bytes common to them
   (the block's identifier, made from shorter ones), with the bytes on both sides that they reach into.
4. A bucket's blocks are refined start by start by those bytes: a start that two of them share is repeated.

An identifier names a bucket by 128 bits made from the pair of identifiers it was refined by, in
place of its rank, which would take a global sort in each round; two strings that differ get one
identifier with a chance of 2 ** -128. Each round sends counts of identifiers, combined per task
before the shuffle, so a string held by a third of all documents is a few rows. Texts are read where they
lie. What rounds 1 and 2 have learnt comes back to them as sets of open identifiers, whole up to SET_ROWS
members, else as a filter of FILTER_BITS bits at most, whose errors only leave more strings open. Round 4
answers the blocks, one row each, and the documents get their runs: sent to all tasks for SENT_DOCS
documents at most, else joined to the texts, which move this once. All of it is a function of the
texts alone, so a task that runs again sends the same rows. Texts are looked at a slice at a time,
laid end to end; no string that reaches over a text's end counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import at_most, cut, slices

LENGTH, GRAM, BLOCK = 400, 96, 32
#: Members of a set that is sent to every task whole: 48 MB. Of larger ones a filter is sent, of ten bits a member up to 64 MB.
SET_ROWS = 3_000_000
FILTER_BITS, SEGMENT_BITS = 29, 22
#: Documents whose runs are sent to every task; those of more are joined.
SENT_DOCS = 300_000
FLUSH = 1_000_000

_RNG = np.random.default_rng(20)
VALUES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits for a position: the same in every slice, so that equal strings choose equal anchors.
PLACE = np.uint64(31)
#: Bytes of a slice, about; a longer text is a slice of its own.
SLICE = 1 << 20
KEYS = {"k": "long", "th": "long"}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(first: np.ndarray, later: np.ndarray, kind: np.ndarray | int = 0) -> np.ndarray:
    """Identifiers (2 x 64 bits) of the buckets told apart by two identifiers; kind tells apart uses of the same bytes."""
    return _mix(first * np.uint64(0xD6E8FEB86659FD93) + _mix(later + np.uint64(1)) + np.asarray(kind, np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """Powers of the bases and of their inverses modulo 2 ** 64, as far as any text so far needed."""

    def __init__(self):
        self.up = self.down = np.zeros((2, 0), np.uint64)

    def reach(self, n: int) -> None:
        if self.up.shape[1] < n:
            n = max(n, 1 << 16, 2 * self.up.shape[1])
            grown = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
            self.up = np.stack([grown(b) for b in BASES])
            self.down = np.stack([grown(pow(b, -1, 1 << 64)) for b in BASES])


class Slice:
    """Bucket identifiers of the substrings of some texts, laid end to end, and their anchors."""

    def __init__(self, texts: list[bytes], powers: Powers):
        self.data = b"\0".join(texts)  # a byte between texts keeps their spans apart
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = self.n = len(self.data)
        powers.reach(n + 1)
        self.powers = powers
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.sums: list = [None, None]

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that holds a position."""
        return np.searchsorted(self.begin, at, "right") - 1

    def _sums(self, half: int) -> np.ndarray:
        if self.sums[half] is None:
            self.sums[half] = np.zeros(self.n + 1, np.uint64)
            np.cumsum(VALUES[half][self.bytes] * self.powers.up[half, : self.n], out=self.sums[half][1:])
        return self.sums[half]

    def _gram(self, at: np.ndarray, half: int) -> np.ndarray:
        sums = self._sums(half)
        return (sums[at + GRAM] - sums[at]) * self.powers.down[half][at]

    def bucket(self, at: np.ndarray, length: int) -> np.ndarray:
        """Identifiers (2 x 64 bits) of the strings of one length: of q-grams at first, then of two shorter ones that meet or overlap."""
        if length == GRAM:
            return _mix(np.stack([self._gram(at, half) for half in (0, 1)]))
        shorter = GRAM
        while 2 * shorter < length:
            shorter *= 2
        return _pair(self.bucket(at, shorter), self.bucket(at + length - shorter, shorter), length)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, first start, last start) of each anchor: the starts filed under it are neighbours."""
        starts = _ranges(self.begin, self.begin + np.maximum(self.sizes - LENGTH + 1, 0))
        if not len(starts):
            return starts, starts, starts
        wide, end = LENGTH - GRAM + 1, self.n - GRAM + 1
        sums = self._sums(0)
        grams = _mix((sums[GRAM:] - sums[:end]) * self.powers.down[0][:end])
        # The top bits order the q-grams, the position below them breaks ties to the left.
        key = (grams >> PLACE) << PLACE | np.arange(end, dtype=np.uint64)
        reach = 1
        while reach * 2 <= wide:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < wide:
            key = np.minimum(key[: len(key) - (wide - reach)], key[wide - reach :])
        at = (key[starts] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return at[new], starts[new], starts[np.append(new[1:], len(at)) - 1]

    def before_and_after(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(which anchors, identifiers) of the pairs with the q-gram before and of those with the q-gram after, where a string holds the pair."""
        left = np.flatnonzero(first <= at - GRAM)
        right = np.flatnonzero(last >= at - (LENGTH - 2 * GRAM))
        return (left, self.bucket(at[left] - GRAM, 2 * GRAM)), (right, self.bucket(at[right], 2 * GRAM))

    def blocks(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first start, identifier, sides) of the blocks that hold the anchors' starts.

        The start j of a block reaches into the last BLOCK - 1 - j bytes before the common ones and the first j after them.
        Sides are all these bytes, zero where no start of this block reaches, and the first and last j.
        """
        low, high = (at - last) // BLOCK, (at - first) // BLOCK
        count = high - low + 1
        owner = np.repeat(np.arange(len(at)), count)
        b = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        side = BLOCK - 1
        common = at[owner] - b * BLOCK
        start = common - side
        from_, to = np.maximum(first[owner] - start, 0), np.minimum(last[owner] - start, side)
        sides = np.zeros((len(owner), 2 * BLOCK), np.uint8)
        for i in range(side):
            left, right = i >= from_, i < to
            sides[left, i] = self.bytes[start[left] + i]
            sides[right, side + i] = self.bytes[common[right] + LENGTH - side + i]
        sides[:, -2], sides[:, -1] = from_, to
        held = self.bucket(common, LENGTH - side)
        return start, _pair(held, held, 2 * b + 2), sides


def _among(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which identifiers are members (sorted); of a filter (one dimension), which may be."""
    found = np.zeros(values.shape[1], bool)
    if members.ndim == 1:
        found[:] = True
        for bit in _filter_bits(values, len(members) * 8 >> SEGMENT_BITS):
            found &= (members[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
        return found
    end = members.shape[1]
    if not end or not len(found):
        return found
    at = np.searchsorted(members[0], values[0])
    while True:
        near = np.minimum(at, end - 1)
        same = (at < end) & (members[0][near] == values[0])
        found |= same & (members[1][near] == values[1])
        if not (same & ~found).any():
            return found
        at = at + 1


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    count = stop - start
    return np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _sorted(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    members = np.stack([first, second]).view(np.uint64)
    return members[:, np.lexsort((members[1], members[0]))]


def _filter_bits(ids: np.ndarray, segments: int) -> list[np.ndarray]:
    """The bits of identifiers in a filter of so many segments, a power of two over one: all in one segment, which the first bits of h1 tell."""
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    segment = (ids[0] >> np.uint64(65 - segments.bit_length())) << np.uint64(SEGMENT_BITS)
    return [(segment | (x & low)).astype(np.int64) for x in (ids[0], ids[1], ids[1] >> np.uint64(32))]


def _filter(members: DataFrame) -> np.ndarray:
    """A Bloom filter of the members; each segment is made by one task."""
    bits = min(max(SEGMENT_BITS + 1, (10 * members.count()).bit_length()), FILTER_BITS)
    segments = 1 << bits - SEGMENT_BITS
    size = 1 << SEGMENT_BITS - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            ids = np.stack([b.column(c).to_numpy() for c in ("h1", "h2")]).view(np.uint64)
            for bit in _filter_bits(ids, segments):
                for k in np.unique(bit >> SEGMENT_BITS).tolist():
                    own = bit[bit >> SEGMENT_BITS == k] & (1 << SEGMENT_BITS) - 1
                    np.bitwise_or.at(made.setdefault(k, np.zeros(size, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array([v.tobytes() for v in made.values()], pa.binary())], ["segment", "bits"])

    dealt = members.repartition(F.shiftrightunsigned("h1", 64 - (bits - SEGMENT_BITS)))
    out = np.zeros(segments * size, np.uint8)
    for r in dealt.mapInArrow(run, "segment long, bits binary").toLocalIterator():
        out[r.segment * size : (r.segment + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


class Sets:
    """Sets of open identifiers, sent to all tasks."""

    def __init__(self, docs: DataFrame):
        self.docs, self.sent = docs, {}

    def learn(self, name: str, members: DataFrame) -> None:
        """members(h1, h2) is written already."""
        if at_most(members, SET_ROWS):
            found = members.toArrow()
            sent = _sorted(*(found[c].to_numpy() for c in ("h1", "h2")))
        else:
            sent = _filter(members)
        self.sent[name] = self.docs.sparkSession.sparkContext.broadcast(sent)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch], sent: dict) -> Iterator[tuple[pa.RecordBatch, Slice, dict]]:
    powers, known = Powers(), {k: v.value for k, v in sent.items()}
    for b in slices(batches, "text", SLICE):
        yield b, Slice(_texts(b), powers), known


def _counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of distinct columns, number of each)."""
    order = np.lexsort(ids[::-1])
    ids = ids[:, order]
    first = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)]))
    return order[first], np.diff(np.append(first, ids.shape[1]))


def _emit(sets: Sets, step) -> DataFrame:
    """Rows (h1, h2, n), and the sides of blocks, of what step(slice, sets) -> (identifiers, sides or none) makes, counted per task."""
    sent = dict(sets.sent)

    def counted(found: list) -> pa.RecordBatch:
        ids = np.concatenate([f[0] for f in found], axis=1)
        sides = [f[1] for f in found if f[1] is not None]
        keys = _named(ids, joined := np.concatenate(sides)) if sides else ids
        first, n = _counts(keys)
        columns = [*(pa.array(x[first].view(np.int64)) for x in ids), pa.array(n)]
        return pa.RecordBatch.from_arrays([*columns, *([_binary(joined[first])] if sides else [])], ["h1", "h2", "n", *(["sides"] if sides else [])])

    def run(batches):
        found, size = [], 0
        for _, texts, known in _slices(batches, sent):
            made = step(texts, known)
            if made[0].shape[1]:
                found.append(made)
                size += made[0].shape[1]
            if size >= FLUSH:
                yield counted(found)
                found, size = [], 0
        if found:
            yield counted(found)

    return sets.docs.mapInArrow(run, "h1 long, h2 long, n long" + (", sides binary" if step is _blocks else ""))


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _named(ids: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Identifiers of blocks with their sides."""
    for word in np.ascontiguousarray(sides).view(np.uint64).T:
        ids = _pair(ids, np.stack([word, ~word]))
    return ids


def _anchors(texts: Slice, known: dict) -> tuple[np.ndarray, None]:
    """Round 1: the q-grams of all anchors."""
    return texts.bucket(texts.anchors()[0], GRAM), None


def _neighbours(texts: Slice, known: dict) -> tuple[np.ndarray, None]:
    """Round 2: pairs of neighbouring q-grams at the anchors whose own bucket is open."""
    at, first, last = texts.anchors()
    open_ = _among(texts.bucket(at, GRAM), known["anchors"])
    at, first, last = at[open_], first[open_], last[open_]
    (_, left), (_, right) = texts.before_and_after(at, first, last)
    return np.concatenate([left, right], axis=1), None


def _open_anchors(texts: Slice, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors with the starts that round 2 has left open: those of strings whose pairs, before and after as far as they hold them, recur."""
    at, first, last = texts.anchors()
    for side, (which, ids) in enumerate(texts.before_and_after(at, first, last)):
        alone = which[~_among(ids, known["neighbours"])]
        if side == 0:
            first[alone] = np.maximum(first[alone], at[alone] - GRAM + 1)
        else:
            last[alone] = np.minimum(last[alone], at[alone] - (LENGTH - 2 * GRAM) - 1)
    some = first <= last
    return at[some], first[some], last[some]


def _blocks(texts: Slice, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Round 3: identifiers and sides of the open blocks."""
    return texts.blocks(*_open_anchors(texts, known))[1:]


def _repeated_starts(group: np.ndarray, sides: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Round 4: per block (group: its bucket's number, n: how often it is there) the starts that another one of its bucket shares, as bits."""
    side = BLOCK - 1
    from_, to = sides[:, -2].astype(np.int64), sides[:, -1].astype(np.int64)
    left, right = np.zeros((BLOCK, len(n)), np.uint64), np.zeros((BLOCK, len(n)), np.uint64)
    for j in range(side):
        left[side - 1 - j] = _mix(left[side - j] + sides[:, side - 1 - j].astype(np.uint64) + np.uint64(1))
        right[j + 1] = _mix(right[j] + sides[:, side + j].astype(np.uint64) + np.uint64(1))
    mask = np.zeros(len(n), np.int64)
    for j in range(BLOCK):
        rows = np.flatnonzero((from_ <= j) & (j <= to))
        if not len(rows):
            continue
        keys = np.stack([group[rows].astype(np.uint64), left[j, rows], right[j, rows]])
        rows = rows[order := np.lexsort(keys[::-1])]
        keys = keys[:, order]
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        total = np.repeat(np.add.reduceat(n[rows], first), np.diff(np.append(first, len(rows))))
        mask[rows[total > 1]] |= 1 << j
    return mask


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, mask) of the blocks, sorted by bucket, that have a repeated start; a bucket may reach over batches."""

    def answer(rows: list) -> pa.RecordBatch:
        ids, sides, n = np.concatenate([r[0] for r in rows], axis=1), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        new = np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)])
        group = np.cumsum(new) - 1
        total = np.bincount(group, n)[group]
        some = total > 1
        ids, sides, n, group = ids[:, some], sides[some], n[some], group[some]
        mask, names = _repeated_starts(group, sides, n), _named(ids, sides)
        some = np.flatnonzero(mask)
        first = some[_counts(names[:, some])[0]] if len(some) else some
        return pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64)) for x in names), pa.array(mask[first])], ["h1", "h2", "mask"])

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy() for c in ("h1", "h2")]).view(np.uint64)
        sides = np.frombuffer(b"".join(b.column("sides").to_pylist()), np.uint8).reshape(-1, 2 * BLOCK)
        n = b.column("n").to_numpy()
        cut_at = int(np.flatnonzero((ids != ids[:, -1:]).any(0)).max(initial=-1)) + 1  # the last bucket starts here
        if held and (cut_at or (held[-1][0][:, -1] != ids[:, -1]).any()):
            yield answer([*held, (ids[:, :cut_at], sides[:cut_at], n[:cut_at])])
            held = []
        elif cut_at:
            yield answer([(ids[:, :cut_at], sides[:cut_at], n[:cut_at])])
        held.append((ids[:, cut_at:], sides[cut_at:], n[cut_at:]))
    if held:
        yield answer(held)


def _places(sets: Sets) -> DataFrame:
    """(k, th, h1, h2, start): the open blocks of each document, with the place of their first start."""
    sent = dict(sets.sent)

    def run(batches):
        for b, texts, known in _slices(batches, sent):
            start, ids, sides = texts.blocks(*_open_anchors(texts, known))
            if len(start):
                owner = texts.owner(start + sides[:, -2])
                columns = [*(b.column(c).take(pa.array(owner)) for c in KEYS), *(pa.array(x.view(np.int64)) for x in _named(ids, sides)), pa.array(start - texts.begin[owner])]
                yield pa.RecordBatch.from_arrays(columns, [*KEYS, "h1", "h2", "start"])

    return sets.docs.mapInArrow(run, "k long, th long, h1 long, h2 long, start long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts and ends of the maximal runs of bytes that each document's repeated strings cover."""
    for b in batches:
        starts, ends = [], []
        for blocks in b.column("blocks"):
            own = blocks.values
            start, mask = (own.field(c).to_numpy() for c in ("start", "mask"))
            row, j = np.nonzero(mask[:, None] >> np.arange(BLOCK) & 1)
            found = np.unique(start[row] + j)
            gap = np.flatnonzero(found[1:] > found[:-1] + LENGTH)
            starts.append(found[np.concatenate([[0], gap + 1])])
            ends.append(found[np.append(gap, len(found) - 1)] + LENGTH)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("th"), pa.array(starts, kind), pa.array(ends, kind)], ["k", "th", "starts", "ends"])


def repeated(docs: DataFrame) -> DataFrame:
    """The runs (k, th, starts, ends) of the documents (doc_id, text, k, th) that have repeated strings of LENGTH bytes."""
    sets = Sets(docs)
    for name, step in (("anchors", _anchors), ("neighbours", _neighbours)):
        sets.learn(name, cut(_emit(sets, step).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2")))
    buckets = _emit(sets, _blocks).repartition("h1", "h2").sortWithinPartitions("h1", "h2")
    answers = cut(buckets.mapInArrow(_answers, "h1 long, h2 long, mask long"))
    found = _places(sets).join(answers, ["h1", "h2"]).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "mask")).alias("blocks"))
    return cut(found.mapInArrow(_runs, "k long, th long, starts array<long>, ends array<long>"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) per document.

    Texts are UTF-8 bytes; a null text is empty. Rows that share an id are texts of their own, and a
    repeated row repeats its strings. Extra columns are ignored; an empty table gives no rows.
    """
    return _applied(docs, True)


def _applied(docs: DataFrame, with_bytes: bool) -> DataFrame:
    keys = {"k": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "th": F.xxhash64("text")}
    keyed = docs.select("doc_id", "text").withColumns(keys)
    runs = repeated(keyed)
    if at_most(runs, SENT_DOCS):
        runs = F.broadcast(runs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_bytes else "kept_sha256"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_bytes else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            rows = []
            for data, starts, ends in zip(_texts(b), *(b.column(c).to_pylist() for c in ("starts", "ends")), strict=True):
                left, count = data, len(starts or ())
                if count:
                    view, at, kept = memoryview(data), 0, []
                    for start, end in zip(starts, ends, strict=True):
                        kept.append(view[at:start])
                        at = end
                    left = b"".join([*kept, view[at:]])
                rows.append((len(data), len(data) - len(left), count, left if with_bytes else hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    kind = dict(docs.dtypes)["doc_id"]
    met = keyed.join(runs, list(KEYS), "left").select("doc_id", "text", "starts", "ends")
    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {names[-1]} {'binary' if with_bytes else 'string'}")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty and loses nothing, as does one of under 400 bytes; a repeated row is a document of its own, so that both
    lose what they share. Rows without an id take part; extra columns are ignored; an empty table gives no rows.
    """
    return _applied(docs, False)
