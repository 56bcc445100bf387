"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text there is exactly one token that its encoding ends with: of the vocabulary
tokens that end there (found by an Aho-Corasick automaton), the one that may follow the last token of
the prefix before it. Whether two tokens may be neighbours is decided by replaying the merges at
their border, and remembered. Ids are read off the table backwards.

Texts are cut where no token can reach across (before a run of blanks, around characters that are in
no token), so a table is made once for each distinct chunk, and kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolex.llm.common import slices

BLANK = "▁"
NEVER = 1 << 60
#: Chunks kept per Python worker, and the longest that is kept.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 48
#: Pairs of tokens whose compatibility is remembered per Python worker.
CACHE_PAIRS = 1_000_000


def read_vocabulary(path: str) -> dict:
    """Pieces, merge ranks and kinds of a SentencePiece BPE model; about a megabyte, sent to the tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    scores = sorted({sp.get_score(i) for i in range(n) if normal[i]}, reverse=True)
    rank = {s: r for r, s in enumerate(scores)}
    return {
        "pieces": pieces,
        "ranks": [rank[sp.get_score(i)] if normal[i] else -1 for i in range(n)],
        "byte": {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)},
        "control": [i for i in range(n) if sp.is_control(i)],
        "unknown": sp.unk_id(),
        "bos": sp.bos_id(),
        "eos": sp.eos_id(),
    }


class PrefixTable:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        v = vocabulary
        self.pieces, self.ranks = v["pieces"], v["ranks"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.ranks[i] >= 0}
        self.byte, self.bos, self.eos = v["byte"], v["bos"], v["eos"]
        self.unknown = v["unknown"]
        self.lengths = [len(p) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[str, int]]] = {}
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self._splits(p) is not None:
                automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()
        self.automaton = automaton
        known = {c for p in self.ids for c in p}
        assert not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids), "a token reaches across a blank"
        lone = "\n" if "\n" not in known else ""
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}{lone}]+|{BLANK}+" + (f"|{lone}" if lone else "")).findall
        self.cache: dict[str, bytes] = {}
        decoded = {i: bytes([b]) for b, i in self.byte.items()} | dict.fromkeys(v["control"], b"") | {self.unknown: " ⁇ ".encode()}
        self.decoded = [decoded[i] if i in decoded else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]

    def _merged(self, text: str) -> list[tuple[str, list]]:
        """Plain BPE of a short string: (piece, [left, right] of its last merge)."""
        parts: list[tuple[str, list]] = [(c, []) for c in text]
        while True:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k][0] + parts[k + 1][0])
                if i is not None and self.ranks[i] < best:
                    best, at = self.ranks[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], [parts[at][0], parts[at + 1][0]])]

    def _splits(self, piece: str) -> list[str] | None:
        """The two parts that the piece is merged from ([] for a character); None if merges never make it."""
        parts = self._merged(piece)
        return parts[0][1] if len(parts) == 1 else None

    def _spine(self, i: int, right: bool) -> list[tuple[str, int]]:
        """The parts at the right (or left) border of token i, from a character up to i, with the rank of the merge that ends each."""
        if (found := self.spines.get((i, right))) is None:
            up, piece, ends = [], self.pieces[i], NEVER
            while True:
                up.append((piece, ends))
                parts = self._splits(piece)
                if not parts:
                    break
                ends, piece = self.ranks[self.ids[piece]], parts[1 if right else 0]
            found = self.spines[i, right] = up[::-1]
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' text gives these two tokens.

        Merges happen in rank order, so the border is replayed: the merge across it must never come
        before both merges that end the parts it lies between (of equal ranks the left comes first).
        """
        xs, ys = self._spine(a, True), self._spine(b, False)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            z = self.ids.get(x + y)
            across = NEVER if z is None else self.ranks[z]
            if across < x_ends and across <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def table(self, chunk: str) -> list[int]:
        """For each prefix of the chunk, from one character on, its unique last token; -1 for a character in no token."""
        last, pairs, done = [-1] * len(chunk), self.pairs, -1
        for end, (i, size) in self.automaton.iter(chunk):
            if end == done:
                continue
            before = end - size
            if before >= 0 and (prev := last[before]) >= 0:
                pair = prev << 32 | i
                if (ok := pairs.get(pair)) is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self.compatible(prev, i)
                if not ok:
                    continue
            last[end] = i
            done = end
        return last

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        last, k, back = self.table(chunk), len(chunk) - 1, []
        while k >= 0:
            i = last[k]
            if i >= 0:
                back.append(i)
                k -= self.lengths[i]
            else:
                back += [self.byte.get(b, self.unknown) for b in reversed(chunk[k].encode())] if self.byte else [self.unknown]
                k -= 1
        return _pack(back[::-1])

    def encode(self, text: str | None) -> bytes:
        """Ids of the text between begin and end, packed; null counts as empty."""
        ends = _pack([self.bos]), _pack([self.eos])
        if not text:
            return b"".join(ends)
        cache, out = self.cache, [ends[0]]
        chunks = self.chunks(BLANK + text.replace(" ", BLANK))
        for c in chunks:
            got = cache.get(c)
            if got is None:
                got = self.encode_chunk(c)
                if len(c) <= CACHE_CHARS:
                    if len(cache) >= CACHE_CHUNKS:
                        cache.clear()
                    cache[c] = got
            out.append(got)
        out.append(ends[1])
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids: pieces joined, the blank put before the text taken off, bytes read as UTF-8."""
        ids = array("I")
        ids.frombytes(packed)
        if sys.byteorder == "big":
            ids.byteswap()
        data = b"".join(map(self.decoded.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def encoded(docs: DataFrame, path: str, keep: str = "doc_id long", with_ids: bool = False) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256, decoded_sha256 (and the ids and the decoded text if asked for).

    Maps over partitions without a shuffle. Null and empty texts encode to begin and end only; every row
    is encoded by itself, so ties, repeated rows and clashing extra columns change nothing.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = [c.split(" ")[0] for c in keep.split(", ")]
    schema = f"{keep}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PrefixTable(vocabulary.value)
        for b in slices(batches, "text"):
            n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for t in b.column("text").to_pylist():
                packed = table.encode(t)
                text = table.decode(packed)
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    ids.append(packed)
                    decoded.append(text)
            columns = [*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            more = [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Rows of the query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs, path)
