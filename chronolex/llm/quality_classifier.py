"""Quality classifier: supervised subword embeddings.

A document is the average of learnt vectors: of its words, of their character n-grams, of its word
pairs, all hashed into one table. A softmax layer tells good from bad. Table and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled documents.

As the average is linear, a document's logits are the average of per-feature logits, so scoring needs
only ``table @ layer``, two numbers per bucket. Words of a batch are hashed once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import WORD_RE, held_out, slices, window

BUCKETS, DIM = 1 << 16, 16
N_GRAMS = (2, 3, 4, 5)
#: The sample: labelled documents whose ids hash lowest.
SAMPLE = 3000
#: Of a longer text a window of a quarter as many characters teaches, so that the sample has 192 MB at most.
TEXT_BYTES = 1 << 16
EPOCHS, RATE, SEED = 6, 2.0, 7
THRESHOLD = 0.7
EMPTY_SCORE = 0.0
FIND_WORDS = re.compile(WORD_RE).findall
PAIR, SAME = np.uint64(0x9E3779B97F4A7C15), 1


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, ends, hashes) of distinct words: the word's and its n-grams' buckets, where each word's end, 64-bit hashes.

    A word is taken between a begin and an end mark.
    """
    data = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(flat))
    owner = np.repeat(np.arange(len(data)), lengths)
    power = _powers(int(lengths.max()))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * power[np.arange(len(flat)) - np.repeat(starts, lengths)])])
    hashes = _mix(prefix[ends] - prefix[starts])
    found, of = [(hashes >> np.uint64(48)).astype(np.int32)], [np.arange(len(data))]
    code = np.zeros(len(flat), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n in N_GRAMS:
            ok = left[:m] >= n
            found.append((_mix(code[ok] + np.uint64(n << 56)) >> np.uint64(48)).astype(np.int32))
            of.append(owner[:m][ok])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], np.cumsum(np.bincount(of, minlength=len(data))), hashes


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Batch:
    """Texts as positions into their distinct words, with the features of these."""

    def __init__(self, texts: list[str | None]):
        index: dict[str, int] = {}
        per_text = [FIND_WORDS(t or "") for t in texts]
        self.counts = np.fromiter(map(len, per_text), np.int64, len(texts))
        self.words = np.fromiter((index.setdefault(w, len(index)) for ws in per_text for w in ws), np.int64, int(self.counts.sum()))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        if index:
            self.features, self.ends, hashes = word_features(list(index))
            first, second = self.words[:-1], self.words[1:]
            inside = self.owner[:-1] == self.owner[1:]
            # A word followed by itself is one feature, whatever the word; other pairs are hashed.
            pair = (_mix(hashes[first] * PAIR + hashes[second]) >> np.uint64(48)).astype(np.int32)
            self.pairs = np.where(first == second, np.int32(SAME), pair)[inside]
            self.pair_owner = self.owner[:-1][inside]

    def score(self, logits: np.ndarray, bias: float) -> np.ndarray:
        """P(good) of each text, from the per-bucket difference of logits."""
        n = len(self.counts)
        if not len(self.words):
            return np.full(n, EMPTY_SCORE)
        sizes = np.diff(self.ends, prepend=0)
        sums = np.add.reduceat(logits[self.features], self.ends - sizes)
        total = np.bincount(self.owner, sums[self.words], n) + np.bincount(self.pair_owner, logits[self.pairs], n)
        count = np.bincount(self.owner, sizes[self.words], n) + np.bincount(self.pair_owner, minlength=n)
        p = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))
        return np.where(self.counts > 0, p, EMPTY_SCORE)


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their shares of its features."""
    b = Batch([text])
    if not len(b.words):
        return np.zeros(0, np.int64), np.zeros(0)
    uses = np.bincount(b.words, minlength=len(b.ends))
    counts = np.bincount(b.features, np.repeat(uses, np.diff(b.ends, prepend=0)), BUCKETS) + np.bincount(b.pairs, minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / counts.sum()


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """(per-bucket difference of logits, bias) after SGD over the texts, in an order fixed by SEED."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    rows = [(*text_features(t), y) for t, y in zip(texts, labels, strict=True)]
    rows = [r for r in rows if len(r[0])]
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, share, y = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ table[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            to_table = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # A text's features share one step; scaling by the features' own shares alone would hardly move the table.
            table[ids] -= (rate * share / np.sqrt(share @ share))[:, None] * to_table
    return ((table @ layer)[:, 1] - (table @ layer)[:, 0]).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on labels of documents that are not held out; rows with a null id, quality or text teach nothing.

    A document with several labels counts once, with the larger; of rows that share an id the smallest text
    counts, and of a very long one a window at a place that its id's hash picks. Without any label every score is a half, as it is
    after an empty table.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    sample = known.groupBy("doc_id").agg(F.max("quality").alias("q")).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(SAMPLE)
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(window(F.col("text"), F.col("doc_id"), TEXT_BYTES)).alias("text"), F.max("q").alias("q")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["q"] for r in rows])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: str) -> DataFrame:
    """The kept columns (a schema string) with ``score``; maps over partitions without a shuffle.

    A text that is null or has no word scores 0. Only the text decides: nulls elsewhere, repeated rows
    and clashing extra columns don't matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c.split(" ")[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = sent.value
        for b in slices(batches, "text", 2 << 20):
            score = Batch(b.column("text").to_pylist()).score(logits, bias)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score, pa.float64())], [*names, "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{keep}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, held_out, score, predicted.

    A null or empty text scores 0, a very long one is scored whole. Rows without an id are scored and held
    out by none. Repeated rows score alike; extra columns are ignored; an empty table gives no rows.
    """
    out = scored(docs, fit(docs, labels), "doc_id long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
