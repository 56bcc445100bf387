"""Language identification by string kernels.

The kernel of two texts counts the byte n-grams of 1 to 4 bytes (a blended spectrum) that both hold,
each once, over the geometric mean of their own numbers. A ridge regression per language (one versus
the rest) is fitted on Nystroem features, that is on kernel values against landmark texts. Scoring a
batch is one product of its presence matrix with the landmarks' presence matrix weighted by the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import held_out, slices, window

#: n-grams fall into so many bins (a power of two); collisions are few among the n-grams of a language.
BINS = 1 << 14
MAX_N = 4
#: The fit takes so many texts of each language, those whose ids hash lowest, and fewer where there are so many languages
#: that they would be over TEXTS together (down to one each; the TEXTS most frequent languages are learnt, as the model has a
#: column of weights for each). Of a text of over TEXT_BYTES a window teaches, as long in characters as surely fits: 256 MB at most.
PER_LANGUAGE, TEXTS, TEXT_BYTES = 160, 4000, 1 << 16
LANDMARKS, MARKS = 48, 1200  # of each language, and of all together
RIDGE = 1e-3
SHARPNESS = 6.0
UNDETERMINED = "und"
BLANKS = re.compile(r"\s+")


def presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1 per text: which bins its n-grams fall into. Case and the kind of blanks don't count."""
    data = [(" " + BLANKS.sub(" ", t.lower()) + " ").encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    base = np.repeat(np.arange(len(data), dtype=np.int64) * BINS, lengths)
    left = (np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))).astype(np.int32)  # bytes up to the text's end
    out = np.zeros(len(data) * BINS, np.uint8)
    code = np.zeros(len(flat), np.uint32)
    for n in range(1, MAX_N + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(n)
        mixed = code * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        at = base[:m] + (mixed & np.uint32(BINS - 1))
        out[at[left[:m] >= n]] = 1
    return out.reshape(len(data), BINS)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    right = b.T.astype(np.float32)
    common = np.concatenate([a[i : i + 256].astype(np.float32) @ right for i in range(0, len(a), 256)])
    sums = [np.maximum(x.sum(1, dtype=np.int64), 1).astype(np.float32) for x in (a, b)]
    return common / np.sqrt(np.outer(*sums))


def has_letter(text: str) -> bool:
    r"""Whether a character is a letter (\p{L}: no numeral, no mark)."""
    return any(map(str.isalpha, text))


class Model:
    """labels, and the weights that turn presence rows into one regression value per label."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.labels = sorted(set(langs))
        self.weights = self.bias = np.zeros(0)
        if not texts:
            return
        x, y = presence(texts), np.array([self.labels.index(v) for v in langs])
        each = max(1, min(LANDMARKS, MARKS // len(self.labels)))
        marks = x[np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(self.labels))])]
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])  # K_mm ** -1/2
        z = kernel(x, marks) @ root
        targets = np.where(y[:, None] == np.arange(len(self.labels)), 1.0, -1.0)
        share = np.bincount(y, minlength=len(self.labels))[y].astype(np.float64)
        w = 1 / share[:, None]  # languages weigh the same however many texts they have
        self.bias = (targets * w).sum(0) / w.sum()
        beta = np.linalg.solve(z.T @ (w * z) + RIDGE * np.eye(z.shape[1]), z.T @ (w * (targets - self.bias)))
        own = np.sqrt(np.maximum(marks.sum(1, dtype=np.int64), 1))
        self.weights = ((marks.T.astype(np.float64) / own) @ (root @ beta)).astype(np.float32)


def scores(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best label's index and its probability for each text."""
    x = presence(texts).astype(np.float32)
    f = (x @ weights) / np.sqrt(np.maximum(x.sum(1), 1))[:, None] + bias
    e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
    return f.argmax(1), e.max(1) / e.sum(1)


def fit(docs: DataFrame) -> Model:
    """Fit on the bounded sample: the texts whose ids hash lowest, by a threshold from each language's count.

    Only the sample's texts reach the driver; of rows that share an id and a language the smallest text
    counts, and of a very long one a window at a place that its id's hash picks. Rows without id, language or letter teach nothing.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    place = F.xxhash64("doc_id", F.lit("sample")).cast("double") / float(1 << 64) + 0.5  # 0 to 1
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TEXTS).collect()
    each = max(1, min(PER_LANGUAGE, TEXTS // max(len(counts), 1)))
    # About twice the texts that are needed pass; the exact number is cut below.
    shares = docs.sparkSession.createDataFrame([(r["lang"], (2.0 * each + 20.0) / r["count"]) for r in counts], "lang string, share double")
    rows = known.join(F.broadcast(shares), "lang").filter(place < F.col("share")).groupBy("lang", "doc_id", place.alias("o")).agg(F.min(window(F.col("text"), F.col("doc_id"), TEXT_BYTES)).alias("text")).collect()
    texts, langs, seen = [], [], {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["o"], r["doc_id"])):
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= each:
            texts.append(r["text"])
            langs.append(r["lang"])
    return Model(texts, langs)


def identify(docs: DataFrame, model: Model, keep: str) -> DataFrame:
    """The kept columns (a schema string) with lang_pred and score; maps over partitions without a shuffle.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing could be
    learnt. Only the text decides: nulls elsewhere, repeated rows and clashing extra columns don't matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.bias))
    names = [c.split(" ")[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights, bias = sent.value
        for b in slices(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            able = [k for k, t in enumerate(texts) if labels and t and has_letter(t)]
            for start in range(0, len(able), 256):
                part = able[start : start + 256]
                for k, best, p in zip(part, *scores([texts[k] for k in part], weights, bias), strict=True):
                    lang[k], score[k] = labels[best], float(p)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{keep}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query: doc_id, held_out, lang_pred, score; nulls, empty and long texts, ties, repeated rows and empty tables as in ``identify``."""
    out = identify(docs, fit(docs), "doc_id long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
