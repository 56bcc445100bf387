import hashlib
import random
import re

import pytest

from chronolex.llm import bytewords
from chronolex.llm import decontamination as D

from .helpers import SF, awkward, clashing, documents, duck, rows

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, b in items:
            v = words(b)
            k = min(len(v), 10)
            windows = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def planted(seed, n):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "ça", "42", "x", "naïve", "ÉTÉ", "9a"]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", "\n", ", ", "_", "\t"]) for _ in range(k))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 30]) if i else 2)) for i in range(10, 18)] + [(99, ""), (98, None), (97, " .,- ")]
    docs = []
    for d in range(n):
        b = r.choice(items)[1] or ""
        docs.append((d, r.choice([text(20), text(15) + b.upper().replace(" ", " -- ") + text(15), b, text(3)])))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    docs, items = planted(seed, 40)
    items = [x for x in items if len(words(x[1])) != 1]
    frames = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.digest(*frames), *COLUMNS) == brute(docs, items)
    # The benchmark in several blocks and passes, long texts in pieces that share words.
    assert rows(D.digest(*frames, block_bytes=100, piece_bytes=64), *COLUMNS) == brute(docs, items)


def test_one_word_item(spark):
    docs, items = [(1, "yes. Yes! no"), (2, "eyes")], [(7, "YES")]
    assert rows(D.digest(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")), *COLUMNS) == brute(docs, items)


def test_spans_and_documents_removed(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = documents(spark, [(1, f"Été: {passage}! End."), (2, "clean"), (3, passage), (4, None)])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert dict(rows(D.decontaminate(docs, items), "doc_id", "text")) == {1: "Été: ! End.", 2: "clean", 3: "", 4: None}
    assert rows(D.decontaminate(docs, items, documents=True), "doc_id") == [(2,), (4,)]
    span = D.contamination(docs, items).filter("doc_id = 1").first()["spans"]
    assert [s.asDict() for s in span] == [{"first_word": 1, "end_word": 11, "first_byte": 7, "end_byte": 7 + len(passage)}]


def test_colliding_hashes_are_no_hits(spark, monkeypatch):
    """With one hash for all windows only the words decide."""
    import numpy as np

    monkeypatch.setattr(D.Hasher, "windows", staticmethod(lambda words, size: np.zeros(max(len(words) - size + 1, 0), np.uint64)))
    docs, items = planted(5, 15)
    items = [x for x in items if len(words(x[1])) != 1]
    assert rows(D.digest(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")), *COLUMNS) == brute(docs, items)


def test_agrees_with_its_sql(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")}
    names, want = duck(D.SQL, **{k: v.toPandas() for k, v in tables.items()})
    assert rows(D.digest(tables["documents"], tables["benchmark"]), *names) == sorted(want)


def test_awkward_rows(spark):
    items = [(1, "word after word and then, one more word after word"), (1, "same row"), (None, "no id but text"), (None, None), (2, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(awkward(spark, [(5, "plain words")])).withColumnRenamed("copies", "spans")
    got = {r[0]: r[1:] for r in rows(D.digest(docs, bench), *COLUMNS)}
    assert len(rows(D.digest(docs, bench))) == docs.count()
    assert got[900][:3] == got[901][:3] == got[904][:3] == (0, 0, 0) and got[902][:3] == (210_000, 209_996, 1) and got[903][:3] == (2, 2, 1)
    assert got[None][-1] or got[None][0] == 0
    # An item without an id marks words but isn't counted.
    assert (None, 4, 4, 0) in [r[:4] for r in rows(D.digest(docs, bench), *COLUMNS)]
    assert D.digest(docs.limit(0), bench).count() == 0
    assert not any(r[-1] for r in rows(D.digest(docs, bench.limit(0)), *COLUMNS))


def test_pieces_hold_the_same_words():
    import pyarrow as pa

    texts = ["a b c" * 50, None, "", "éa", "b", "x" * 100 + " y z " + "w" * 200, "q"]
    for size in (1, 7, 64, 1 << 20):
        for overlap in (0, 1, 3):
            found = {}
            for p in bytewords.pieces(*bytewords.texts(pa.array(texts)), D.WORDS, overlap, size):
                for k, (a, b, row) in enumerate(zip(p.starts, p.ends, p.rows, strict=True)):
                    if k >= p.shared:
                        found.setdefault(int(row), []).append(p.data[a:b].decode())
            assert found == {i: words(t) for i, t in enumerate(texts) if words(t)}
