import hashlib
from collections import Counter

import corpus_pipeline as P
import pandas as pd

from chronolex.llm import language_id, line_dedup, mixing

from . import test_near_copies, test_pieces
from .helpers import SF, awkward, clashing, documents, duck


def through(spark, docs):
    """Stage names with what each returned, written out as it came."""
    out, d = {}, docs
    for name, stage in P.STAGES:
        d = stage(spark, d, SF)
        out[name] = [r.asDict() for r in d.collect()]
        if name != "encoding":
            d = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in out[name]], P.SCHEMA)
    return out


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = documents(spark, [(10_200, "The thing that and the house is of the men", None, "src0", 1), *((10_000 + i, f"{i} %% 12") for i in range(5))] + [(10_100, None), (10_101, "")])
    docs = docs.unionByName(more)
    got = through(spark, docs)
    told = {r.doc_id: r.lang_pred for r in language_id.digest(docs).collect()}
    want = [r.asDict() | {"lang": r.lang or told[r.doc_id]} for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    by = lambda rows: sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    assert by(got["language"]) == by(want) and any(r["doc_id"] == 10_200 and r["lang"] == "en" for r in got["language"])

    names, rows = duck(line_dedup.SQL, documents=pd.DataFrame(got["language"]))
    lines = {r[names.index("doc_id")]: r[names.index("kept_sha256")] for r in rows}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in got["lines"]} == lines
    assert all(r["n_chars"] == len(r["text"]) for r in got["lines"])

    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    components = dict(test_near_copies.brute([(r["doc_id"], lower(r["text"])) for r in got["lines"]]))
    assert by(got["near_duplicates"]) == by(r for r in got["lines"] if components[r["doc_id"]] == r["doc_id"])

    names, rows = duck(mixing.SQL, documents=pd.DataFrame(got["near_duplicates"]))
    times = {r[names.index("doc_id")]: (r[names.index("taken")], r[names.index("size")]) for r in rows}
    copies = Counter(r["doc_id"] for r in got["mixing"])
    assert all(copies[d] == taken // max(size, 1) for d, (taken, size) in times.items() if size)

    encoded = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got["encoding"])
    assert encoded == Counter((r["doc_id"], len(i) // 4, hashlib.sha256(i).hexdigest()) for r in got["mixing"] for i in [test_pieces.want(r["text"])[0]])
    assert len(got["mixing"]) > 0 < len(got["lines"]) - len(got["near_duplicates"])


def test_awkward_rows(spark):
    """Expected rows of each stage: nulls, blanks, a very long text, repeated rows."""
    got = through(spark, clashing(awkward(spark)))
    long = "word after word and then, one more " * 30_000
    texts = lambda name: sorted(((r["doc_id"], r["text"]) for r in got[name]), key=str)
    want = sorted([(902, long), (903, "same\nrow"), (903, "same\nrow"), (None, "no id but text")], key=str)
    assert texts("language") == texts("lines") == want  # 900, 901 and 904 have no letter
    assert texts("near_duplicates") == sorted({*want}, key=str)
    assert {r["doc_id"] for r in got["encoding"]} == {r["doc_id"] for r in got["mixing"]}
    docs = clashing(awkward(spark))
    sizes = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        if name != "encoding":
            assert docs.columns == P.COLUMNS
        sizes.append(docs.count())
    assert sizes == [len(got[name]) for name, _ in P.STAGES] and sizes[:3] == [4, 4, 3]
    empty = clashing(awkward(spark)).limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_run(spark):
    rows = P.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert rows.count() > 50
