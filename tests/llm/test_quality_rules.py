import re
from collections import Counter, defaultdict

from chronolex.llm import quality_rules as Q

from .helpers import SF, awkward, clashing, documents

W = re.compile("[^\x20\x09-\x0d]+")
COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    t = text or ""
    ws = W.findall(t)
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = Counter(x for x in t.split("\n") if W.search(x))
    n = len(ws)
    return (n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), sum(v - 1 for v in lines.values()), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_measures_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in Q.digest(docs).collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][c] for c in COLS) == brute(r.text), r.doc_id
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[d] for d, q in labels.items() if q == 1]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in good if not r.base_failed)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_overlapping_repeats(spark):
    texts = ["a b c d e f g h " * 3, "x " * 40, "a b c d e f g h i a b c d e f g h", " ".join(map(str, range(50))), "a b c d e f g h a b c d e f g"]
    got = {r.doc_id: r for r in Q.digest(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLS) == brute(t)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = Q.digest(docs)
    assert sorted(tuple(r[c] for c in COLS) for r in got.collect()) == sorted(brute(r.text) for r in docs.collect())
    assert not any(r.kept for r in got.collect() if r.n_words == 0)
    assert Q.digest(docs.limit(0)).count() == 0


def test_em_trusts_the_better_rule():
    # Rules 0 and 1 agree always, rule 2 votes at random: it must end about as likely either way.
    patterns = [((g, g, r), 1000 if g else 200) for g in (0, 1) for r in (0, 1)]
    prior, odds = Q.fit(patterns, 3)
    assert 0.78 < prior < 0.88
    assert odds[0][1][0] > 0.95 and odds[1][0][1] > 0.95
    assert abs(odds[2][1][0] - odds[2][1][1]) < 0.05
    assert Q.posterior((1, 1, None), prior, odds) > 0.9 > 0.1 > Q.posterior((0, 0, None), prior, odds)
