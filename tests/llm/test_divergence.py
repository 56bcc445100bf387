import random
import re
from collections import Counter, defaultdict

from chronolex.llm import divergence as V

from .helpers import SF, awkward, clashing, documents, duck, rows

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(docs, min_docs=30, top=50):
    """docs: (text, lang, source)."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        mine = sorted(s for k, s in groups if k == lang)
        total = Counter()
        for s in mine:
            total.update({t: count[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(count[lang, s]) for s in mine}, share(total)
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def drawn(seed, n):
    r = random.Random(seed)
    out = []
    for d in range(n):
        own = [f"{x}é" for x in "abc"] if d % 3 else ["The", "the", "THE", "Ça", "zebra"]
        text = " ".join(r.choice([*own, *"klmnopqrstuvw", "x1y", "don't"]) for _ in range(r.randint(0, 30)))
        out.append((text, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s3", "é", ""])))
    return out


def frame(spark, docs):
    return documents(spark, [(k, t, lang, source, 0) for k, (t, lang, source) in enumerate(docs)])


def test_random_documents(spark, monkeypatch):
    docs = drawn(1, 400)
    want = brute(docs, 12, 4)
    assert rows(V.divergence(frame(spark, docs), 12, 4), *COLUMNS) == want
    # Few rows at a time, langs in blocks, long texts in pieces.
    monkeypatch.setattr(V, "FLUSH_ROWS", 20)
    monkeypatch.setattr(V, "SENT_GROUPS", 6)
    assert rows(V.divergence(frame(spark, docs).repartition(3), 12, 4, piece_bytes=16), *COLUMNS) == want


def test_agrees_with_its_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, want = duck(V.SQL, documents=docs.toPandas())
    assert rows(V.digest(docs), *names) == sorted(want)


def test_awkward_rows(spark):
    more = [(k, "tie one two", "en", f"s{k % 2}", 0) for k in range(8)] + [(50, "alone", "xx", "only", 0)]
    docs = clashing(awkward(spark, more))
    plain = [(r["text"], r["lang"], r["source"]) for r in docs.select("text", "lang", "source").collect()]
    assert rows(V.divergence(docs, 3, 50), *COLUMNS) == brute(plain, 3, 50)
    # No term is in thirty documents: every pair is there, at 0.
    got = rows(V.divergence(docs), *COLUMNS)
    assert got == brute(plain) and {r[4] for r in got} == {0}
    assert V.digest(docs.limit(0)).count() == 0


def test_large_counts_stay_exact():
    import duckdb

    share = V.SHARE.replace("N_", "20000000000000::BIGINT").replace("V_", "1000000").replace("n +", "9000000000000::BIGINT +")
    assert duckdb.sql(f"SELECT {share}").fetchall()[0][0] == 1 + 10**9 * (9 * 10**12 + 5) // (2 * 10**13 + 5 * 10**6)
