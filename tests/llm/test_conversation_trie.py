import hashlib
import random
import zlib
from collections import defaultdict

from chronolex.llm import conversation_trie as C

from .helpers import SF, duck, rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn long, role string, text string"


def remainder(c, n):
    return c - n * int(c / n)


def brute(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - remainder(c, 5), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in C.digest(df, **options).select(*COLUMNS).collect()), key=repr)


def random_turns(seed, convs, longest):
    """Conversations of few different turns, so that they share heads, copies of a common one among them."""
    r = random.Random(seed)
    out = []
    for c in range(convs):
        n = r.choice([1, 2, 5, longest])
        texts = ["hello", "a", "bé"] if c % 3 else ["hello"] * 3
        out += [(c if c % 7 else -c, k, "user" if k % 2 else "assistant", r.choice(texts)) for k in range(n)]
    r.shuffle(out)
    return out


def test_random_tries(spark):
    turns = random_turns(1, 60, 12)
    df = spark.createDataFrame(turns, TURN)
    want = brute(turns)
    assert got(df) == want
    # Rows of two turns: conversations of several rows, names of rows in several rounds, pieces of one id.
    assert got(df, block=2, piece_chars=1) == want


def test_preorder_intervals(spark):
    nodes = C.trie(spark.createDataFrame(random_turns(2, 40, 9), TURN)).collect()
    for a in nodes:
        for b in nodes:
            assert a["hi"] < b["lo"] or b["hi"] < a["lo"] or (a["lo"] <= b["lo"] and b["hi"] <= a["hi"]) or (b["lo"] <= a["lo"] and a["hi"] <= b["hi"])
    assert sum(n["depth"] == 0 for n in nodes) == 1


def test_agrees_with_its_sql(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    names, want = duck(C.SQL, conversations=df.toPandas())
    assert rows(C.digest(df), *names) == sorted(want, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    long = "very long " * 50_000
    turns = [(None, 0, "user", "nobody's"), (0, None, None, None), (0, 2, "user", long), (0, 2, "user", long), (0, 2, "assistant", "tie"), (1, 0, "u", "x"), (2, 0, "", ""), (3, None, "", ""), (12, 5, "u", "base is absent")]
    df = spark.createDataFrame(turns, TURN)
    clashing = df.withColumns({c: F.lit("x") for c in "depth key r n lo hi kh one length base h node parent up_to_one".split()})
    assert got(clashing) == got(df, block=2) == brute(turns)
    assert C.digest(df.limit(0)).count() == 0
    # Only turns of nobody: no conversation, no root.
    assert C.digest(df.filter("conv_id IS NULL")).count() == 0
