"""Releases of keyed tables: pinned readers, one winner, buckets rewritten alone, the way back."""

import threading

import pytest

from chronolex.sources import releases as R

SCHEMA = "k int, s string, n int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "t")
    first = [(k, "a", k) for k in range(50)] + [(7, "second row", 0), (None, "no key", 1)]
    a = R.publish(spark.createDataFrame(first, SCHEMA), root, keys=["k"], buckets=8)
    assert a.number == 0 and sorted(map(tuple, R.read(spark, root).collect()), key=str) == sorted(first, key=str)
    changes = spark.createDataFrame([(7, "new", 1), (7, "new", 2), (100, "more", 3)], SCHEMA)
    b = R.replace_keys(changes, root, gone=spark.createDataFrame([(3,), (None,), (999,)], "k int"))
    want = [r for r in first if r[0] not in (7, 3, None)] + [(7, "new", 1), (7, "new", 2), (100, "more", 3)]
    assert sorted(map(tuple, R.read(spark, root).collect()), key=str) == sorted(want, key=str)
    touched = {str(x[0]) for x in spark.createDataFrame([(7,), (100,), (3,), (None,), (999,)], "k int").select(R.bucket_of(["k"], 8)).collect()}
    assert set(R.rewritten(a, b)) <= touched and len(touched) < 8
    assert all(a.files[x] == b.files[x] for x in a.files if x not in touched)
    # A lookup by keys reads their buckets only.
    some = R.read(spark, root, keys=spark.createDataFrame([(7,)], "k int"))
    assert rows(some) == [(7, "new", 1), (7, "new", 2)] and set(some.inputFiles()) and len(some.inputFiles()) == len(b.files[str(spark.createDataFrame([(7,)], "k int").select(R.bucket_of(["k"], 8)).first()[0])])


def test_readers_are_pinned_and_a_release_can_return(spark, tmp_path):
    root = str(tmp_path / "t")
    R.publish(spark.createDataFrame([(1, "old", 1)], SCHEMA), root, keys=["k"], buckets=2)
    reader = R.read(spark, root)
    R.upsert(spark.createDataFrame([(1, "new", 2), (2, "x", 1)], SCHEMA), root, "n")
    R.upsert(spark.createDataFrame([(1, "late", 0), (2, "tie", 1)], SCHEMA), root, "n")
    assert rows(reader) == [(1, "old", 1)] and rows(R.read(spark, root)) == [(1, "new", 2), (2, "tie", 1)]
    assert R.roll_back(spark, root, 0).number == 3 and rows(R.read(spark, root)) == [(1, "old", 1)] and rows(R.read(spark, root, 2)) == [(1, "new", 2), (2, "tie", 1)]
    assert R.numbers(spark, root) == [0, 1, 2, 3]
    R.replace_keys(spark.createDataFrame([], SCHEMA), root, gone=spark.createDataFrame([(1,)], "k int"))
    assert rows(R.read(spark, root)) == []
    with pytest.raises(ValueError, match="columns are"):
        R.replace_keys(spark.createDataFrame([(1,)], "k int"), root)
    with pytest.raises(FileNotFoundError):
        R.read(spark, str(tmp_path / "none"))


def test_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "t")
    R.publish(spark.createDataFrame([(1, "base", 1)], SCHEMA), root, keys=["k"], buckets=2)
    out = {}

    def write(name):
        try:
            out[name] = R.replace_keys(spark.createDataFrame([(1, name, 1)], SCHEMA), root, after=0).number
        except R.Conflict:
            out[name] = "conflict"

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b", "c")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, out.values())) == ["1", "conflict", "conflict"]
    winner = next(n for n, x in out.items() if x == 1)
    assert rows(R.read(spark, root)) == [(1, winner, 1)] and R.numbers(spark, root) == [0, 1]
