"""Consumers of the outbox that stop and go on, and rows put to the nearest of several centres."""

from chronolex.operators import retrieval as R
from chronolex.streaming import outbox


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    source, home = tmp_path / "in", str(tmp_path / "home")
    schema = "k string, n int, v string"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        return sorted(tuple(r) for r in outbox.upserted(spark.readStream.schema(schema).parquet(str(source)), ["k"], "n", folder=home).collect())

    assert run([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]) == [("a", 2, "y"), ("b", 1, "z")]
    assert run([("b", 5, "new"), ("c", 1, "c"), ("a", 1, "late")]) == [("a", 2, "y"), ("b", 5, "new"), ("c", 1, "c")]
    assert run([]) == [("a", 2, "y"), ("b", 5, "new"), ("c", 1, "c")]
    assert len(outbox.snapshots(spark, home)) == 2


def test_nearest_centres_in_blocks(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0]), (7, [float("nan"), 1.0])], "id int, v array<double>")
    centres = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [0.0, 2.0]), ("d", [3.0, 0.0]), ("a", None)], "name string, centre array<double>")
    want = [(1, "c"), (2, "b"), (3, None), (4, "b"), (5, None), (6, "b"), (7, None)]
    for most in (1, 2, 10):
        got = R.classified(rows, centres, "v", "name", "centre", most).orderBy("id").collect()
        assert [(r["id"], r["nearest_label"]) for r in got] == want
    assert R.classified(rows, centres.filter("false"), "v", "name", "centre").filter("nearest_label IS NOT NULL").count() == 0
