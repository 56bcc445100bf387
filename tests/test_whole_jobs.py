"""Queries whose SQL once left part of the job out: what they must reach, counted another way."""

import duckdb

from chronolex.operators import impact
from chronolex.plans import registry

SF = "/root/testdata/sf0.001"
CHANGED = f"(SELECT * FROM '{SF}/part.parquet' WHERE p_size % 5 < 4)"


def count(sql):
    return duckdb.connect().execute(sql).fetchone()[0]


def test_severity_of_all_changed_parts(spark):
    pairs = f"SELECT DISTINCT o_custkey, p_partkey FROM {CHANGED} JOIN '{SF}/lineitem.parquet' ON l_partkey = p_partkey JOIN '{SF}/orders.parquet' ON o_orderkey = l_orderkey"
    got = registry.queries()["impact_severity"](spark, SF)
    assert got.count() == count(f"SELECT count(*) FROM ({pairs})")
    assert got.select("cause").distinct().count() == count(f"SELECT count(DISTINCT p_partkey) FROM ({pairs})")


def test_second_hop_of_all_changed_parts(spark):
    strong = f"SELECT DISTINCT p_partkey, c_nationkey FROM {CHANGED} JOIN '{SF}/lineitem.parquet' ON l_partkey = p_partkey AND l_linenumber BETWEEN 2 AND 5 JOIN '{SF}/orders.parquet' ON o_orderkey = l_orderkey JOIN '{SF}/customer.parquet' ON c_custkey = o_custkey"
    got = registry.queries()["impact_second_hop"](spark, SF).agg({"n": "sum"}).first()[0]
    assert got == count(f"SELECT count(*) FROM ({strong})")


def test_late_entries_of_the_ledger_count(spark):
    """A user in the ledger from event 500 on: of their errors only those before it are unseen."""
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type").collect()
    since = {}
    for r in sorted(events):
        if r.event_type == "signup":
            since.setdefault(r.user_id, r.event_id)
    want = sorted(r.event_id for r in events if r.event_type == "error" and since.get(r.user_id, r.event_id) >= r.event_id)
    assert sorted(r.event_id for r in registry.queries()["unseen_notes"](spark, SF).collect()) == want
    schema = "event_id long, user_id long"
    notes = spark.createDataFrame([(1, 1), (600, 1), (600, 2), (600, None), (None, 1)], schema)
    ledger = spark.createDataFrame([(500, 1), (900, 1), (600, 2), (None, 2), (1, None)], schema)
    got = impact.unseen(notes, ledger, ["user_id"], "event_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1), (600, 2), (600, None), (None, 1)]))


def test_recipients_of_impacts_on_several_things(spark):
    """Pairs that can't repeat are not compared; those of an impact on several groups, on owned things as well, or listed twice come once."""
    impacts = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 2, 1), (2, 3, 2), (3, 9, 1), (3, 2, 1), (4, 9, 2), (5, 4, None), (6, None, 2), (7, 9, 1), (7, 8, 1)], "impact long, affected long, team int")
    owners = spark.createDataFrame([(9, "o"), (9, "o"), (9, "p"), (8, "p"), (9, "a")], "affected long, recipient string")
    admins = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (None, "n")], "team int, recipient string")
    want = sorted([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "o"), (3, "p"), (3, "a"), (3, "b"), (4, "o"), (4, "p"), (4, "a"), (6, "b"), (6, "c"), (7, "o"), (7, "p"), (7, "a")])
    for few in (100, 1):
        d = impact.recipients(impacts, owners, admins, "team", few)
        assert sorted(tuple(r) for r in d.collect()) == want


def test_pairs_of_a_group_are_not_compared(spark):
    """300 impacts on one team of 300 admins: their 90,000 pairs are united with the others, not merged with them."""
    impacts = spark.range(300).selectExpr("id AS impact", "id AS affected", "1 AS team")
    admins = spark.range(300).selectExpr("1 AS team", "'a' || id AS recipient")
    d = impact.recipients(impacts, spark.createDataFrame([], "affected long, recipient string"), admins, "team")
    assert d.count() == d.distinct().count() == 90_000
    assert d._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
