"""Serving queries: preferred rows, facets, paging, joins by meaning, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import serving as S
from chronolex.operators.retrieval import small_side
from chronolex.plans.catalog import query, table
from chronolex.plans.versions import CHAIN_SQL, orders_chain

MONEY = "decimal(18,2)"


def money(column: str):
    """Sum of a double column that holds cents, exact in any order."""
    return F.sum(F.col(column).cast(MONEY)).cast("double")


@query(
    "distinct_on_current_first",
    f"""WITH {CHAIN_SQL} SELECT o_custkey, o_orderkey, state, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (state = 'CURRENT') DESC, valid_from DESC NULLS LAST, o_orderkey DESC) AS r FROM c) WHERE r = 1""",
)
def distinct_on_current_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of each customer, else the latest."""
    best = F.struct(F.col("state") == "CURRENT", "valid_from", "o_orderkey")
    return S.preferred(orders_chain(spark, sf_dir), ["o_custkey"], best).select("o_custkey", "o_orderkey", "state", "valid_from")


@query(
    "facets_self_excluding",
    """WITH x AS (SELECT c_custkey, n_name, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT 'n_name' AS axis, n_name AS value, count(DISTINCT c_custkey) AS n FROM x WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F' GROUP BY n_name
    UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(DISTINCT c_custkey) FROM x WHERE n_name IN ('NATION_1', 'NATION_2') AND o_orderstatus = 'F' GROUP BY c_mktsegment
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(DISTINCT c_custkey) FROM x WHERE n_name IN ('NATION_1', 'NATION_2') AND c_mktsegment = 'MACHINERY' GROUP BY o_orderstatus""",
)
def facets_self_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    x = table(spark, sf_dir, "orders").join(c, F.expr("o_custkey = c_custkey"))
    keep = {"n_name": F.col("n_name").isin("NATION_1", "NATION_2"), "c_mktsegment": F.col("c_mktsegment") == "MACHINERY", "o_orderstatus": F.col("o_orderstatus") == "F"}
    return S.facets(x, keep, F.col("c_custkey"))


@query("terms_top_values", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10")
def terms_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_values(table(spark, sf_dir, "part"), "p_name", 10)


@query("page_with_total", "SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return S.page(o, [F.desc("o_totalprice"), "o_orderkey"], 20, 3)


@query("severity_sort_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM orders")
def severity_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders by severity, newest first, with their places."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", level.alias("level"))
    return S.places(d, [F.col("level"), F.desc("o_orderdate"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("semi_has_current", f"WITH {CHAIN_SQL} SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey AND state = 'CURRENT')")
def semi_has_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = orders_chain(spark, sf_dir).filter("state = 'CURRENT'")
    return table(spark, sf_dir, "customer").join(now, F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_unclassified", "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("filter_in_on_left_join", f"WITH {CHAIN_SQL} SELECT c_custkey, o_orderkey, valid_from FROM customer LEFT JOIN c ON o_custkey = c_custkey AND state = 'FUTURE'")
def filter_in_on_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    future = orders_chain(spark, sf_dir).filter("state = 'FUTURE'")
    return table(spark, sf_dir, "customer").join(future, F.expr("o_custkey = c_custkey"), "left").select("c_custkey", "o_orderkey", "valid_from")


@query(
    "multi_path_resolution",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, coalesce(a.o_custkey, b.s_nationkey, c.p_size) AS owner FROM lineitem l
    LEFT JOIN orders a ON a.o_orderkey = l.l_orderkey AND a.o_orderstatus = 'P' LEFT JOIN supplier b ON b.s_suppkey = l.l_suppkey AND b.s_acctbal > 5000 LEFT JOIN part c ON c.p_partkey = l.l_partkey""",
)
def multi_path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner found by the first of three paths that leads somewhere; equality joins only."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_suppkey", "s_nationkey")
    c = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    d = line.join(a, F.expr("o_orderkey = l_orderkey"), "left").join(b, F.expr("s_suppkey = l_suppkey"), "left").join(c, F.expr("p_partkey = l_partkey"), "left")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("o_custkey", F.col("s_nationkey").cast("long"), F.col("p_size").cast("long")).alias("owner"))


@query(
    "correlated_aggregates",
    f"""WITH {CHAIN_SQL} SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS works, (SELECT count(*) FROM customer JOIN c ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND state = 'CURRENT') AS current_works,
    (SELECT max(valid_from) FROM customer JOIN c ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS newest, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""",
)
def correlated_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home page numbers per nation: one aggregate per source, joined to the small dimension."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    chain = orders_chain(spark, sf_dir).join(cust, F.expr("o_custkey = c_custkey"))
    works = cust.groupBy("n_nationkey").agg(F.count("*").alias("works"))
    live = chain.groupBy("n_nationkey").agg(F.count_if(F.col("state") == "CURRENT").alias("current_works"), F.max("valid_from").alias("newest"))
    supp = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    d = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(works, "n_nationkey", "left").join(live, "n_nationkey", "left").join(supp, "n_nationkey", "left")
    return d.fillna(0, ["works", "current_works", "suppliers"])


@query("conditional_aggregates", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS big, count(DISTINCT user_id) FILTER (WHERE value > 10) AS big_users, bool_or(value < 0.1) AS any_tiny FROM events GROUP BY event_type")
def conditional_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("value") > 10
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(big).alias("big"), F.countDistinct(F.when(big, F.col("user_id"))).alias("big_users"), F.bool_or(F.col("value") < 0.1).alias("any_tiny")
    )


@query("json_field_counts", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return d.filter("k IS NOT NULL").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("nearest_rank_latency", "SELECT event_type, value AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = CAST(round(0.95 * (n - 1)) AS INTEGER)")
def nearest_rank_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "p95")


@query(
    "majority_value",
    """WITH v AS (SELECT n_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY n_nationkey ORDER BY n DESC) AS k, sum(n) OVER (PARTITION BY n_nationkey) AS total FROM v)
    SELECT n_nationkey, max(c_mktsegment) AS winner, max(n) AS "count", CAST(max(total) AS BIGINT) AS total FROM r WHERE k = 1 GROUP BY n_nationkey HAVING count(*) = 1 AND max(n) >= 2""",
)
def majority_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return S.majority(c, ["n_nationkey"], "c_mktsegment")


@query(
    "divergence_ranking",
    """WITH v AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS k, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM v),
    w AS (SELECT c_nationkey, max(c_mktsegment) AS winner, max(n) AS cnt, max(total) AS total FROM r WHERE k = 1 GROUP BY ALL HAVING count(*) = 1 AND max(n) >= 2)
    SELECT c_custkey, c_mktsegment, winner, round(cnt / total, 6) AS share FROM customer JOIN w USING (c_nationkey) WHERE c_mktsegment <> winner ORDER BY cnt / total DESC, cnt DESC, c_custkey LIMIT 50""",
)
def divergence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose value differs from their nation's majority, clearest majorities first; a top list."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    w = S.majority(c, ["c_nationkey"], "c_mktsegment")
    d = c.join(w, "c_nationkey").filter("c_mktsegment <> winner").withColumn("s", F.col("count") / F.col("total"))
    return d.orderBy(F.desc("s"), F.desc("count"), "c_custkey").limit(50).select("c_custkey", "c_mktsegment", "winner", F.round("s", 6).alias("share"))


@query(
    "compare_matrix",
    """SELECT n_name, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS furniture,
    count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS household, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def compare_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers by items as a pivot over the stated items."""
    items = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    p = d.groupBy("n_name").pivot("c_mktsegment", items).agg(F.count(F.lit(1)))
    return p.select("n_name", *[F.coalesce(i, F.lit(0)).alias(i.lower()) for i in items])


@query(
    "pick_most_different",
    """WITH v AS (SELECT n_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), own AS (SELECT c_mktsegment, n FROM v WHERE n_nationkey = 0)
    SELECT v.n_nationkey, count(*) FILTER (WHERE v.n IS DISTINCT FROM own.n) AS differing, count(*) AS filled FROM v LEFT JOIN own USING (c_mktsegment) WHERE v.n_nationkey <> 0 GROUP BY ALL ORDER BY differing DESC, filled DESC, v.n_nationkey LIMIT 5""",
)
def pick_most_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five issuers to compare with issuer 0: most differing values, then most values."""
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    own = v.filter("n_nationkey = 0").select("c_mktsegment", F.col("n").alias("own"))
    d = v.filter("n_nationkey <> 0").join(own, "c_mktsegment", "left").groupBy("n_nationkey").agg(F.count_if(~F.col("n").eqNullSafe(F.col("own"))).alias("differing"), F.count("*").alias("filled"))
    return d.orderBy(F.desc("differing"), F.desc("filled"), "n_nationkey").limit(5)


@query(
    "group_caps_round_robin",
    """SELECT o_orderkey, o_custkey, k AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2""",
)
def group_caps_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two per customer at most, with the turn in which each would be shown."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("turn", F.row_number().over(w)).filter("turn <= 2").select("o_orderkey", "o_custkey", "turn")


@query("number_gaps", "WITH g AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, unnest(generate_series(1, top)) AS k FROM g) SELECT s.l_orderkey, CAST(k AS INTEGER) AS missing FROM s ANTI JOIN lineitem l ON l.l_orderkey = s.l_orderkey AND l.l_linenumber = k")
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return g.select("l_orderkey", F.explode("missing").alias("missing"))


@query(
    "page_ranges",
    """WITH d AS (SELECT DISTINCT l_suppkey, l_linenumber AS k FROM lineitem WHERE l_quantity > 45), i AS (SELECT *, k - row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS g FROM d), r AS (SELECT l_suppkey, min(k) AS a, max(k) AS b FROM i GROUP BY l_suppkey, g)
    SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ',' ORDER BY a) AS pages FROM r GROUP BY l_suppkey""",
)
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranges(table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), ["l_suppkey"], "l_linenumber", "pages")


@query(
    "recognition_rate",
    """SELECT l_orderkey, count(DISTINCT l_linenumber) AS found, max(l_linenumber) AS top, round(count(DISTINCT l_linenumber) / max(l_linenumber), 4) AS rate, count(DISTINCT l_linenumber) < 0.95 * max(l_linenumber) AS low FROM lineitem GROUP BY l_orderkey""",
)
def recognition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("found"), F.max("l_linenumber").alias("top"))
    return d.withColumn("rate", F.round(F.col("found") / F.col("top"), 4)).withColumn("low", F.col("found") < F.col("top") * 0.95)


@query(
    "spelling_groups",
    """WITH n AS (SELECT lower(replace(p_name, ' ', '')) AS norm, p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, p_name) AS k, sum(n) OVER (PARTITION BY norm) AS total FROM n)
    SELECT norm, p_name AS spelling, CAST(total AS BIGINT) AS total FROM r WHERE k = 1""",
)
def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy(F.lower(F.replace("p_name", F.lit(" "))).alias("norm"), "p_name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("norm").orderBy(F.desc("n"), "p_name")
    return n.withColumn("k", F.row_number().over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("norm"))).filter("k = 1").select("norm", F.col("p_name").alias("spelling"), "total")


@query(
    "daily_summary",
    """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS spent FROM events GROUP BY 1""",
)
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.col("event_type") == k
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.count_if(kind("error")).alias("errors"), F.count_if(kind("purchase")).alias("purchases"), F.countDistinct("user_id").alias("users"),
        F.sum(F.when(kind("purchase"), F.col("value").cast(MONEY))).cast("double").alias("spent"),
    )


@query(
    "business_day_window",
    """SELECT CAST((ts + INTERVAL 9 HOUR) AS DATE) AS business_day, event_type, count(*) AS n FROM events GROUP BY ALL""",
)
def business_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by business day nine hours ahead of UTC."""
    return table(spark, sf_dir, "events").groupBy((F.col("ts") + F.expr("INTERVAL 9 HOURS")).cast("date").alias("business_day"), "event_type").agg(F.count("*").alias("n"))


@query(
    "corpus_fingerprint",
    """WITH b AS (SELECT lang, doc_id // 1000 AS block, md5(string_agg(CAST(doc_id AS VARCHAR) || ':' || md5(text), ',' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, md5(string_agg(digest, ',' ORDER BY block)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY lang""",
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest per language over the ordered hashes of all documents, by way of digests of a thousand ids each: rebuild only where it changed."""
    ordered = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), ",")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5("text"))
    d = table(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 1000).alias("block"), "doc_id", line.alias("line"))
    b = d.groupBy("lang", "block").agg(F.md5(ordered("doc_id", "line")).alias("digest"), F.count("*").alias("n"))
    return b.groupBy("lang").agg(F.md5(ordered("block", "digest")).alias("digest"), F.sum("n").alias("n"))


@query(
    "order_independent_fingerprint",
    """SELECT source, CAST(sum(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || text), 1, 8)) AS BIGINT)) AS BIGINT) AS digest, count(*) AS n FROM documents GROUP BY source""",
)
def order_independent_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest that adds up hashes, so it combines before the shuffle and never gathers a group."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text")), 1, 8), 16, 10).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(h).alias("digest"), F.count("*").alias("n"))


@query("union_distinct_names", "SELECT lower(p_type) AS name FROM part UNION SELECT lower(c_mktsegment) FROM customer UNION SELECT lower(event_type) FROM events")
def union_distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, c: table(spark, sf_dir, t).select(F.lower(c).alias("name"))
    return pick("part", "p_type").union(pick("customer", "c_mktsegment")).union(pick("events", "event_type")).distinct()


@query(
    "symmetric_difference",
    """(SELECT o_custkey AS k, 'orders only' AS side FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'orders only' FROM orders WHERE o_orderstatus = 'P')
    UNION ALL (SELECT o_custkey, 'pending only' FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey, 'pending only' FROM orders WHERE o_orderstatus = 'F')""",
)
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda s: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return k("F").subtract(k("P")).withColumn("side", F.lit("orders only")).union(k("P").subtract(k("F")).withColumn("side", F.lit("pending only")))


@query(
    "optional_filters",
    """SELECT o_orderkey, o_custkey FROM orders WHERE (NULL IS NULL OR o_custkey = NULL) AND ('F' IS NULL OR o_orderstatus = 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters with parameters that may be absent: an absent one adds no predicate, the others reach the scan."""
    d = table(spark, sf_dir, "orders")
    for column, values in {"o_custkey": None, "o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}.items():
        d = d if values is None else d.filter(F.col(column).isin(values))
    return d.select("o_orderkey", "o_custkey")


@query(
    "kind_by_name_suffix",
    """SELECT CASE WHEN p_name LIKE '%ring' OR p_name LIKE '%bolt' THEN 'fastener' WHEN p_name LIKE '%widget' THEN 'widget' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1""",
)
def kind_by_name_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = lambda *s: F.col("p_name").rlike(f"({'|'.join(s)})$")
    kind = F.when(ends("ring", "bolt"), "fastener").when(ends("widget"), "widget").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@query(
    "all_terms_match_sorted",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'r') AND contains(lower(p_name), 'bolt') ORDER BY (lower(p_name) <> 'red bolt'), NOT starts_with(lower(p_name), 'red'), length(p_name), p_name, p_partkey LIMIT 30""",
)
def all_terms_match_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms must occur; the exact name first, then names that start with the first term, then short ones; a top list."""
    name = F.lower("p_name")
    d = table(spark, sf_dir, "part").filter(name.contains("r") & name.contains("bolt"))
    return d.orderBy(name != "red bolt", ~name.startswith("red"), F.char_length("p_name"), "p_name", "p_partkey").limit(30).select("p_partkey", "p_name")


@query(
    "longest_prefix_ancestor",
    """WITH p AS (SELECT DISTINCT CAST(l_suppkey % 50 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) || '.' || l_returnflag AS path FROM lineitem),
    k AS (SELECT CAST(s_suppkey % 50 AS VARCHAR) AS path FROM supplier WHERE s_acctbal > 5000 UNION SELECT CAST(l_suppkey % 50 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_quantity = 50)
    SELECT p.path, max_by(k.path, length(k.path)) AS ancestor FROM p LEFT JOIN k ON p.path = k.path OR starts_with(p.path, k.path || '.') GROUP BY p.path""",
)
def longest_prefix_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("a", (F.col("l_suppkey") % 50).cast("string")).withColumn("b", F.concat_ws(".", "a", F.col("l_linenumber").cast("string")))
    paths = line.select(F.concat_ws(".", "b", "l_returnflag").alias("path")).distinct()
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select((F.col("s_suppkey") % 50).cast("string").alias("path")).union(line.filter("l_quantity = 50").select("b"))
    return S.longest_prefix(paths, known, [], "path")


@query(
    "path_subtree_join",
    """SELECT a.r_regionkey, count(*) AS below FROM region a JOIN (SELECT CAST(n_regionkey AS VARCHAR) || '.' || CAST(n_nationkey AS VARCHAR) || '.' || CAST(c_custkey AS VARCHAR) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey) b
    ON b.path = CAST(a.r_regionkey AS VARCHAR) OR b.path LIKE CAST(a.r_regionkey AS VARCHAR) || '.%' GROUP BY ALL""",
)
def path_subtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below a path: the path's leading parts are the join key, so no pattern is matched pairwise."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    paths = c.select(F.concat_ws(".", "n_regionkey", "n_nationkey", "c_custkey").alias("path"))
    tops = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_regionkey").cast("string").alias("top"))
    return paths.withColumn("top", F.split_part("path", F.lit("."), F.lit(1))).join(small_side(tops, 100_000), "top").groupBy("r_regionkey").agg(F.count("*").alias("below"))


@query(
    "name_resolution",
    """WITH k AS (SELECT n_nationkey, n_name AS full_name, lower(replace(n_name, '_', '')) AS norm FROM nation), a AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'Nation' || c_nationkey ELSE 'Land ' || c_nationkey END AS q FROM customer)
    SELECT q, coalesce(e.n_nationkey, n.n_nationkey) AS n_nationkey, CASE WHEN e.n_nationkey IS NOT NULL THEN 'exact' WHEN n.n_nationkey IS NOT NULL THEN 'normalised' ELSE 'unresolved' END AS how
    FROM a LEFT JOIN k e ON e.full_name = q LEFT JOIN k n ON n.norm = lower(replace(replace(q, '_', ''), ' ', ''))""",
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to keys: the exact name, else the normalised one if it is unique."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[_ ]", ""))
    k = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    norms = k.groupBy(bare("n_name").alias("norm")).agg(F.count("*").alias("same"), F.min("n_nationkey").alias("by_norm")).filter("same = 1").drop("same")
    c, n = F.col("c_custkey") % 3, F.col("c_nationkey").cast("string")
    asks = table(spark, sf_dir, "customer").select(F.when(c == 0, F.concat(F.lit("NATION_"), n)).when(c == 1, F.concat(F.lit("Nation"), n)).otherwise(F.concat(F.lit("Land "), n)).alias("q")).distinct()
    d = asks.join(small_side(k.withColumnRenamed("n_name", "q"), 100_000), "q", "left").withColumn("norm", bare("q")).join(small_side(norms, 100_000), "norm", "left")
    how = F.when(F.col("n_nationkey").isNotNull(), "exact").when(F.col("by_norm").isNotNull(), "normalised").otherwise("unresolved")
    return d.select("q", F.coalesce("n_nationkey", "by_norm").alias("n_nationkey"), how.alias("how"))


@query(
    "eval_hit_rate",
    """SELECT source, count(*) AS n, round(avg(quality), 6) AS precision, round(avg(CASE WHEN n_chars >= 200 THEN quality END), 6) AS strict_precision FROM labels JOIN documents USING (doc_id) GROUP BY source""",
)
def eval_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("precision"), F.round(F.avg(F.when(F.col("n_chars") >= 200, F.col("quality"))), 6).alias("strict_precision"))


@query("release_gate", "SELECT lang, count(*) AS chunks, count(*) FILTER (WHERE n_chars >= 100) AS next, count(*) FILTER (WHERE n_chars >= 100) * 100 >= count(*) * 98 AS drop_ok FROM documents GROUP BY lang")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild that loses more than two percent of a language's chunks is held back."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("chunks"), F.count_if(F.col("n_chars") >= 100).alias("next"))
    return d.withColumn("drop_ok", F.col("next") * 100 >= F.col("chunks") * 98)


@query("natural_path_sort", "SELECT p_partkey, row_number() OVER (ORDER BY split_part(p_brand, '#', 1), CAST(split_part(p_brand, '#', 2) AS INTEGER), p_name, p_partkey) AS place FROM part")
def natural_path_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in an order in which digit runs sort as numbers, with their places."""
    order = [F.split_part("p_brand", F.lit("#"), F.lit(1)), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int"), F.col("p_name"), F.col("p_partkey")]
    return S.places(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), order, "place").select("p_partkey", "place")
