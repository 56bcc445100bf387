"""Structure, citations, topics and listings: orders written out as regulations and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import citations as C
from chronolex.operators import passages as P
from chronolex.operators import structure as S
from chronolex.plans.catalog import query, table
from chronolex.sources import bodies as B
from chronolex.sources import documents as D
from chronolex.sources import listing as L
from chronolex.sources.storage import shared_folder

LINES_SQL = """
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem),
u AS (SELECT l_orderkey AS doc_id, 'a' || r AS path, 'article' AS unit, NULL AS parent_path, 'part ' || l_partkey AS heading, '' AS text, r * 10 AS o FROM l
  UNION ALL SELECT l_orderkey, 'a' || r || '.p1', 'paragraph', 'a' || r, NULL, 'takes ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.', r * 10 + 1 FROM l
  UNION ALL SELECT l_orderkey, 'a' || r || '.p1.i1', 'item', 'a' || r || '.p1', NULL, 'flag ' || l_returnflag, r * 10 + 2 FROM l
  UNION ALL SELECT l_orderkey, 'a' || r || '.p1.i1.s2', 'subitem', 'a' || r || '.p1.i1', NULL, 'state ' || l_linestatus || CASE WHEN r > 1 THEN chr(10) || '제1조 goes on' ELSE '' END, r * 10 + 3 FROM l),
tree AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INT) AS ord, path, unit, parent_path, heading, text FROM u)
"""


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text): an order's lines as articles, the first paragraph glued to the heading."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    l = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))  # noqa: E741
    s = lambda c: F.col(c).cast("string")
    lines = F.array(
        F.concat(F.lit("제"), s("r"), F.lit("조(part "), s("l_partkey"), F.lit(") ① takes "), F.col("l_quantity").cast("int").cast("string"), F.lit(".")),
        F.concat(F.lit("1. flag "), F.col("l_returnflag")),
        F.concat(F.lit("나. state "), F.col("l_linestatus")),
        F.when(F.col("r") > 1, "제1조 goes on").otherwise(" "),
    )
    return l.select(F.col("l_orderkey").alias("doc_id"), "r", F.posexplode(lines).alias("k", "text")).select("doc_id", (F.col("r") * 4 + F.col("k")).alias("line_no"), "text")


@query("parse_provisions", f"WITH {LINES_SQL} SELECT * FROM tree")
def parse_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.provisions(order_texts(spark, sf_dir)).drop("notes", "deleted")


@query("parse_statistics", f"WITH {LINES_SQL} SELECT doc_id, unit, count(*) AS n, CAST(0 AS BIGINT) AS deleted FROM tree GROUP BY ALL")
def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statistics(S.provisions(order_texts(spark, sf_dir)))


@query("provision_breadcrumbs", f"WITH {LINES_SQL} SELECT t.doc_id, t.path, a.heading || CASE WHEN len(string_split(t.path, '.')) > 1 THEN ' > ' || array_to_string([array_to_string(string_split(t.path, '.')[1:k], '.') FOR k IN range(2, len(string_split(t.path, '.')) + 1)], ' > ') ELSE '' END AS trail FROM tree t JOIN tree a ON a.doc_id = t.doc_id AND a.path = string_split(t.path, '.')[1]")
def provision_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.breadcrumbs(S.provisions(order_texts(spark, sf_dir)))


@query(
    "effective_dates",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 1 END AS s,
    CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INT) END AS h, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 1 END AS p FROM orders)
    SELECT o_orderkey, coalesce(a, s, h, p) AS effective_from, CASE WHEN a IS NOT NULL THEN 'api' WHEN s IS NOT NULL THEN 'supplement' WHEN h IS NOT NULL THEN 'history' WHEN p IS NOT NULL THEN 'portal' WHEN o_orderkey % 2 = 1 THEN 'filename' ELSE 'none' END AS basis,
    CASE WHEN a IS NOT NULL THEN 'CONFIRMED' WHEN s IS NOT NULL THEN CASE WHEN (h IS NOT NULL AND h <> s) OR (p IS NOT NULL AND p <> s AND p IS DISTINCT FROM h) THEN 'CONFLICT' ELSE 'CONFIRMED' END ELSE 'UNCERTAIN' END AS status FROM d""",
)
def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(
        key, F.when(key % 7 == 0, day).alias("api_date"), F.when(key % 3 != 0, F.date_add(day, 1)).alias("supplement_date"), F.when(key % 5 < 2, F.date_add(day, (key % 2).cast("int"))).alias("history_date"),
        F.when(key % 4 == 0, F.date_add(day, 1)).alias("portal_date"), F.when(key % 2 == 1, "rules_2024.03.pdf").otherwise("rules.pdf").alias("file_name"),
    )
    return S.effective(d).select("o_orderkey", "effective_from", "basis", "status")


REFS_SQL = """
w AS (SELECT p_partkey AS work, p_brand || ' ' || p_name || ' ' || CAST(p_partkey % 50 AS VARCHAR) AS title, CAST(p_size % 7 + 1 AS INT) AS articles FROM part),
s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, CASE WHEN l_linenumber % 3 = 0 THEN 'unknown ' || CAST(l_suppkey AS VARCHAR) ELSE w.title END AS title FROM lineitem JOIN w ON w.work = l_partkey),
r AS (SELECT l_orderkey, l_partkey, true AS external, title, 'a' || l_linenumber || '.p' || (l_suppkey % 3 + 1) AS path, 'BASIS' AS rel FROM s
  UNION ALL SELECT l_orderkey, l_partkey, false, NULL, 'a' || (l_linenumber + 1) || '-2', CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'EXCEPTION' ELSE 'MUTATIS' END FROM s)
"""


def citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_partkey, text): each order line cites its part's regulation (or an unknown one) and an article of its own."""
    titled = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_name", (F.col("p_partkey") % 50).cast("string")).alias("own"))
    l = table(spark, sf_dir, "lineitem").join(titled, "l_partkey")  # noqa: E741
    s = lambda c: c.cast("string")
    title = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("unknown "), s(F.col("l_suppkey")))).otherwise(F.col("own"))
    tail = F.when(F.col("l_quantity").cast("int") % 2 == 0, "에도 불구하고 정한다.").otherwise("를 준용한다.")
    text = F.concat(F.lit("이 규정은 「"), title, F.lit("」 제"), s(F.col("l_linenumber")), F.lit("조제"), s(F.col("l_suppkey") % 3 + 1), F.lit("항에 따라 정하며, 그 밖에는 앞의 여러 사정을 고려하여 나머지 사항을 다음과 같이 정한다. 다만, 제"), s(F.col("l_linenumber") + 1), F.lit("조의2"), tail)
    return l.select("l_orderkey", "l_partkey", text.alias("text"))


@query("reference_extraction", f"WITH {REFS_SQL} SELECT * FROM r")
def reference_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extracted(citing(spark, sf_dir), "text", ["l_orderkey", "l_partkey"])


@query(
    "reference_resolution",
    f"""WITH {REFS_SQL}, n AS (SELECT title, count(*) AS hits, min(work) AS only_work, min(articles) AS only_articles FROM w GROUP BY title),
    j AS (SELECT r.*, hits, CASE WHEN NOT external THEN l_partkey WHEN hits = 1 THEN only_work END AS target FROM r LEFT JOIN n ON n.title = r.title),
    k AS (SELECT j.*, t.articles, CAST(regexp_extract(path, 'a([0-9]+)', 1) AS INT) AS a, contains(path, '-') AS branch FROM j LEFT JOIN w t ON t.work = j.target)
    SELECT resolution, target_kind, rel, count(*) AS n FROM (SELECT rel, CASE WHEN target IS NULL THEN 'NONE' ELSE 'PROVISION' END AS target_kind,
      CASE WHEN external AND hits > 1 THEN 'AMBIGUOUS' WHEN target IS NULL THEN 'UNRESOLVED' WHEN NOT branch AND a <= articles THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution FROM k) GROUP BY ALL""",
)
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references are resolved; a part's regulation has as many articles as its size says."""
    part = table(spark, sf_dir, "part")
    works = part.select(F.col("p_partkey").alias("work"), F.concat_ws(" ", "p_brand", "p_name", (F.col("p_partkey") % 50).cast("string")).alias("title"))
    places = part.select(F.col("p_partkey").alias("work"), F.explode(F.sequence(F.lit(1), F.col("p_size") % 7 + 1)).alias("a")).select("work", F.concat(F.lit("a"), F.col("a").cast("string")).alias("path"))
    refs = C.extracted(citing(spark, sf_dir), "text", ["l_orderkey", "l_partkey"])
    return C.resolved(refs, works, places, "l_partkey").groupBy("resolution", "target_kind", "rel").agg(F.count("*").alias("n"))


#: Sentences by the number of a line, with {n} and {m}, {k} one and two more; what they cite, with its place, kind, title, target and relation.
SENTENCES = {
    1: ("「K{n}규정」 제{n}조 및 제{m}조에 따른다. 같은 규정 제{k}조를 준용한다.", [("external", "K{n}규정", "a{n}", "CITATION"), ("external", "K{n}규정", "a{m}", "BASIS"), ("external", "K{n}규정", "a{k}", "MUTATIS")]),
    2: ("제{n}항에도 불구하고 별표 {n}과 별지 제{m}호 서식을 쓴다. 나머지는 따로 정한다.", [("internal", None, "a2.p{n}", "EXCEPTION"), ("annex", None, "annex{n}", "CITATION"), ("annex", None, "form{m}", "CITATION"), ("delegation", None, None, "DELEGATION")]),
    3: ("회계규정 제{n}조와 제{m}조, 별표 {k}의2를 본다.", [("named", "회계규정", "a{n}", "CITATION"), ("named", "회계규정", "a{m}", "CITATION"), ("named_annex", "회계규정", "annex{k}-2", "CITATION")]),
    4: ("제{n}조제2항 및 제{m}항을 준용하고 같은 조 제{k}항은 뺀다.", [("internal", None, "a{n}.p2", "MUTATIS"), ("internal", None, "a{n}.p{m}", "MUTATIS"), ("internal", None, "a{n}.p{k}", "CITATION")]),
    5: ("K{m}규정에서 따로 정한다. 여비규정에 의하여 준다.", [("delegation_named", "K{m}규정", None, "DELEGATION"), ("named", "여비규정", None, "BASIS")]),
    6: ("법 제{n}조와 이 규정 제{m}조를 본다.", [("named", "방지법", "a{n}", "CITATION"), ("internal", None, "a{m}", "CITATION")]),
    7: ("인사규정 제{n}조에 따라 정한다.", [("named", "인사규정", "a{n}", "IMPLEMENTS")]),
    11: ("이 절은 공공기관의 운영에 관한 법률 제{n}조부터 제{m}조까지를 따르고, 제{k}조를 본다.", [("named", "공공기관의 운영에 관한 법률", "a{n}", "CITATION"), ("named", "공공기관의 운영에 관한 법률", "a{m}", "CITATION"), ("internal", None, "a{k}", "CITATION")]),
    12: ("업무편람 제{n}조(직위의 해제) 및 제{m}조(복직)를 준용한다. 정관 제{k}조를 본다.", [("named", "업무편람", "a{n}", "MUTATIS"), ("named", "업무편람", "a{m}", "MUTATIS"), ("named", "정관", "a{k}", "CITATION")]),
    13: ("『공무원 여비 규정』 제{n}조와 K{m}내규에서 위임한 것을 뺀다.", [("named", "공무원 여비 규정", "a{n}", "CITATION"), ("named", "K{m}내규", None, "IMPLEMENTS")]),
}
#: Lines with a second sentence, by what is added to their number.
SECOND = 10


def _passages_sql() -> str:
    def value(x: str | None) -> str:
        return "NULL" if x is None else "'" + x.replace("{n}", "' || n || '").replace("{m}", "' || (n + 1) || '").replace("{k}", "' || (n + 2) || '") + "'"

    rows = [f"SELECT l_orderkey, 'a{line}' AS path, {k} AS place, '{kind}' AS kind, {value(title)} AS title, {value(target)} AS target, '{rel}' AS rel FROM l WHERE l_linenumber = {line % SECOND}" for line, (_, found) in SENTENCES.items() for k, (kind, title, target, rel) in enumerate(found, 1)]
    return f"WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) % 9 + 1 AS n FROM lineitem GROUP BY ALL) {' UNION ALL '.join(rows)}"


@query("citation_passes", _passages_sql())
def citation_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line number of an order is a provision with a sentence of its own, some are two; the sixth uses an abbreviation that its order defines."""
    n = (F.min("l_suppkey") % 9 + 1).alias("n")
    line = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(n)  # dealt once, for the abbreviations too
    seconds = [x - SECOND for x in SENTENCES if x > SECOND]
    number = F.explode(F.when(F.col("l_linenumber").isin(seconds), F.array("l_linenumber", F.col("l_linenumber") + SECOND)).otherwise(F.array("l_linenumber")))
    l = line.withColumn("l_linenumber", number)  # noqa: E741
    text = F.lit(None).cast("string")
    for line, (sentence, _) in SENTENCES.items():
        s = F.lit(sentence)
        for k, mark in enumerate(("{n}", "{m}", "{k}")):
            s = F.replace(s, F.lit(mark), (F.col("n") + k).cast("string"))
        text = F.when(F.col("l_linenumber") == line, s).otherwise(text)
    heading = F.when(F.col("l_linenumber") == 7, "목적")
    texts = l.select("l_orderkey", F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("path"), heading.alias("heading"), text.alias("text"))
    defining = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("「방지법」(이하 “법”이라 한다)").alias("text"))
    return P.cited(texts, "text", "l_orderkey", "path", "heading", P.abbreviations(defining, "l_orderkey", "text"))


@query(
    "lookup_relaxation",
    """WITH p AS (SELECT DISTINCT l_partkey AS work, l_linenumber AS a, l_suppkey % 3 + 1 AS p FROM lineitem), q AS (SELECT o_orderkey, l_partkey AS work, o_custkey % 7 + 1 AS a, o_custkey % 3 + 1 AS p FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
    SELECT o_orderkey, q.work, 'a' || q.a || CASE WHEN bool_or(p.p = q.p) THEN '.p' || q.p ELSE '' END AS path, NOT bool_or(p.p = q.p) AS relaxed FROM q JOIN p ON p.work = q.work AND p.a = q.a GROUP BY o_orderkey, q.work, q.a, q.p""",
)
def lookup_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask for a paragraph of their first part; where it isn't there, the article answers."""
    line = table(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    article = F.concat(F.lit("a"), s(F.col("l_linenumber")))
    places = line.select(F.col("l_partkey").alias("work"), F.explode(F.array(article, F.concat(article, F.lit(".p"), s(F.col("l_suppkey") % 3 + 1)))).alias("path"))
    first = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("work"))
    path = F.concat(F.lit("a"), s(F.col("o_custkey") % 7 + 1), F.lit(".p"), s(F.col("o_custkey") % 3 + 1))
    asked = table(spark, sf_dir, "orders").join(first, "o_orderkey").select("o_orderkey", "work", path.alias("path"))
    return C.lookup(asked, places, "o_orderkey")


@query("citation_parsing", "SELECT o_orderkey, '규정 ' || CAST(o_custkey AS VARCHAR) AS title, CAST(o_orderkey % 40 + 1 AS INT) AS article, CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS branch, CAST(o_custkey % 9 + 1 AS INT) AS paragraph, 'a' || (o_orderkey % 40 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN '-3' ELSE '' END || '.p' || (o_custkey % 9 + 1) AS path FROM orders")
def citation_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    q = F.concat(F.lit("규정 "), s(F.col("o_custkey")), F.lit(" 제"), s(F.col("o_orderkey") % 40 + 1), F.lit("조"), F.when(F.col("o_orderkey") % 2 == 0, "의3").otherwise(""), F.lit(" 제"), s(F.col("o_custkey") % 9 + 1), F.lit("항"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.parse(q).alias("c")).select("o_orderkey", "c.title", "c.article", "c.branch", "c.paragraph", "c.path")


#: Keywords of topics (a small configuration, as the title rules take it).
KEYWORDS = [("small", "size"), ("large", "size"), ("cold widget", "special"), ("cold", "heat"), ("hot", "heat"), ("widget", "goods"), ("bolt", "goods"), ("STANDARD", "class"), ("PROMO", "class")]


def _topics_sql() -> str:
    ordered = sorted(KEYWORDS, key=lambda k: (-len(k[0]), k[0]))
    stages = ["m0 AS (SELECT p_partkey, p_name || ' ' || p_type AS m FROM part)"]
    for n, (word, _) in enumerate(ordered):
        at = f"strpos(reverse(m), reverse('{word}'))"
        stages.append(f"m{n + 1} AS (SELECT * EXCLUDE (m), CASE WHEN {at} > 0 THEN length(m) - {at} + 1 END AS e{n}, replace(m, '{word}', repeat(chr(1), {len(word)})) AS m FROM m{n})")
    union = " UNION ALL ".join(f"SELECT p_partkey, '{topic}' AS topic, e{n} AS e FROM m{len(ordered)} WHERE e{n} IS NOT NULL" for n, (_, topic) in enumerate(ordered))
    return f"WITH {', '.join(stages)}, h AS (SELECT p_partkey, topic, max(e) AS e FROM ({union}) GROUP BY ALL) SELECT p_partkey, topic, CAST(row_number() OVER w AS INT) AS place, round(1.0::DOUBLE - (row_number() OVER w - 1) * 0.1::DOUBLE, 1) AS score FROM h WINDOW w AS (PARTITION BY p_partkey ORDER BY e DESC, topic) QUALIFY place <= 2"


@query("title_topics", _topics_sql())
def title_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return C.topics(part, "title", KEYWORDS, ["p_partkey"])


@query("evidence_packing")
def evidence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as candidates, their price in hundreds as length: a fold, held against Python in the tests."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100).cast("long").alias("n"))
    return C.packed(o, "o_custkey", "o_orderkey", "n")


@query(
    "statute_list_xml",
    """SELECT c_custkey, count(*) OVER (PARTITION BY c_custkey) AS total, CAST(o_orderkey AS VARCHAR) AS id, '법 ' || CAST(o_orderkey AS VARCHAR) AS name, CAST(o_orderdate AS DATE) AS promulgated, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS effective, o_orderpriority AS ministry, true AS complete FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def statute_list_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders written as list pages and read back with a schema."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    start = F.col("o_orderdate").cast("date")
    law = tag("law", F.concat(tag("id", F.col("o_orderkey").cast("string")), tag("name", F.concat(F.lit("법 "), F.col("o_orderkey").cast("string"))), tag("promulgated", day(start)), F.when(F.col("o_orderstatus") != "P", tag("effective", day(F.date_add(start, 30)))).otherwise(""), tag("ministry", F.col("o_orderpriority"))))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    pages = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("<LawSearch><totalCnt>"), F.count("*").cast("string"), F.lit("</totalCnt>"), F.array_join(F.collect_list(law), ""), F.lit("</LawSearch>")).alias("xml"))
    return D.statute_list(pages, "xml", ["c_custkey"])


@query("rule_listing_json", "SELECT s_nationkey, CAST(s_suppkey AS VARCHAR) AS seq, s_name AS title, CAST(s_suppkey AS VARCHAR) || '|' || s_name || '|A|2024-01-02|' AS fingerprint FROM supplier")
def rule_listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("s_suppkey").cast("string").alias("seq"), F.col("s_name").alias("title"), F.lit("A").alias("division"), F.lit("2024-01-02").alias("start"))
    pages = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("json"))
    return D.rule_listing(pages, "json", ["s_nationkey"]).select("s_nationkey", "seq", "title", "fingerprint")


def archived_pages(spark: SparkSession, sf_dir: str) -> str:
    """Customers of each nation as archived list pages, numbered by nation; tells the folder."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    entry = F.struct(F.col("c_custkey").cast("string").alias("seq"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("division"))
    pages = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.to_json(F.struct(F.count("*").alias("total"), F.sort_array(F.collect_list(entry)).alias("rows"))).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(folder)
    return folder


PAGES_SQL = "SELECT CAST(c_nationkey AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) AS INT) AS place, count(*) OVER (PARTITION BY c_nationkey) AS total, CAST(c_custkey AS VARCHAR) AS seq, c_name AS title, c_mktsegment AS division FROM customer"


@query("paged_listing", f"SELECT * FROM ({PAGES_SQL}) WHERE page >= 5")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived pages read through the data source, from the fifth on: earlier ones aren't opened."""
    L.register(spark)
    d = spark.read.format("paged_listing").option("pagesPerPartition", 4).load(archived_pages(spark, sf_dir)).filter("page >= 5")
    return d.select("page", "place", "total", F.from_json("entry", "seq string, title string, division string").alias("e")).select("page", "place", "total", "e.*")


@query(
    "statute_body_xml",
    """WITH l AS (SELECT l_orderkey, 'a' || l_linenumber || CASE WHEN l_suppkey % 3 > 0 THEN '-' || (l_suppkey % 3) ELSE '' END AS path, l_returnflag AS flag, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem)
    SELECT l_orderkey, path, 'article' AS unit, 'T' || flag AS heading, 'Body' AS text FROM l UNION ALL SELECT l_orderkey, path || '.p2', 'paragraph', NULL, 'Flag ' || flag FROM l
    UNION ALL SELECT l_orderkey, path || '.p2.i' || q, 'item', NULL, 'Piece' FROM l UNION ALL SELECT o_orderkey, 'supp@' || strftime(o_orderdate, '%Y-%m-%d'), 'supplement', NULL, 'Takes effect' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def statute_body_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as statute bodies, their lines as articles, and read back as provisions."""
    tag = lambda n, *c: F.concat(F.lit(f"<{n}>"), *c, F.lit(f"</{n}>"))
    item = tag("호", tag("호내용", F.col("l_quantity").cast("int").cast("string"), F.lit(".  Piece")))
    paragraph = tag("항", tag("항번호", F.lit("②")), tag("항내용", F.lit("② Flag "), "l_returnflag"), item)
    number, branch = F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 3).cast("string")
    article = tag("조문단위", tag("조문여부", F.lit("조문")), tag("조문번호", number), tag("조문가지번호", branch), tag("조문제목", F.lit("T"), "l_returnflag"), tag("조문내용", F.lit("제"), number, F.lit("조(T) Body")), paragraph)
    preamble = F.lit("<조문단위><조문여부>전문</조문여부><조문내용>제1장 총칙</조문내용></조문단위>")
    articles = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(article), "").alias("articles"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    supplement = tag("부칙", tag("부칙단위", tag("부칙공포일자", "day"), tag("부칙내용", F.lit("Takes \n effect"))))
    bodies = articles.join(orders, "l_orderkey").select("l_orderkey", tag("법령", tag("조문", preamble, "articles"), supplement).alias("xml"))
    return B.statute_provisions(bodies, "xml", ["l_orderkey"]).drop("ord")
