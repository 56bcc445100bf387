"""Search units from order lines: each order is a version with a chapter, its lines as articles, and a supplement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import units as U
from chronolex.plans.catalog import query, table

SIZE = 40

UNITS_SQL = """WITH l AS (SELECT l_orderkey AS version, CAST(l_linenumber AS INT) AS n, min(l_returnflag) AS f, CAST(min(l_quantity) AS INT) AS q, min(l_partkey) AS k, CAST(min(l_suppkey) % 3 + 1 AS INT) AS i FROM lineitem GROUP BY ALL),
b AS (SELECT *, '제' || n || '조' AS lab, '제' || n || '조(' || f || ')' AS head, repeat(k || ' ', q % 16) AS t, 'p' || q AS pt, 'item ' || k AS it, 'Work ' || version AS title, 'Work ' || version || ' > 제1장 총칙 > 제' || n || '조(' || f || ')' AS crumb, version % 3 <> 0 AS cur FROM l),
o AS (SELECT DISTINCT version, 'Work ' || version AS title FROM l),
a AS (SELECT version, 'a' || n AS base_path, 'a' || n AS article_path, n * 10 AS ord, 'article' AS unit, n AS article_no, 0 AS article_branch, NULL::INT AS paragraph_no, NULL::INT AS item_no, NULL::INT AS item_branch, lab AS label, title || ' ' || lab AS full_label, crumb AS breadcrumb, '' AS context, t AS text, head,
    head || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END || chr(10) || '① ' || pt || chr(10) || i || '. ' || it AS article_text, cur FROM b),
p AS (SELECT version, 'a' || n || '.p1' AS base_path, 'a' || n AS article_path, n * 10 + 1 AS ord, 'paragraph' AS unit, n, 0, 1, NULL::INT, NULL::INT, '제1항' AS label, title || ' ' || lab || ' 제1항', crumb || ' > 제1항', head || CASE WHEN t <> '' THEN ' ' || t ELSE '' END, pt, head, NULL, cur, head || chr(10) || '① ' || pt || chr(10) || i || '. ' || it AS embed FROM b),
i AS (SELECT version, 'a' || n || '.p1.i' || i AS base_path, 'a' || n AS article_path, n * 10 + 2 AS ord, 'item' AS unit, n, 0, 1, i, 0, '제' || i || '호' AS label, title || ' ' || lab || ' 제1항 제' || i || '호', crumb || ' > 제1항 > 제' || i || '호', head || CASE WHEN t <> '' THEN ' ' || t ELSE '' END || ' ① ' || pt, it, head, NULL, cur, NULL FROM b),
s AS (SELECT version, 'supp@1997-02-03', 'supp@1997-02-03', 1000, 'supplement', NULL::INT, NULL::INT, NULL::INT, NULL::INT, NULL::INT, '부칙(1997. 2. 3.)', title || ' 부칙(1997. 2. 3.)', title || ' > 부칙 1997. 2. 3.', '', '', '부칙 1997. 2. 3.', '부칙 1997. 2. 3.', false, NULL FROM o
  UNION ALL SELECT version, 'supp@1997-02-03/a1', 'supp@1997-02-03/a1', 1001, 'supp_article', NULL, NULL, NULL, NULL, NULL, '제1조', title || ' 부칙(1997. 2. 3.) 제1조', title || ' > 부칙(1997. 2. 3.) > 제1조(시행일)', '', '공포한 날부터 시행한다.', '제1조(시행일)', '제1조(시행일)' || chr(10) || '공포한 날부터 시행한다.', false, NULL FROM o),
u AS (SELECT *, CASE WHEN cur THEN article_text END AS embed FROM a UNION ALL SELECT * REPLACE (CASE WHEN cur THEN embed END AS embed) FROM p UNION ALL SELECT * FROM i UNION ALL SELECT * FROM s),
w AS (SELECT *, 40 - length(head) - 1 AS room, unnest(CASE WHEN length(head) + 1 + length(text) <= 40 THEN [0] ELSE generate_series(1, CAST(ceil(length(text) / (40.0 - length(head) - 1)) AS BIGINT)) END) AS win FROM u)
SELECT version, base_path || CASE WHEN win > 0 THEN '#' || win ELSE '' END AS path, base_path, article_path, ord, unit, article_no, article_branch, paragraph_no, item_no, item_branch, NULL AS subitem, NULL::INT AS annex_no, NULL::INT AS annex_branch, label, full_label, breadcrumb, context,
  CASE WHEN win = 0 THEN text ELSE substr(text, (win - 1) * room + 1, room) END AS text, CAST(win AS INT) AS "window", CASE WHEN win <= 1 THEN article_text END AS article_text, CASE WHEN win = 0 THEN embed WHEN embed IS NOT NULL THEN head || chr(10) || substr(text, (win - 1) * room + 1, room) END AS embed_text FROM w"""


@query("search_units", UNITS_SQL)
def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed of each order: articles, a paragraph and an item in each, a supplement with an article of its own."""
    s = lambda c: F.col(c).cast("string")
    key = [F.col("l_orderkey").alias("version"), F.col("l_linenumber").cast("int").alias("n")]
    line = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(*key).agg(F.min("l_returnflag").alias("f"), F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("k"), (F.min("l_suppkey") % 3 + 1).alias("i"))
    none, art = F.lit(None).cast("string"), F.concat(F.lit("a"), s("n"))
    para = F.concat(art, F.lit(".p1"))
    row = lambda ord_, path, parent, unit, label, heading, text: F.struct(ord_.cast("int").alias("ord"), path.alias("path"), parent.alias("parent"), F.lit(unit).alias("unit"), label.alias("label"), heading.alias("heading"), text.alias("text"))
    of_line = F.array(
        row(F.col("n") * 10, art, F.lit("c1"), "article", F.concat(F.lit("제"), s("n"), F.lit("조")), F.col("f"), F.repeat(F.concat(s("k"), F.lit(" ")), F.col("q") % 16)),
        row(F.col("n") * 10 + 1, para, art, "paragraph", F.lit("①"), none, F.concat(F.lit("p"), s("q"))),
        row(F.col("n") * 10 + 2, F.concat(para, F.lit(".i"), s("i")), para, "item", F.concat(s("i"), F.lit(".")), none, F.concat(F.lit("item "), s("k"))),
    )
    supp = F.lit("supp@1997-02-03")
    of_order = F.array(
        row(F.lit(0), F.lit("c1"), none, "chapter", F.lit("제1장"), F.lit("총칙"), F.lit("")),
        row(F.lit(1000), supp, none, "supplement", F.lit("부칙"), none, F.lit("")),
        row(F.lit(1001), F.concat(supp, F.lit("/a1")), supp, "supp_article", F.lit("제1조"), F.lit("시행일"), F.lit("공포한 날부터 시행한다.")),
    )
    # versions are dealt once: an order's rows are made from its lines
    whole = line.select("version", of_line.alias("_of")).groupBy("version").agg(F.flatten(F.collect_list("_of")).alias("_of"))
    rows = whole.select("version", F.inline(F.concat(of_order, "_of")))
    titled = rows.withColumn("title", F.concat(F.lit("Work "), s("version")))
    return U.search_units(titled, F.col("version") % 3 != 0, SIZE)
