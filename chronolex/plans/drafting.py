"""Queries on drafts of regulations; order lines, parts and documents stand for pages, provisions and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import wording as W
from chronolex.operators import drafting as D
from chronolex.plans.catalog import query, table


@query(
    "two_up_gutter",
    """WITH b AS (SELECT l_suppkey AS page, (l_partkey % 2) * 400 + l_linenumber * 10 AS x0, (l_partkey % 2) * 400 + l_linenumber * 10 + l_quantity * CASE WHEN l_suppkey % 3 = 0 THEN 12 ELSE 5 END AS x1, CASE WHEN l_suppkey % 2 = 0 THEN 842 ELSE 595 END AS width FROM lineitem)
    SELECT page, CASE WHEN width = 842 AND count(*) >= 20 AND count(*) FILTER (WHERE x1 <= 421) >= 10 AND count(*) FILTER (WHERE x0 >= 421) >= 10 AND count(*) FILTER (WHERE x0 < 418 AND x1 > 424) <= 0.02 * count(*) THEN 421.0::DOUBLE END AS gutter FROM b GROUP BY page, width""",
)
def two_up_gutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which landscape pages hold two pages side by side."""
    x0 = (F.col("l_partkey") % 2) * 400 + F.col("l_linenumber") * 10
    wide = F.when(F.col("l_suppkey") % 2 == 0, 842.0).otherwise(595.0)
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), x0.alias("x0"), (x0 + F.col("l_quantity") * F.when(F.col("l_suppkey") % 3 == 0, 12).otherwise(5)).alias("x1"), wide.alias("width"), (F.lit(1437.0) - wide).alias("height"))
    return D.gutters(b, "page")


@query(
    "recognised_lines",
    """WITH b AS (SELECT l_orderkey, l_linenumber AS k, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, CASE WHEN l_orderkey % 3 <> 0 THEN 600 END AS w FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL),
    t AS (SELECT *, 0 AS j, CASE WHEN k = 3 THEN 'Part | ' || l_partkey ELSE 'Line ' || l_partkey END AS text FROM b UNION ALL SELECT *, 1, CASE WHEN k = 3 THEN 'Supplier | ' || l_suppkey ELSE 'goes on' END FROM b)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, j) AS no, text, 1 AS page, round(0.1::DOUBLE * k * w, 1) AS x0, round(0.05::DOUBLE * k * w, 1) AS y0 FROM t""",
)
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recognised pages: JSON with a block per order line (the first a page header, the third a table)."""
    k, part, by = F.col("l_linenumber"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    cells = F.concat(F.lit("<table><tr><td>Part</td><td>"), part, F.lit("</td></tr><tr><td> </td><td></td></tr><tr><td>Supplier</td><td>"), by, F.lit("</td></tr></table>"))
    kind = F.when(k == 1, "header").when(k == 3, "table").otherwise("text")
    content = F.when(k == 3, cells).otherwise(F.concat(F.lit("Line "), part, F.lit("\n\n goes on ")))
    block = F.struct(k.alias("index"), kind.alias("type"), content.alias("content"), F.array(F.lit(0.1) * k, F.lit(0.05) * k, F.lit(0.9), F.lit(0.9)).alias("bbox"))
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    o = blocks.groupBy("l_orderkey").agg(F.collect_list(block).alias("blocks"))
    scan = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.col("blocks"))).alias("pages")))
    size = F.when(F.col("l_orderkey") % 3 != 0, 600.0)
    return D.recognised_lines(o.select("l_orderkey", scan.alias("scan"), size.alias("width"), size.alias("height")), "l_orderkey")


@query(
    "report_table",
    """WITH g AS (SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
    SELECT 1 AS no, '# Events' AS line UNION ALL SELECT 2, '| event_type | events | users |' UNION ALL SELECT 3, '|---|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY event_type) + 3, '| ' || event_type || ' | ' || events || ' | ' || users || ' |' FROM g""",
)
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return D.report_lines(g, "event_type", ["events", "users"], "Events")


DRAFT_SQL = """draft AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 0 THEN '개정 2001. 2. 3.' END, '- 3 -', CASE WHEN c_custkey % 3 = 0 THEN '원규분류 : A-' || c_custkey END, '목 차', CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ' 규정' END,
    '제1조(목적) ····· 1', CASE WHEN c_custkey % 4 <> 1 THEN '제1조(목적)' END, CASE WHEN c_custkey % 4 <> 1 THEN '제2조(정의)' END, CASE WHEN c_custkey % 4 = 2 THEN '제1장 총칙' END, CASE WHEN c_custkey % 4 = 2 THEN '제1절' END, CASE WHEN c_custkey % 7 <> 0 THEN '제1조(목적) ' || c_name || '의 일을 정한다.' END], lambda x: x IS NOT NULL) AS ls FROM customer)"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one regulation per customer: revision, page number, class, contents, title, contents' entries, chapter, first article."""
    k = F.col("c_custkey")
    lines = [
        F.when(k % 2 == 0, "개정 2001. 2. 3."), F.lit("- 3 -"), F.when(k % 3 == 0, F.concat(F.lit("원규분류 : A-"), k.cast("string"))), F.lit("목 차"), F.when(k % 5 != 0, F.concat("c_mktsegment", F.lit(" 규정"))), F.lit("제1조(목적) ····· 1"),
        F.when(k % 4 != 1, "제1조(목적)"), F.when(k % 4 != 1, "제2조(정의)"), F.when(k % 4 == 2, "제1장 총칙"), F.when(k % 4 == 2, "제1절"), F.when(k % 7 != 0, F.concat(F.lit("제1조(목적) "), "c_name", F.lit("의 일을 정한다."))),
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_compact(F.array(*lines)).alias("ls"))


@query(
    "header_fields",
    rf"""WITH {DRAFT_SQL} SELECT c_custkey, list_filter(ls, lambda x: NOT regexp_matches(x, '원규분류\s*:?\s*([A-Z0-9-]+)') AND NOT regexp_matches(x, '^\s*[<\[(]?\s*(제정|개정|전부\s*개정|일부\s*개정|시행)\s*[0-9''’(]') AND NOT regexp_matches(x, '[.·…]{{4,}}') AND NOT regexp_matches(x, '^[0-9\s.-]+$') AND NOT contains(substr(x, 1, 2), '목'))[1] AS title,
    nullif(regexp_extract(list_filter(ls, lambda x: contains(x, '원규분류'))[1], '([A-Z0-9-]+)$', 1), '') AS code, len(list_filter(ls, lambda x: starts_with(x, '개정 '))) AS revisions FROM draft""",
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("c_custkey", *[c.alias(k) for k, c in D.header(F.col("ls")).items()])


@query(
    "body_start",
    rf"""WITH {DRAFT_SQL}, l AS (SELECT c_custkey, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS k, len(ls) AS n FROM draft), m AS (SELECT *, lead(x) OVER (PARTITION BY c_custkey ORDER BY k) AS nx FROM l),
    f AS (SELECT c_custkey, any_value(n) AS n, min(k) FILTER (WHERE regexp_matches(x, '^제[0-9]+조\s*\([^)]+\)') AND NOT regexp_matches(x, '[.·…]{{4,}}') AND NOT (regexp_matches(x, '^제[0-9]+조\s*\([^)]+\)\s*$') AND regexp_matches(coalesce(nx, ''), '^제[0-9]+[조장]'))) AS first FROM m GROUP BY 1)
    SELECT f.c_custkey, coalesce(max(k) FILTER (WHERE starts_with(x, '제1장') AND k < first AND k >= first - 3), any_value(first), any_value(f.n)) AS start FROM f JOIN l USING (c_custkey) GROUP BY 1""",
)
def body_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("c_custkey", D.body_start(F.col("ls")).alias("start"))


@query(
    "glyphs_replaced",
    """WITH t AS (SELECT doc_id, replace(replace(replace(coalesce(text, ''), ',', chr(61440)), '.', chr(983122)), '-', chr(61598)) AS t FROM documents), p AS (SELECT doc_id, string_split(regexp_replace(t, '[\\x{f0800}-\\x{f08ff}\\x{f000}]{3,}', ' ', 'g'), chr(61440)) AS p FROM t)
    SELECT doc_id, md5(replace(replace(CASE WHEN len(p) % 2 = 1 THEN array_to_string(list_transform(p, lambda x, i: x || CASE WHEN i = len(p) THEN '' WHEN i % 2 = 1 THEN '“' ELSE '”' END), '') ELSE array_to_string(p, ' ') END, chr(983122), '“'), chr(61598), '·')) AS digest FROM p""".replace("\\\\", "\\"),
)
def glyphs_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word processors' glyphs by characters; commas, full stops and hyphens stand for the glyphs."""
    t = F.coalesce("text", F.lit(""))
    for a, b in ((",", W.QUOTE), (".", "\U000f0852"), ("-", "")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(W.glyphs(t)).alias("digest"))


WORD_END = "(ed|ing|ly|s)$"


@query(
    "line_joins",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), w AS (SELECT doc_id, k, regexp_extract_all(lower(x), '[a-z]+') AS ws FROM l),
    n AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws[2:len(ws) - 1]) AS word FROM w) GROUP BY 1), e AS (SELECT ws[len(ws)] AS a, lead(ws) OVER (PARTITION BY doc_id ORDER BY k)[1] AS b FROM w),
    d AS (SELECT a, b, count(*) AS times FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
    f AS (SELECT d.*, coalesce(x.n, 0) AS fa, coalesce(y.n, 0) AS fb, coalesce(z.n, 0) AS fab FROM d LEFT JOIN n x ON x.word = a LEFT JOIN n y ON y.word = b LEFT JOIN n z ON z.word = a || b),
    r AS (SELECT *, CASE WHEN fab >= 2 AND (fa = 0 OR fb = 0) THEN 1 WHEN fa >= 1 AND fb >= 1 AND fab < greatest(1, least(fa, fb) // 10) THEN 2 WHEN fab >= 1 THEN 3 WHEN regexp_matches(a, '{WORD_END}') AND fb >= 1 THEN 4 ELSE 5 END AS rule FROM f)
    SELECT a, b, times, rule, rule IN (2, 4) AS apart FROM r""",
)
def line_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the words around a line break are two words, by the words inside all lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))).alias("ls"))
    inner = F.flatten(F.transform("ls", lambda ws: F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0)))))
    lexicon = d.select(F.explode(inner).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ls") - 1, F.lit(1))), lambda k: F.struct(F.get(F.get("ls", k - 1), F.size(F.get("ls", k - 1)) - 1).alias("a"), F.get(F.get("ls", k), F.lit(0)).alias("b")))
    ends = d.select(F.inline(pairs)).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("times"))
    return D.line_joins(ends, lexicon, WORD_END)


@query(
    "path_labels",
    """SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN 'x9.q' WHEN l_returnflag = 'A' THEN 'supp/a' || l_linenumber ELSE 'a' || l_suppkey || '-' || l_linenumber || '.p' || l_linenumber || '~2' || CASE WHEN l_returnflag = 'R' THEN '.i3-2.s가' ELSE '' END END AS path,
    CASE WHEN l_linenumber = 7 THEN 'x9.q' WHEN l_returnflag = 'A' THEN '부칙 제' || l_linenumber || '조' ELSE '제' || l_suppkey || '조의' || l_linenumber || ' 제' || l_linenumber || '항' || CASE WHEN l_returnflag = 'R' THEN ' 제3호의2 가목' ELSE '' END END AS label FROM lineitem""",
)
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    tail = F.when(F.col("l_returnflag") == "R", ".i3-2.s가").otherwise("")
    path = F.when(F.col("l_linenumber") == 7, "x9.q").when(F.col("l_returnflag") == "A", F.concat(F.lit("supp/a"), n)).otherwise(F.concat(F.lit("a"), F.col("l_suppkey").cast("string"), F.lit("-"), n, F.lit(".p"), n, F.lit("~2"), tail))
    return table(spark, sf_dir, "lineitem").select(path.alias("path")).distinct().withColumn("label", W.path_label(F.col("path")))


@query(
    "unit_labels",
    """SELECT DISTINCT unit, label, CASE unit WHEN 'paragraph' THEN '제' || k || '항' WHEN 'item' THEN CASE WHEN k % 2 = 0 THEN '제' || k || '호' ELSE '제' || k || '호의2' END WHEN 'subitem' THEN '가목' ELSE label END AS full_label FROM (
    SELECT l_linenumber AS k, ['paragraph', 'item', 'subitem', 'article'][l_suppkey % 4 + 1] AS unit, CASE l_suppkey % 4 WHEN 0 THEN substr('①②③④⑤⑥⑦', l_linenumber, 1) WHEN 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || '.' ELSE l_linenumber || '의2.' END WHEN 2 THEN '가.' ELSE '제' || l_linenumber || '조' END AS label FROM lineitem)""",
)
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("l_linenumber"), F.col("l_suppkey") % 4
    unit = F.when(s == 0, "paragraph").when(s == 1, "item").when(s == 2, "subitem").otherwise("article")
    n = k.cast("string")
    label = F.when(s == 0, F.substring(F.lit(W.CIRCLED), k, F.lit(1))).when(s == 1, F.when(k % 2 == 0, F.concat(n, F.lit("."))).otherwise(F.concat(n, F.lit("의2.")))).when(s == 2, "가.").otherwise(F.concat(F.lit("제"), n, F.lit("조")))
    return table(spark, sf_dir, "lineitem").select(unit.alias("unit"), label.alias("label")).distinct().withColumn("full_label", W.unit_label(F.col("unit"), F.col("label")))


@query(
    "definitions_by_work",
    """WITH d AS (SELECT p_size AS work, p_partkey, p_brand AS abbreviation, p_name || '법' AS name FROM part UNION ALL SELECT p_size, p_partkey, '이 법', p_type FROM part WHERE p_partkey % 2 = 0)
    SELECT work, abbreviation, min_by(name, p_partkey) AS name FROM d GROUP BY ALL""",
)
def definitions_by_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a work's abbreviations stand for; the first definition of each counts."""
    t = F.concat(F.lit("제1조 「"), "p_name", F.lit("법」(이하 “"), "p_brand", F.lit("”이라 한다)에 따른다. 또 「별도 법」을 본다."), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" 「"), "p_type", F.lit("」 (이하 “이 법”라 한다)"))).otherwise(""))
    d = table(spark, sf_dir, "part").select(F.col("p_size").alias("work"), "p_partkey", F.inline(W.definitions(t)))
    return d.groupBy("work", "abbreviation").agg(F.min_by("name", "p_partkey").alias("name"))


@query("defined_terms", "SELECT p_partkey, p_brand AS term, '“' || p_brand || '”이란 ' || p_type || '을 말한다' AS definition FROM part WHERE length(p_brand) >= 2 UNION ALL SELECT p_partkey, p_type, '“' || p_type || '”란 ' || p_name || '를 말한다' FROM part WHERE p_partkey % 3 = 0")
def defined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("“"), "p_brand", F.lit("”이란 "), "p_type", F.lit("을 말한다. “나”란 사람을 말한다."), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" “"), "p_type", F.lit("”란 "), "p_name", F.lit("를 말한다."))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(W.terms(t)))


@query(
    "law_names",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '법' WHEN 1 THEN p_brand || ' 시행 규칙' WHEN 2 THEN p_brand || ' 시행령' WHEN 3 THEN p_brand || ' 지침' WHEN 4 THEN p_brand || ' 방법' ELSE NULL END AS name, p_partkey % 6 AS k, CASE WHEN p_size % 4 = 0 THEN 'DATE' ELSE 'REFERENCE' END AS kind FROM part)
    SELECT p_partkey, coalesce(kind = 'REFERENCE' AND k IN (1, 2, 4), false) AS pending, k IN (1, 2) AS in_scope FROM n""",
)
def law_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that wait for their statute, and names within the scope of collection."""
    k, b = F.col("p_partkey") % 6, F.col("p_brand")
    name = F.when(k == 0, "법").when(k == 1, F.concat(b, F.lit(" 시행 규칙"))).when(k == 2, F.concat(b, F.lit(" 시행령"))).when(k == 3, F.concat(b, F.lit(" 지침"))).when(k == 4, F.concat(b, F.lit(" 방법")))
    kind = F.when(F.col("p_size") % 4 == 0, "DATE").otherwise("REFERENCE")
    d = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), kind.alias("kind"))
    return d.select("p_partkey", F.coalesce(W.law_pending(F.col("kind"), F.col("name")), F.lit(False)).alias("pending"), W.in_scope(F.col("name"), ["법", "시행령", "시행규칙"], ["법"], ["방법"]).alias("in_scope"))


MODES = {"fact": "[0-9]+ ?(days|weeks|years)|\\bI (have|am|was)\\b", "permit": "(?i)\\b(may|am I allowed|allowed to)\\b", "ask_ok": "(?i)\\b(can|could)\\b", "asks": "(?i)\\b(what|how|when|which|why)\\b"}


@query(
    "answer_modes",
    rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '{MODES["permit"]}') OR ((d OR regexp_matches(q, '{MODES["fact"]}')) AND (d OR regexp_matches(q, '{MODES["ask_ok"]}') OR NOT regexp_matches(q, '{MODES["asks"]}'))) THEN 'judgment' ELSE 'general' END AS mode
    FROM (SELECT conv_id, turn, coalesce(text, '') AS q, conv_id % 11 = 0 AS d FROM conversations)""",
)
def answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn asks for a judgment or for an answer in general."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", W.answer_mode(F.col("text"), F.col("conv_id") % 11 == 0, MODES).alias("mode"))


PLAN_SQL = """cited AS (SELECT p_name AS norm, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), seeds AS (SELECT n_name AS norm, n_nationkey AS o FROM nation WHERE n_nationkey < 5 UNION ALL SELECT min(p_name), 9 FROM part),
bases AS (SELECT norm, 1 AS g, o AS a, norm AS b, 'CONFIG' AS why FROM seeds UNION ALL SELECT norm, 2, -n, norm, 'CITED' FROM cited WHERE n >= 2),
family AS (SELECT g, a, b, 0 AS k, norm AS name, why, NULL AS parent FROM bases UNION ALL SELECT g, a, b, 1, norm || ' decree', 'CHILD', norm FROM bases WHERE NOT ends_with(norm, ' decree') AND NOT ends_with(norm, ' rule') UNION ALL SELECT g, a, b, 2, norm || ' rule', 'CHILD', norm FROM bases WHERE NOT ends_with(norm, ' decree') AND NOT ends_with(norm, ' rule')),
fam AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY g, a, b, k) AS r, first_value(parent) OVER (PARTITION BY name ORDER BY parent IS NULL, g, a, b, k) AS par FROM family),
plan AS (SELECT name AS norm, why AS reason, par AS parent, coalesce(n, 0) AS citations, row_number() OVER (ORDER BY g, a, b, k) AS place FROM fam LEFT JOIN cited ON cited.norm = name WHERE r = 1 QUALIFY place <= 300)"""
CHILDREN = [" decree", " rule"]


def plan_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cited = table(spark, sf_dir, "lineitem").join(part, F.expr("l_partkey = p_partkey")).groupBy(F.col("p_name").alias("norm")).agg(F.count("*").alias("n"))
    seeds = table(spark, sf_dir, "nation").filter("n_nationkey < 5").select(F.col("n_name").alias("norm"), F.col("n_nationkey").alias("ord")).union(part.agg(F.min("p_name").alias("norm"), F.lit(9).alias("ord")))
    return D.scope_plan(seeds, cited, CHILDREN, 300, 2)


@query("scope_plan", f"WITH {PLAN_SQL} SELECT * FROM plan")
def scope_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to collect: the configured names, then the most cited ones, each with its children, 300 at most."""
    return plan_of(spark, sf_dir)


@query(
    "catalogue_matches",
    f"""WITH {PLAN_SQL}, r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' rule' ELSE p_brand || p_size END AS norm, CASE WHEN p_size % 5 = 0 THEN p_name END AS abbr, p_brand AS law FROM part WHERE p_size % 2 = 0),
    m AS (SELECT id, norm FROM r WHERE norm IN (SELECT norm FROM plan) OR abbr IN (SELECT norm FROM plan)), c AS (SELECT norm || ' decree' AS norm FROM m UNION SELECT norm || ' rule' FROM m),
    f AS (SELECT id, 1 AS p FROM m UNION ALL SELECT id, 2 FROM r WHERE norm IN (SELECT norm FROM c) UNION ALL SELECT id, 3 FROM r WHERE law = (SELECT min(p_brand) FROM part)) SELECT id, ['NAMED', 'CHILD', 'KEPT'][min(p)] AS reason FROM f GROUP BY id""",
)
def catalogue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an official catalogue that the plan names, their children, and those of laws that are kept."""
    part = table(spark, sf_dir, "part")
    norm = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" rule"))).otherwise(F.concat("p_brand", F.col("p_size").cast("string")))
    rows = part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), norm.alias("norm"), F.when(F.col("p_size") % 5 == 0, F.col("p_name")).alias("abbr"), F.col("p_brand").alias("law"))
    return D.catalogue_matches(plan_of(spark, sf_dir), rows, part.agg(F.min("p_brand").alias("law")), CHILDREN)


@query(
    "statute_links",
    """WITH names AS (SELECT DISTINCT p_brand || p_size AS name, p_type AS law FROM part), one AS (SELECT name, count(DISTINCT law) AS laws, min(law) AS law FROM names GROUP BY 1), st AS (SELECT p_type AS law, min(p_size) = 1 AS abolished FROM part GROUP BY 1), ar AS (SELECT p_type AS law, p_size AS article, bool_and(p_partkey % 2 = 0) AS gone FROM part GROUP BY ALL),
    refs AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 5 THEN 'nothing' ELSE p_brand || p_size END AS name, CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS INT) END AS article FROM lineitem JOIN part ON l_partkey = p_partkey),
    j AS (SELECT r.*, one.laws, CASE WHEN laws = 1 THEN one.law END AS law FROM refs r LEFT JOIN one USING (name))
    SELECT id, name, j.article, j.law, ar.gone IS NOT NULL AS found, CASE WHEN laws = 1 THEN 'linked' WHEN laws > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, CASE WHEN abolished THEN 'law_abolished' WHEN gone THEN 'article_deleted' WHEN j.law IS NOT NULL AND gone IS NULL AND j.article IS NOT NULL THEN 'article_missing' END AS reason
    FROM j LEFT JOIN st ON st.law = j.law LEFT JOIN ar ON ar.law = j.law AND ar.article = j.article""",
)
def statute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by name to statutes and their articles, with what is wrong with the target."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_brand", F.col("p_size").cast("string"))).withColumn("law", F.col("p_type"))
    n = F.col("l_linenumber")
    refs = table(spark, sf_dir, "lineitem").join(part, F.expr("l_partkey = p_partkey")).select((F.col("l_orderkey") * 10 + n).alias("id"), F.when(n == 5, "nothing").otherwise(F.col("name")).alias("name"), F.when(n != 4, F.col("l_quantity").cast("int")).alias("article"))
    statutes = part.groupBy("law").agg((F.min("p_size") == 1).alias("abolished"))
    articles = part.groupBy("law", F.col("p_size").alias("article")).agg(F.bool_and(F.col("p_partkey") % 2 == 0).alias("gone"))
    return D.statute_links(refs, part.select("name", "law"), statutes, articles)


@query(
    "decisions_taken",
    """SELECT o_orderkey, CASE WHEN c AND state = 'CANDIDATE' THEN 'ABOLISHED' WHEN NOT c AND state IS NOT NULL THEN NULL ELSE state END AS state, CASE WHEN c AND state = 'CANDIDATE' THEN since WHEN NOT c AND state IS NOT NULL THEN NULL ELSE ab END AS abolished_on,
    CASE WHEN c AND state IS DISTINCT FROM 'CANDIDATE' THEN 'not a candidate' WHEN NOT c AND state IS NULL THEN 'nothing to reject' END AS error
    FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'CANDIDATE' WHEN 'P' THEN 'ABOLISHED' END AS state, CAST(o_orderdate AS DATE) AS since, CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END AS ab, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c FROM orders)""",
)
def decisions_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger after people's decisions on candidates for abolition."""
    day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    ledger = table(spark, sf_dir, "orders").select("o_orderkey", F.when(status == "F", "CANDIDATE").when(status == "P", "ABOLISHED").alias("state"), day.alias("since"), F.when(status == "P", day).alias("abolished_on"))
    said = table(spark, sf_dir, "orders").filter("o_custkey % 3 < 2").select("o_orderkey", (F.col("o_custkey") % 3 == 0).alias("confirm"))
    return D.decide(ledger, said, "o_orderkey")


@query("queue_heads", "SELECT event_type, min(event_id) AS event_id, min_by(user_id, event_id) AS user_id, count(*) AS waiting FROM events WHERE value > 10 GROUP BY 1")
def queue_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next task of every queue, first in first out."""
    return table(spark, sf_dir, "events").filter("value > 10").groupBy("event_type").agg(F.min("event_id").alias("event_id"), F.min_by("user_id", "event_id").alias("user_id"), F.count("*").alias("waiting"))


@query(
    "quality_issues",
    """WITH v AS (SELECT o_orderkey AS version, CASE WHEN any_value(o_orderstatus) = 'P' THEN 'CONFLICT' WHEN any_value(o_custkey) % 50 = 0 THEN 'UNCERTAIN' ELSE 'OK' END AS status, list_distinct(list(CAST(l_quantity AS INT) % 6 + 1)) AS ns, CAST(sum(l_quantity) AS INT) AS chars, generate_series(1, any_value(o_custkey) % 4) AS toc FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    x AS (SELECT *, chars < 10 * len(ns) AS low, list_sort(list_filter(generate_series(1, list_max(ns)), lambda i: NOT list_contains(ns, i))) AS miss, list_sort(list_distinct(list_concat(list_filter(toc, lambda i: NOT list_contains(ns, i)), list_filter(ns, lambda i: NOT list_contains(toc, i))))) AS diff FROM v)
    SELECT version, 'CONFLICT' AS kind, status AS detail FROM x WHERE status = 'CONFLICT' UNION ALL SELECT version, 'EFFECTIVE_DATE', status FROM x WHERE status = 'UNCERTAIN' UNION ALL SELECT version, 'LOW_TEXT', CAST(len(ns) AS VARCHAR) FROM x WHERE low
    UNION ALL SELECT version, 'GAP', array_to_string(miss, ',') FROM x WHERE NOT low AND len(miss) > 0 UNION ALL SELECT version, 'TOC', array_to_string(diff, ',') FROM x WHERE NOT low AND len(toc) > 0 AND len(diff) > 0""",
)
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicting dates, gaps in numbering, contents that don't match, versions with hardly any text."""
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.expr("l_orderkey = o_orderkey"))
    v = d.groupBy(F.col("o_orderkey").alias("version")).agg(F.first("o_orderstatus").alias("s"), F.first("o_custkey").alias("c"), F.collect_set(F.col("l_quantity").cast("int") % 6 + 1).alias("numbers"), F.sum("l_quantity").cast("int").alias("chars"))
    toc = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda x: x <= F.col("c") % 4)
    status = F.when(F.col("s") == "P", "CONFLICT").when(F.col("c") % 50 == 0, "UNCERTAIN").otherwise("OK")
    return D.quality_issues(v.select("version", status.alias("status"), "numbers", "chars", toc.alias("toc")))


PROVISIONS_SQL = """pr AS (SELECT DISTINCT l_orderkey AS version, 'Work ' || l_orderkey AS title, 'c' || (CASE WHEN l_linenumber < 3 THEN 1 ELSE 2 END) AS path, NULL AS parent, 'chapter' AS unit, 'Chapter ' || (CASE WHEN l_linenumber < 3 THEN 1 ELSE 2 END) AS label, 'Rules' AS heading, '' AS text FROM lineitem
UNION ALL SELECT l_orderkey, 'Work ' || l_orderkey, 'a' || l_linenumber, 'c' || (CASE WHEN l_linenumber < 3 THEN 1 ELSE 2 END), 'article', 'Article ' || l_linenumber, l_returnflag, repeat(l_partkey || ' ', CAST(l_quantity AS INT) % 20) FROM lineitem
UNION ALL SELECT l_orderkey, 'Work ' || l_orderkey, 'a' || l_linenumber || '.p1', 'a' || l_linenumber, 'paragraph', 'paragraph 1', NULL, 'p' || l_suppkey FROM lineitem)"""


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, articles and paragraphs from order lines."""
    line = table(spark, sf_dir, "lineitem")
    n, work = F.col("l_linenumber").cast("string"), F.concat(F.lit("Work "), F.col("l_orderkey").cast("string"))
    chapter = F.when(F.col("l_linenumber") < 3, "1").otherwise("2")
    none = F.lit(None).cast("string")
    row = lambda path, parent, unit, label, heading, text: line.select(F.col("l_orderkey").alias("version"), work.alias("title"), path.alias("path"), parent.alias("parent"), F.lit(unit).alias("unit"), label.alias("label"), heading.alias("heading"), text.alias("text"))
    c = row(F.concat(F.lit("c"), chapter), none, "chapter", F.concat(F.lit("Chapter "), chapter), F.lit("Rules"), F.lit("")).distinct()
    a = row(F.concat(F.lit("a"), n), F.concat(F.lit("c"), chapter), "article", F.concat(F.lit("Article "), n), F.col("l_returnflag"), F.repeat(F.concat(F.col("l_partkey").cast("string"), F.lit(" ")), F.col("l_quantity").cast("int") % 20))
    p = row(F.concat(F.lit("a"), n, F.lit(".p1")), F.concat(F.lit("a"), n), "paragraph", F.lit("paragraph 1"), none, F.concat(F.lit("p"), F.col("l_suppkey").cast("string")))
    return c.unionByName(a).unionByName(p)


@query(
    "unit_documents",
    f"""WITH {PROVISIONS_SQL}, d AS (SELECT p.*, x.label AS l1, x.unit AS u1, x.heading AS h1, y.label AS l2, y.unit AS u2, y.heading AS h2 FROM pr p LEFT JOIN pr x ON x.version = p.version AND x.path = p.parent LEFT JOIN pr y ON y.version = p.version AND y.path = x.parent WHERE p.unit <> 'chapter'),
    e AS (SELECT *, unnest(CASE WHEN length(text) <= 30 THEN [0] ELSE generate_series(1, CAST(ceil(length(text) / 30.0) AS BIGINT)) END) AS w FROM d)
    SELECT version, path, concat_ws(' ', title, CASE WHEN u2 <> 'chapter' THEN l2 END, CASE WHEN u1 <> 'chapter' THEN l1 END, label) AS full_label, concat_ws(' > ', title, nullif(concat_ws(' ', l2, h2), ''), nullif(concat_ws(' ', l1, h1), ''), concat_ws(' ', label, heading)) AS breadcrumb, w AS "window", CASE WHEN w = 0 THEN text ELSE substr(text, (w - 1) * 30 + 1, 30) END AS text FROM e""",
)
def unit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search indexes: a document per provision with its labels, long ones in windows."""
    return D.unit_documents(provisions(spark, sf_dir), 30)


@query(
    "article_chunks",
    f"""WITH {PROVISIONS_SQL}, d AS (SELECT *, split_part(path, '.', 1) AS a, sum(length(text) + 1) OVER (PARTITION BY version, split_part(path, '.', 1)) AS n FROM pr WHERE unit <> 'chapter')
    SELECT version, a AS path, string_agg(text, chr(10) ORDER BY path, text) AS text FROM d WHERE n <= 40 GROUP BY version, a UNION ALL SELECT version, path, text FROM d WHERE n > 40""",
)
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as chunks with all below them, or by paragraph where they are long."""
    return D.article_chunks(provisions(spark, sf_dir), 40)


@query("purpose_clauses", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '이 규정은 에 따라 ' || p_type || '을 정함을 목적으로 한다.' END AS purpose FROM part")
def purpose_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What purpose clauses say without the statutes that they cite."""
    t = F.concat(F.when(F.col("p_partkey") % 4 == 0, "제2조(정의) ").otherwise("제1조(목적) "), F.lit("이 규정은 「"), "p_name", F.lit("법」 제3조에 따라 "), "p_type", F.lit("을 정함을 목적으로 한다.\n제2조"))
    return table(spark, sf_dir, "part").select("p_partkey", W.purpose(t).alias("purpose"))


@query(
    "item_matches",
    r"""WITH it AS (SELECT p_type AS item, p_type AS label, min(p_name) AS extra FROM part GROUP BY 1), ib AS (SELECT DISTINCT item, substr(t, i, 2) AS b, w FROM (SELECT item, lower(regexp_replace(v, '\s', '', 'g')) AS t, w, unnest(generate_series(1, greatest(length(lower(regexp_replace(v, '\s', '', 'g'))) - 1, 1))) AS i FROM (SELECT item, label AS v, 2 AS w FROM it UNION ALL SELECT item, extra, 1 FROM it))),
    qb AS (SELECT DISTINCT q, substr(t, i, 2) AS b FROM (SELECT item_id AS q, lower(regexp_replace(text, '\s', '', 'g')) AS t, unnest(generate_series(1, greatest(length(lower(regexp_replace(text, '\s', '', 'g'))) - 1, 1))) AS i FROM benchmark)),
    s AS (SELECT q, item, CAST(sum(w) AS BIGINT) AS score FROM qb JOIN ib USING (b) GROUP BY ALL HAVING count(*) FILTER (WHERE w = 2) >= 2), r AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY q, score) AS same FROM s) SELECT q, item, score FROM r WHERE k = 1 AND same = 1""",
)
def item_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison item that a question is about, if one leads alone."""
    items = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("item")).agg(F.min("p_name").alias("extra")).withColumn("label", F.col("item"))
    return D.match_items(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text"), items)


@query(
    "answer_checks",
    r"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN doc_id + 10000000 ELSE doc_id END AS cited, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END || substr(text, 5, 40) AS quote, 'Within ' || doc_id % 9 || ' or 2 days' AS claim FROM documents JOIN labels USING (doc_id))
    SELECT a.doc_id, d.doc_id IS NOT NULL AS cited_exists, coalesce(contains(regexp_replace(d.text, '\s', '', 'g'), regexp_replace(quote, '\s', '', 'g')), false) AS quoted, list_sort(list_distinct(list_filter(regexp_extract_all(claim, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(coalesce(d.text, ''), '[0-9]+'), x)))) AS unsupported FROM a LEFT JOIN documents d ON d.doc_id = cited""",
)
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against their evidence: the source exists, the quote stands in it (white space aside), its numbers do too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    quote = F.concat(F.when(k % 3 == 0, "x").otherwise(""), F.substring("text", 5, 40))
    a = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", F.when(k % 7 == 0, k + 10_000_000).otherwise(k).alias("cited"), quote.alias("quote"), F.concat(F.lit("Within "), (k % 9).cast("string"), F.lit(" or 2 days")).alias("claim"))
    e = a.join(d.select(k.alias("cited"), F.col("text").alias("evidence")), "cited", "left")
    bare = lambda c: F.regexp_replace(c, "\\s", "")
    return e.select("doc_id", F.col("evidence").isNotNull().alias("cited_exists"), F.coalesce(F.contains(bare("evidence"), bare("quote")), F.lit(False)).alias("quoted"), W.unsupported_numbers(F.col("claim"), F.col("evidence")).alias("unsupported"))


@query(
    "backtest",
    """WITH v AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_orderstatus = 'P' AS pending, min(o_orderdate) OVER (PARTITION BY o_custkey) < o_orderdate AS later FROM orders),
    i AS (SELECT v.o_orderkey, l_suppkey, CASE WHEN l_linenumber IN (2, 3, 4) THEN 'HIGH' WHEN l_linenumber = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM v JOIN lineitem ON l_orderkey = o_orderkey WHERE later AND NOT pending)
    SELECT severity, count(*) AS impacts, count(DISTINCT o_orderkey) AS versions, count(DISTINCT l_suppkey) AS affected FROM i GROUP BY 1""",
)
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions that follow another and wait for no notice, replayed at once: impacts by severity."""
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    v = table(spark, sf_dir, "orders").withColumn("first", first).filter("first < o_orderdate AND o_orderstatus <> 'P'").select("o_orderkey")
    n = F.col("l_linenumber")
    i = table(spark, sf_dir, "lineitem").join(v, F.expr("l_orderkey = o_orderkey")).withColumn("severity", F.when(n.isin(2, 3, 4), "HIGH").when(n == 1, "MEDIUM").otherwise("LOW"))
    return i.groupBy("severity").agg(F.count("*").alias("impacts"), F.countDistinct("o_orderkey").alias("versions"), F.countDistinct("l_suppkey").alias("affected"))


@query(
    "side_by_side",
    """WITH c AS (SELECT l_suppkey AS owner, l_partkey AS path, max_by('Part ' || l_partkey || ' in ' || CAST(l_quantity AS INT) || ' pieces', (l_shipdate, l_orderkey, l_linenumber)) AS text FROM lineitem GROUP BY ALL), q AS (SELECT l_suppkey AS owner, l_partkey AS path, min(CAST(l_quantity AS INT)) || ' pieces' AS value FROM lineitem GROUP BY ALL)
    SELECT owner, path, CASE WHEN contains(text, value) THEN replace(text, value, '<mark>' || value || '</mark>') ELSE text END AS shown, contains(text, value) AS found FROM q JOIN c USING (owner, path)""",
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values in the current text of their provision, marked where they still stand."""
    line = table(spark, sf_dir, "lineitem").withColumn("pieces", F.col("l_quantity").cast("int").cast("string"))
    text = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" in "), "pieces", F.lit(" pieces"))
    now = line.groupBy(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("path")).agg(F.max_by(text, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("text"), F.concat(F.min(F.col("l_quantity").cast("int")).cast("string"), F.lit(" pieces")).alias("value"))
    found = F.contains("text", "value")
    return now.select("owner", "path", F.when(found, F.replace("text", "value", F.concat(F.lit("<mark>"), "value", F.lit("</mark>")))).otherwise(F.col("text")).alias("shown"), found.alias("found"))


@query(
    "review_tasks",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'The reference has no target' WHEN 'signup' THEN 'The date is uncertain' ELSE 'Look at the change' END AS problem, coalesce(c_name, 'unknown') AS place, '/review/' || event_id || CASE WHEN c_custkey IS NULL THEN '' ELSE '?work=' || c_custkey END AS link
    FROM events LEFT JOIN customer ON c_custkey = user_id WHERE value > 5""",
)
def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with what is wrong, where, and a link."""
    t = F.col("event_type")
    d = table(spark, sf_dir, "events").filter("value > 5").join(table(spark, sf_dir, "customer"), F.expr("c_custkey = user_id"), "left")
    problem = F.when(t == "error", "The reference has no target").when(t == "signup", "The date is uncertain").otherwise("Look at the change")
    link = F.concat(F.lit("/review/"), F.col("event_id").cast("string"), F.when(F.col("c_custkey").isNull(), "").otherwise(F.concat(F.lit("?work="), F.col("c_custkey").cast("string"))))
    return d.select("event_id", problem.alias("problem"), F.coalesce("c_name", F.lit("unknown")).alias("place"), link.alias("link"))
