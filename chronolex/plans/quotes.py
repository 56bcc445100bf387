"""Quotes that are nearly word for word: parts described with slips, passages of the benchmark quoted with slips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import alignment as A
from chronolex.operators import answers as V
from chronolex.operators import names as N
from chronolex.plans.catalog import query, table


@query(
    "quote_alignment",
    r"""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type || ' from ' || p_brand || ', ' || p_size || ' pieces' AS text,
      substr(p_name, 1, 2) || substr(p_name, 4) || ' ' || p_type || ' frum ' || p_brand || ', ' || (p_size + p_partkey % 2) || ' p' AS quote FROM part),
    b AS (SELECT *, regexp_replace(text, '\s', '', 'g') AS t, regexp_replace(quote, '\s', '', 'g') AS q, list_filter(range(1, length(text) + 1), lambda i: text[i] <> ' ') AS at FROM p),
    n AS (SELECT *, CAST(floor(length(q) * 0.1 + 1e-9) AS INT) AS d FROM b),
    s AS (SELECT *, unnest(range(1, length(t) + 1)) AS s FROM n), w AS (SELECT *, unnest(range(length(q) - d, length(q) + d + 1)) AS l FROM s),
    e AS (SELECT *, s + l - 1 AS e, levenshtein(q, substr(t, s, l)) AS edits FROM w WHERE s + l - 1 <= length(t)),
    k AS (SELECT * FROM e WHERE edits <= d QUALIFY row_number() OVER (PARTITION BY p_partkey, e ORDER BY edits, s DESC) = 1),
    f AS (SELECT * FROM k WHERE regexp_extract_all(substr(t, s, l), '[0-9]+') = regexp_extract_all(q, '[0-9]+')
      AND NOT regexp_full_match(substr(t, s - 1, 2), '[0-9]{2}') AND NOT regexp_full_match(substr(t, e, 2), '[0-9]{2}') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY edits, e) = 1)
    SELECT p.p_partkey, CAST(f.at[f.s] - 1 AS INT) AS start, CAST(f.at[f.e] AS INT) AS "end", CAST(f.edits AS INT) AS edits, substr(p.text, f.at[f.s], f.at[f.e] - f.at[f.s] + 1) AS piece FROM p LEFT JOIN f USING (p_partkey)""",
)
def quote_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts described with two slips; every other description has another number of pieces and so is no quote."""
    s = lambda c: F.col(c).cast("string")
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit(" from "), "p_brand", F.lit(", "), s("p_size"), F.lit(" pieces"))
    pieces = (F.col("p_size") + F.col("p_partkey") % 2).cast("string")
    quote = F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"), F.lit(" "), "p_type", F.lit(" frum "), "p_brand", F.lit(", "), pieces, F.lit(" p"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), quote.alias("quote"))
    return A.aligned(pairs, "quote", "text").drop("text", "quote")


@query("quotes_found")
def quotes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a passage of the benchmark that is quoted with two slips, whatever document it is from; held against plain search in the tests."""
    quote = F.concat(F.substring("text", 1, 9), F.substring("text", 11, 19), F.lit("q"), F.substring("text", 31, 30))
    items = table(spark, sf_dir, "benchmark").select("item_id", quote.alias("quote"))
    return A.found_quotes(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "quote")


@query(
    "names_in_texts",
    """WITH l AS (SELECT l_orderkey, row_number() OVER w AS k, CASE row_number() OVER w % 3 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN replace(p_name, ' ', '') ELSE 'Maker ' || p_name END AS name,
      replace(CASE row_number() OVER w % 3 WHEN 0 THEN p_name || p_type ELSE p_name END, ' ', '') AS key
      FROM lineitem JOIN part ON p_partkey = l_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
    s AS (SELECT *, sum(length('; see ' || name || ' x')) OVER (PARTITION BY l_orderkey ORDER BY k) - length(name) - 2 AS start FROM l),
    t AS (SELECT replace(lower(title), ' ', '') AS key, count(DISTINCT title) AS works, min(title) AS title FROM (SELECT DISTINCT p_name AS title FROM part UNION SELECT DISTINCT p_name || ' ' || p_type FROM part) GROUP BY 1)
    SELECT l_orderkey, CAST(start AS INT) AS start, CAST(start + length(name) AS INT) AS "end", name, works, CASE WHEN works = 1 THEN t.title END AS work FROM s LEFT JOIN t ON t.key = lower(s.key)""",
)
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a text that names their parts: in two words, in one, with the kind or the maker beside; the longest name counts."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    named = F.array("p_name", F.concat_ws(" ", "p_name", "p_type"))
    titles = part.select(F.explode(named).alias("title")).distinct()
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem").join(part, "l_partkey").withColumn("k", F.row_number().over(place))
    said = F.when(F.col("k") % 3 == 0, named[1]).when(F.col("k") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("Maker "), "p_name"))
    said = F.concat(F.lit("; see "), said, F.lit(" x"))
    texts = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", said.alias("s")))), lambda x: x["s"]), "").alias("text"))
    keys = N.keys_of(titles.withColumn("work", F.col("title")), "work", "title")
    hits = N.names_in(texts, "l_orderkey", "text", keys, prefixes=["Maker"])
    return hits.join(keys, "key").select("l_orderkey", "start", "end", "name", "works", "work")


_UNITS = "주일|개월|만원|천원|원|일|주|월|년|회|시간|%|조|항|호"
_QTY = lambda t: f"list_distinct(list_transform(list_zip(regexp_extract_all({t}, '([0-9]+(?:\\.[0-9]+)?)\\s*({_UNITS})?', 1), regexp_extract_all({t}, '([0-9]+(?:\\.[0-9]+)?)\\s*({_UNITS})?', 2)), lambda x: x[1] || CASE WHEN x[2] = '주일' THEN '주' ELSE x[2] END))"
_LIMITS = lambda t: f"list_transform(list_zip(regexp_extract_all({t}, '([0-9]+)\\s*(주일|개월|일|주|월)\\s*이내', 1), regexp_extract_all({t}, '([0-9]+)\\s*(주일|개월|일|주|월)\\s*이내', 2)), lambda x: x[1] || CASE WHEN x[2] = '주일' THEN '주' ELSE x[2] END)"

VERIFIED_SQL = rf"""WITH l AS (SELECT l_orderkey AS answer, l_linenumber AS id, CAST(min(l_quantity) AS INT) % 30 + 1 AS n, min(l_partkey) % 50 AS money, ['일', '주일', '개월'][l_linenumber % 3 + 1] AS u FROM lineitem GROUP BY ALL),
ev AS (SELECT *, '규정' AS title, '제' || id || '조' AS label, '신청은 사유가 생긴 날부터 ' || n || u || ' 이내에 ' || money || '만원 범위에서 하여야 한다.' AS text FROM l),
ci AS (SELECT answer, id, CASE WHEN (answer + id) % 5 = 0 THEN '어디에도 나오지 아니하는 문장' ELSE left(text, 19) END AS quote, (answer + id) % 5 <> 0 AS good FROM ev WHERE id <= 3 UNION ALL SELECT o_orderkey, 99, '신청은 사유가 생긴 날부터', false FROM orders WHERE o_orderkey % 11 = 0),
g AS (SELECT ci.answer, count(*) AS cites, bool_and(ev.id IS NOT NULL) AS exist, count(*) FILTER (good) AS good, string_agg(title || ' ' || label || ' ' || text, chr(10)) FILTER (good) AS gt, string_agg(title || ' ' || label || ' ' || text, chr(10)) AS whole FROM ci LEFT JOIN ev USING (answer, id) GROUP BY ALL),
an AS (SELECT o_orderkey AS answer, ['충족', '미충족', '조건부'][o_orderkey % 3 + 1] AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN '신청한 지 ' || o_custkey % 40 || '일' ELSE '' END AS question,
  coalesce('제' || f.id || '조의 기한은 ' || (f.n + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) || f.u || ' 이내이고 ', '') || o_custkey % 40 || '일이 지났습니다.' || ['', ' 기한을  넘겼습니다.', ' 문제가없습니다.', ' 기한 안입니다.'][o_orderkey % 4 + 1] AS expl FROM orders LEFT JOIN (SELECT answer, min(id) AS id, arg_min(n, id) AS n, arg_min(u, id) AS u FROM l GROUP BY answer) f ON f.answer = o_orderkey),
d AS (SELECT an.*, coalesce(exist, false) AS exist, CASE WHEN exist THEN good ELSE 0 END AS held, coalesce(cites, 0) AS cites, coalesce(CASE WHEN exist AND good > 0 THEN gt ELSE whole END, '') AS t FROM an LEFT JOIN g USING (answer)),
x AS (SELECT *, {_QTY("expl")} AS said, {_QTY("t")} AS shown, {_LIMITS("expl")} AS sl, {_LIMITS("t")} AS tl, regexp_extract_all(question, '[0-9]+') AS fq FROM d),
y AS (SELECT *, list_concat(fq, list_transform(list_filter(tl, lambda z: ends_with(z, '일')), lambda z: regexp_extract(z, '[0-9]+')), list_transform(list_filter(tl, lambda z: ends_with(z, '주')), lambda z: CAST(CAST(regexp_extract(z, '[0-9]+') AS INT) * 7 AS VARCHAR)), list_transform(list_filter(tl, lambda z: ends_with(z, '개월')), lambda z: CAST(CAST(regexp_extract(z, '[0-9]+') AS INT) * 28 AS VARCHAR)), list_transform(list_filter(tl, lambda z: ends_with(z, '개월')), lambda z: CAST(CAST(regexp_extract(z, '[0-9]+') AS INT) * 31 AS VARCHAR))) AS free FROM x),
c AS (SELECT answer, exist AS citations_exist, held > 0 AS quotes_match,
  len(list_filter(said, lambda z: NOT (list_contains(free, regexp_extract(z, '[0-9.]+')) OR list_contains(shown, z) OR (regexp_matches(z, '^[0-9.]+[조항호]?$') AND list_contains(list_transform(shown, lambda s: regexp_extract(s, '[0-9.]+')), regexp_extract(z, '[0-9.]+')))))) = 0
  AND len(list_filter(sl, lambda z: NOT (list_contains(tl, z) OR list_contains(list_transform(list_filter(tl, lambda s: ends_with(s, '주')), lambda s: CAST(CAST(regexp_extract(s, '[0-9]+') AS INT) * 7 AS VARCHAR) || '일'), z)))) = 0 AS numbers_match,
  NOT ((verdict = '충족' AND regexp_matches(expl, '기한을\s*넘')) OR (verdict = '미충족' AND regexp_matches(expl, '문제가\s*없|기한\s*안입니다'))) AS consistent, cites - held AS dropped FROM y)
SELECT *, array_to_string(list_filter([CASE WHEN NOT citations_exist THEN 'citation' END, CASE WHEN NOT quotes_match THEN 'quote' END, CASE WHEN NOT numbers_match THEN 'number' END, CASE WHEN NOT consistent THEN 'consistency' END], lambda z: z IS NOT NULL), ',') AS problems FROM c"""


@query("answers_verified", VERIFIED_SQL)
def answers_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each order that cites the order's lines as provisions: some sources, quotes, numbers, limits and verdicts are wrong."""
    s = lambda c: c.cast("string")
    key, k = F.col("o_orderkey"), F.col("id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("일", "주일", "개월")]), k % 3 + 1)
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("id"))
    line = line.agg((F.min("l_quantity").cast("int") % 30 + 1).alias("n"), (F.min("l_partkey") % 50).alias("money")).withColumn("u", unit)
    text = F.concat(F.lit("신청은 사유가 생긴 날부터 "), s(F.col("n")), "u", F.lit(" 이내에 "), s(F.col("money")), F.lit("만원 범위에서 하여야 한다."))
    evidence = line.select("answer", "id", F.lit("규정").alias("title"), F.concat(F.lit("제"), s(k), F.lit("조")).alias("label"), text.alias("text"))
    quote = F.when((F.col("answer") + k) % 5 == 0, "어디에도 나오지 아니하는 문장").otherwise(F.left("text", F.lit(19)))
    orders = table(spark, sf_dir, "orders")
    absent = orders.filter(key % 11 == 0).select(key.alias("answer"), F.lit(99).alias("id"), F.lit("신청은 사유가 생긴 날부터").alias("quote"))
    cites = evidence.filter("id <= 3").select("answer", "id", quote.alias("quote")).unionByName(absent)
    first = line.groupBy("answer").agg(F.min(F.struct("id", "n", "u")).alias("f"))
    d = orders.withColumn("answer", key).join(first, "answer", "left")
    days = F.concat(s(F.col("o_custkey") % 40), F.lit("일"))
    limit = F.concat(F.lit("제"), s(F.col("f.id")), F.lit("조의 기한은 "), s(F.col("f.n") + F.when(key % 6 == 0, 1).otherwise(0)), F.col("f.u"), F.lit(" 이내이고 "))
    end = F.element_at(F.array(*[F.lit(x) for x in ("", " 기한을  넘겼습니다.", " 문제가없습니다.", " 기한 안입니다.")]), (key % 4 + 1).cast("int"))
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("충족", "미충족", "조건부")]), (key % 3 + 1).cast("int"))
    question = F.when(key % 2 == 0, F.concat(F.lit("신청한 지 "), days)).otherwise("")
    answers = d.select("answer", question.alias("question"), verdict.alias("verdict"), F.concat(F.coalesce(limit, F.lit("")), days, F.lit("이 지났습니다."), end).alias("explanation"), F.lit(None).cast("array<string>").alias("allowed"))
    return V.verified(answers, cites, evidence).withColumn("problems", F.array_join("problems", ","))
