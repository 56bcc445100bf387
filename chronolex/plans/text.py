"""Text queries: cleaning, masking, windows, defects, lexicons, page structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions import dates as T
from chronolex.functions import highlights as H
from chronolex.functions import text as X
from chronolex.operators.retrieval import small_side
from chronolex.plans.catalog import query, table


@query(
    "clean_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g'), '[ \t\x{00a0}\x{3000}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10) || chr(9))) AS digest FROM documents""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean(F.col("text"))).alias("digest"))


@query("squash_key", r"SELECT md5(regexp_replace(text, '[\s·ㆍ・•‧∙⋅]', '', 'g')) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def squash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for white space and middle dots."""
    d = table(spark, sf_dir, "documents").groupBy(F.md5(X.name_key(F.col("text"))).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return d.filter("n > 1")


@query(
    "mask_personal_data",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}', '[PHONE]', 'g'),
    '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[IP]', 'g'), '\b[0-9]{16}\b', '[CARD]', 'g')) AS digest FROM documents""",
)
def mask_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.mask_personal(F.col("text"))).alias("digest"))


@query(
    "collapse_repeats",
    None,
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back references are not in the SQL dialect of the comparison; tests hold this against Python's re."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapse_repeats(F.col("text"))).alias("digest"))


@query(
    "despace_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '^(?:\S ){3,}\S$')) AS spelt FROM l GROUP BY doc_id""",
)
def despace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: X.despace(x) != x)).cast("long").alias("spelt"))


@query(
    "defect_metrics",
    r"""SELECT source, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200d}\x{2060}\x{feff}]'))) AS BIGINT) AS controls, CAST(sum(len(regexp_extract_all(text, '\x{fffd}'))) AS BIGINT) AS replacements,
    CAST(sum(len(regexp_extract_all(text, '[\x{e000}-\x{f8ff}]'))) AS BIGINT) AS private_use, CAST(sum(len(regexp_extract_all(text, '(?m)^[ \t]*-? ?[0-9]{1,4} ?-?[ \t]*$'))) AS BIGINT) AS page_numbers FROM documents GROUP BY source""",
)
def defect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.defects(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), *[F.sum(d[k]).alias(k) for k in ("controls", "replacements", "private_use", "page_numbers")])


@query(
    "window_splitter",
    """WITH h AS (SELECT doc_id, source || ' ' || lang AS head, text, 1200 - length(source || ' ' || lang) - 1 AS room FROM documents),
    w AS (SELECT doc_id, head, text, room, unnest(CASE WHEN length(text) <= room THEN [0] ELSE generate_series(1, CAST(ceil(length(text) / room) AS BIGINT)) END) AS no FROM h)
    SELECT doc_id, CAST(no AS INTEGER) AS no, CASE WHEN no = 0 THEN md5(text) ELSE md5(substr(text, (no - 1) * room + 1, room)) END AS digest FROM w""",
)
def window_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts in pieces that fit with their head."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("head"))
    return d.select("doc_id", F.inline(X.windows(F.col("head"), F.col("text")))).select("doc_id", "no", F.md5("piece").alias("digest"))


@query(
    "running_lines",
    r"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT source, doc_id, regexp_replace(regexp_replace(line, '\s', '', 'g'), '[0-9]', '#', 'g') AS key FROM l),
    t AS (SELECT source, count(*) AS docs FROM documents GROUP BY source), c AS (SELECT source, key, count(DISTINCT doc_id) AS n FROM k WHERE key <> '' GROUP BY ALL)
    SELECT source, md5(key) AS key, n FROM c JOIN t USING (source) WHERE n >= 3 AND n * 100 >= docs * 3""",
)
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur through a source, digits and blanks aside: headers and footers. Lines are distinct within a document before they are shuffled."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    key = lambda x: F.regexp_replace(F.regexp_replace(x, "\\s", ""), "[0-9]", "#")
    keys = docs.select("source", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), key))).alias("line")).filter("line <> ''")
    n = keys.groupBy("source", F.md5("line").alias("key")).agg(F.count("*").alias("n")).filter("n >= 3")
    total = docs.groupBy("source").agg(F.count("*").alias("docs"))
    return n.join(small_side(total, 100_000), "source").filter("n * 100 >= docs * 3").select("source", "key", "n")


@query(
    "word_lexicon",
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿß]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 20""",
)
def word_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their counts over all texts, from twenty on; counts combine before the shuffle."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿß]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 20")


@query(
    "snippet_around_match",
    """WITH d AS (SELECT doc_id, text, position('licensed' IN lower(text)) AS pos FROM documents) SELECT doc_id, CASE WHEN greatest(pos - 40, 1) > 1 THEN '…' ELSE '' END || substr(text, greatest(pos - 40, 1), pos + 8 + 40 - greatest(pos - 40, 1)) || CASE WHEN pos + 48 <= length(text) THEN '…' ELSE '' END AS snippet FROM d WHERE pos > 0""",
)
def snippet_around_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("Licensed")).alias("snippet"))
    return d.filter("snippet IS NOT NULL")


@query(
    "path_numbers",
    r"""WITH p AS (SELECT DISTINCT 'a' || l_suppkey || CASE WHEN l_linenumber > 4 THEN '-' || l_linenumber ELSE '' END || '.p' || CAST(l_quantity AS INTEGER) AS path FROM lineitem)
    SELECT path, TRY_CAST(regexp_extract(path, '^a([0-9]+)', 1) AS INTEGER) AS article, TRY_CAST(regexp_extract(path, '^a[0-9]+-([0-9]+)', 1) AS INTEGER) AS branch, TRY_CAST(regexp_extract(path, '\.p([0-9]+)', 1) AS INTEGER) AS paragraph FROM p""",
)
def path_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = F.when(F.col("l_linenumber") > 4, F.concat(F.lit("-"), F.col("l_linenumber"))).otherwise("")
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), "l_suppkey", branch, F.lit(".p"), F.col("l_quantity").cast("int")).alias("path")).distinct()
    n = p.select("path", X.numbers_of(F.col("path")).alias("n"))
    return n.select("path", "n.article", "n.branch", "n.paragraph")


@query(
    "url_hosts",
    r"""SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^(www|m)\.', '') AS host, count(*) AS n, count(*) FILTER (WHERE starts_with(url, 'https:')) AS secure FROM pages GROUP BY 1""",
)
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(X.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").startswith("https:")).alias("secure"))


@query(
    "html_plain_text",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""",
)
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup, scripts, styles and comments off, blanks to one."""
    t = F.col("html")
    for pattern in ("(?is)<(script|style)\\b[^>]*>.*?</(script|style)>", "(?s)<!--.*?-->", "<[^>]*>"):
        t = F.regexp_replace(t, pattern, " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.btrim(F.regexp_replace(t, "\\s+", " "))).alias("digest"))


@query(
    "html_allowed_tags",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(html|head|meta|body|nav|footer|div|a|title|article|!doctype)\b[^>]*>', '', 'g')) AS digest FROM pages""",
)
def html_allowed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the allowed tags stay; scripts and styles go with their content."""
    t = F.col("html")
    for pattern in ("(?is)<(script|style)\\b[^>]*>.*?</(script|style)>", "(?s)<!--.*?-->", "(?i)</?(html|head|meta|body|nav|footer|div|a|title|article|!doctype)\\b[^>]*>"):
        t = F.regexp_replace(t, pattern, "")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("digest"))


@query(
    "dotted_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders""",
)
def dotted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways are read back."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    d = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy. M. d.")).when(k == 1, F.date_format(d, "''yy.M.d")).when(k == 2, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.select("o_orderkey", T.dotted_date(text).alias("parsed"))


@query(
    "time_spans",
    """SELECT o_orderkey, CAST((o_orderkey % 5) * 7 + o_orderkey % 3 AS INTEGER) AS days FROM orders""",
)
def time_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat((k % 5).cast("string"), F.lit(" weeks "), (k % 3).cast("string"), F.lit(" days"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.span_days(text).alias("days"))


@query(
    "money_in_words",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR (o_custkey % 9) * 1000000 + (o_orderkey % 11) * 1000 = 0 THEN NULL ELSE (o_custkey % 9) * 1000000 + (o_orderkey % 11) * 1000 END AS amount FROM orders""",
)
def money_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(" million "), (F.col("o_orderkey") % 11).cast("string"), F.lit(" thousand"), F.when(F.col("o_orderkey") % 7 == 0, " €").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.sum_of_money(text).alias("amount"))


@query(
    "turn_pairs",
    """WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS asked_by, lag(md5(text)) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, asked, md5(text) AS answer FROM t WHERE role = 'assistant' AND asked_by = 'user'""",
)
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("asked_by", F.lag("role").over(w)).withColumn("asked", F.lag(F.md5("text")).over(w))
    return t.filter("role = 'assistant' AND asked_by = 'user'").select("conv_id", "turn", "asked", F.md5("text").alias("answer"))


@query(
    "followup_context",
    """SELECT conv_id, turn, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS context, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS messages FROM conversations""",
)
def followup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to six messages before each one, as its context."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    line = F.concat(F.col("role"), F.lit(":"), F.col("text"))
    d = table(spark, sf_dir, "conversations").withColumn("before", F.collect_list(line).over(w))
    return d.select("conv_id", "turn", F.when(F.size("before") > 0, F.md5(F.array_join("before", "\n"))).alias("context"), F.size("before").cast("long").alias("messages"))


SHOWN = ["the", "license", "version", "and", "that", "with", "data"]


@query(
    "highlight_window",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿß]+') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM d),
    h AS (SELECT * FROM w WHERE word IN ({", ".join(f"'{t}'" for t in SHOWN)})),
    c AS (SELECT a.doc_id, a.place AS first, b.place AS last, (SELECT count(DISTINCT x.word) FROM h x WHERE x.doc_id = a.doc_id AND x.place BETWEEN a.place AND b.place) AS covered FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.place BETWEEN a.place AND a.place + 11)
    SELECT c.doc_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last, CAST(covered AS INT) AS covered, (SELECT count(*) FROM h x WHERE x.doc_id = c.doc_id AND x.place BETWEEN first AND last) AS marks FROM c QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY covered DESC, last - first, first) = 1""",
)
def highlight_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve words of each document that show the most of seven asked ones."""
    asked = F.array(*map(F.lit, SHOWN))
    d = table(spark, sf_dir, "documents").select("doc_id", H.highlight_window(F.col("text"), asked, 12).alias("w")).filter("w.first IS NOT NULL")
    return d.select("doc_id", "w.first", "w.last", "w.covered", F.size("w.spans").cast("long").alias("marks"))
