"""Retrieval queries: benchmark items ask, documents and vectors answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.operators import analyzer as N
from chronolex.operators import clusters as V
from chronolex.operators import keywords as K
from chronolex.operators import orchestration as O
from chronolex.operators import postings as P
from chronolex.operators import retrieval as R
from chronolex.plans.catalog import query, table
from chronolex.sources.storage import shared_folder

BM25_SQL = """
d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-zà-ÿß]+') AS t FROM documents), n AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿß]+')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score, count(*) AS matched
  FROM p JOIN q USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY item_id, doc_id),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 100)
"""
VECTOR_SQL = """
cv AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
  * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id CROSS JOIN embeddings b),
vs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cv) WHERE rank <= 100)
"""
FUSED_SQL = f"""{BM25_SQL}, {VECTOR_SQL},
nk AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM kw WINDOW w AS (PARTITION BY item_id)),
nv AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM vs WINDOW w AS (PARTITION BY item_id)),
fused AS (SELECT coalesce(nk.item_id, nv.item_id) AS item_id, coalesce(nk.doc_id, nv.doc_id) AS doc_id, round(coalesce(nk.s, 0::DOUBLE) * 0.4::DOUBLE + coalesce(nv.s, 0::DOUBLE) * 0.6::DOUBLE, 6) AS score FROM nk FULL JOIN nv ON nk.item_id = nv.item_id AND nk.doc_id = nv.doc_id)
"""


def keyword_hits(spark: SparkSession, sf_dir: str, n: int = R.CANDIDATES) -> DataFrame:
    return K.best_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", n, {"text": 1.0})


def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for documents with the same id; an item asks with the vector of its number."""
    e = table(spark, sf_dir, "embeddings")
    asks = e.join(R.small_side(table(spark, sf_dir, "benchmark").select(F.col("item_id")), R.BROADCAST_TERMS), F.expr("vec_id = item_id")).select("item_id", F.col("embedding").alias("asked"))
    return R.nearest(e.withColumnRenamed("vec_id", "doc_id"), asks, "item_id", "asked", "doc_id", "embedding", R.CANDIDATES)


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(keyword_hits(spark, sf_dir), vector_hits(spark, sf_dir), "item_id", "doc_id")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT item_id, doc_id, score, matched, rank FROM kw WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_hits(spark, sf_dir, 10)


@query("knn_exact", f"WITH {VECTOR_SQL} SELECT item_id, doc_id, score, rank FROM vs WHERE rank <= 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir).filter("rank <= 10")


@query("hybrid_fusion", f"WITH {FUSED_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 100")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(fused_hits(spark, sf_dir), "item_id", "score", "doc_id", R.CANDIDATES)


@query(
    "staged_topk",
    f"""WITH {FUSED_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 40),
    x AS (SELECT r.item_id, r.doc_id, r.score, coalesce(bm.matched, 0) AS again FROM r LEFT JOIN bm ON bm.item_id = r.item_id AND bm.doc_id = r.doc_id)
    SELECT item_id, doc_id, again, score, row_number() OVER (PARTITION BY item_id ORDER BY again DESC, score DESC, doc_id) AS place FROM x QUALIFY place <= 10""",
)
def staged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred candidates, the first forty of them ranked again (by matched terms, as a stand-in for a model), ten shown."""
    head = R.top(fused_hits(spark, sf_dir), "item_id", "score", "doc_id", R.RERANKED)
    items = table(spark, sf_dir, "benchmark")
    few = items.limit(R.BROADCAST_TERMS // R.RERANKED + 1).count() * R.RERANKED <= R.BROADCAST_TERMS
    asks = head.join(K.asked_terms(items, "item_id", "text"), "item_id", "left")
    words = table(spark, sf_dir, "documents").select("doc_id", R.tokens(F.col("text")).alias("words"))
    again = (F.broadcast(asks) if few else asks).join(words, "doc_id").withColumn("again", F.coalesce(F.size(F.array_intersect("words", "terms")), F.lit(0)).cast("long"))
    w = Window.partitionBy("item_id").orderBy(F.desc("again"), F.desc("score"), "doc_id")
    return again.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("item_id", "doc_id", "again", "score", "place")


@query(
    "group_max_order",
    f"""WITH {BM25_SQL}, g AS (SELECT item_id, source, max(score) AS best, count(*) AS members, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY score DESC, doc_id) AS all_ids FROM kw JOIN d USING (doc_id) GROUP BY ALL)
    SELECT item_id, source, best, members, array_to_string(string_split(all_ids, ',')[1:5], ',') AS shown, row_number() OVER (PARTITION BY item_id ORDER BY best DESC, source) AS place FROM g""",
)
def group_max_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keyword_hits(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return R.grouped(hits, "item_id", "source", "doc_id").withColumn("shown", F.array_join(F.col("shown").cast("array<string>"), ","))


@query(
    "min_should_match_facets",
    f"""WITH {BM25_SQL}, c AS (SELECT item_id, count(*) AS terms FROM q GROUP BY item_id)
    SELECT item_id, source, count(*) AS n FROM bm JOIN c USING (item_id) JOIN d USING (doc_id) WHERE matched >= CASE WHEN terms <= 2 THEN terms ELSE CAST(floor(terms * 0.75) AS INTEGER) END GROUP BY ALL""",
)
def min_should_match_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets over the documents that match enough of an item's terms, not over the shown hits."""
    return K.matching(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", "text", "text", "source")


@query("keyword_only_degraded", f"WITH {BM25_SQL} SELECT item_id, doc_id, rank, true AS degraded FROM kw WHERE rank <= 5")
def keyword_only_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without vectors the keyword order stands, and says so."""
    return keyword_hits(spark, sf_dir, 5).select("item_id", "doc_id", "rank", F.lit(True).alias("degraded"))


FIELDS_SQL = r"""WITH q AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿß]+'))) AS t FROM benchmark), qt AS (SELECT item_id, unnest(t) AS term FROM q),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿß]+') AS t0, regexp_extract_all(lower(lang), '[a-zà-ÿß]+') AS t2, regexp_extract_all(lower(source), '[a-zà-ÿß]+') AS t1 FROM documents),
l AS (SELECT doc_id, 0 AS f, t0 AS t FROM d UNION ALL SELECT doc_id, 1, t1 FROM d UNION ALL SELECT doc_id, 2, t2 FROM d), n AS (SELECT f, count(*) AS docs, avg(len(t)) AS avgdl FROM l GROUP BY f),
p AS (SELECT doc_id, f, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, f, len(t) AS dl, unnest(t) AS term FROM l) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), c AS (SELECT f, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT item_id, doc_id, f, sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS s FROM p JOIN qt USING (term) JOIN c USING (f, term) JOIN n USING (f) GROUP BY ALL),
g AS (SELECT item_id, doc_id, round(greatest(coalesce(max(s) FILTER (f = 0), 0), 3 * coalesce(max(s) FILTER (f = 1), 0)) + coalesce(max(s) FILTER (f = 2), 0), 6) AS score, bool_or(f < 2) AS hit FROM s GROUP BY ALL)
SELECT * EXCLUDE (hit), row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE hit QUALIFY rank <= 10"""


@query("bm25_fields", FIELDS_SQL)
def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the text and three times the source, with something more for the language."""
    hits = K.best_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 10, {"text": 1.0, "source": 3.0}, "lang")
    return hits.drop("matched")


def search_index(spark: SparkSession, sf_dir: str) -> P.Search:
    """An index written in two segments: French documents come with a stale text first, and anew."""
    root = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    stale = docs.withColumn("text", F.when(F.col("lang") == "fr", "stale license text").otherwise(F.col("text")))
    P.write_segment(stale, "doc_id", ["text", "source", "lang"], root, 0, order=["lang", "source"])
    P.write_segment(docs.filter("lang = 'fr'"), "doc_id", ["text", "source", "lang"], root, 1, order=["source"])
    return P.Search(P.read_index(spark, root, 2), table(spark, sf_dir, "benchmark"), "item_id", "text", 10, [1.0, 3.0, 1.0], bonus=True)


@query("indexed_bm25", FIELDS_SQL)
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``bm25_fields`` finds by a scan, from a written index that was changed since."""
    return search_index(spark, sf_dir).hits().withColumnRenamed("doc", "doc_id")


@query("index_blocks_read")
def index_blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of its terms each item has, and how many lie in buckets that could hold one of its ten best."""
    return search_index(spark, sf_dir).report()


@query(
    "compound_words",
    """SELECT p_partkey, string_split(p_name, ' ')[1] || ',' || string_split(p_name, ' ')[2] || ',' || lower(p_type) || ',' || 'zqzq' AS terms FROM part""",
)
def compound_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts written in one word with their kind: split by the words that names and kinds have; what no word covers stays."""
    part = table(spark, sf_dir, "part")
    words = N.lexicon(part.select(F.concat_ws(" ", "p_name", "p_type").alias("t")), "t")
    split = N.analyzer(words)
    joined = part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_type"), F.lit(" zqzq")).alias("t"))
    return joined.select("p_partkey", F.array_join(split(F.col("t")), ",").alias("terms"))


@query("analyzed_bm25")
def analyzed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits with rare words split and "license" and "licensed" asked as one; held against plain loops in the tests."""
    docs = table(spark, sf_dir, "documents")
    words = N.lexicon(docs, "text")
    asks = N.analyzer(words, synonyms=[("license", "licensed"), ("version", "release")])
    return K.best_hits(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 10, {"text": 1.0}, tokenizer=N.analyzer(words), ask_tokenizer=asks)


@query("highlight_terms", r"SELECT doc_id, md5(regexp_replace(text, '(?i)\b(licensed|license|version)\b', '<mark>\1</mark>', 'g')) AS digest FROM documents WHERE regexp_matches(text, '(?i)\b(licensed|license|version)\b')")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["licensed", "license", "version"]
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(f"(?i)\\b({'|'.join(words)})\\b"))
    return d.select("doc_id", F.md5(R.highlight(F.col("text"), words)).alias("digest"))


@query(
    "suggest_prefix",
    """WITH n AS (SELECT p_name, count(*) AS n FROM part WHERE contains(p_name, 're') GROUP BY p_name) SELECT p_name, n FROM n ORDER BY NOT starts_with(p_name, 're'), length(p_name), p_name LIMIT 10""",
)
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold the typed text, one each: those that start with it first, short ones first."""
    n = table(spark, sf_dir, "part").filter(F.col("p_name").contains("re")).groupBy("p_name").agg(F.count("*").alias("n"))
    return n.orderBy(~F.col("p_name").startswith("re"), F.char_length("p_name"), "p_name").limit(10)


@query(
    "contains_join_verbatim",
    r"""SELECT b.item_id, count(*) AS n, min(d.doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\s+', ' ', 'g'), regexp_replace(b.text, '\s+', ' ', 'g')) GROUP BY b.item_id""",
)
def contains_join_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items quoted word for word. Candidates come by a rare key, the item's first eight words, by equality; then the text is compared."""
    norm = F.regexp_replace("text", "\\s+", " ")
    words = lambda c: F.split(c, " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", norm.alias("quote")).withColumn("w", words(F.col("quote")))
    n = 8
    long = items.filter(F.size("w") >= n + 2).select("item_id", "quote", F.xxhash64(F.slice("w", 2, n)).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", norm.alias("t")).withColumn("w", words(F.col("t")))
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n))))
    wanted = R.small_side(long.select("key").distinct(), R.BROADCAST_TERMS)
    pairs = docs.filter(F.size("w") >= n).select("doc_id", F.explode(keys).alias("key")).join(wanted, "key").join(R.small_side(long, 50_000), "key")
    hit = pairs.join(docs.select("doc_id", "t"), "doc_id").filter(F.col("t").contains(F.col("quote"))).select("item_id", "doc_id")
    short = items.filter(F.size("w") < n + 2)
    if not short.isEmpty():  # by their longest inner word, which stands whole in the text; quotes of two words have none
        inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
        asked = short.select("item_id", "quote", F.array_max(F.transform(inner, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("word"))))["word"].alias("word"))
        held = docs.select("doc_id", F.explode(F.array_distinct("w")).alias("word")).join(R.small_side(asked.filter("word IS NOT NULL"), 50_000), "word")
        met = held.join(docs.select("doc_id", "t"), "doc_id").filter(F.col("t").contains(F.col("quote"))).select("item_id", "doc_id")
        tiny = R.small_side(asked.filter("word IS NULL").select("item_id", "quote"), 50_000)
        hit = hit.union(met).union(docs.join(tiny, F.col("t").contains(F.col("quote"))).select("item_id", "doc_id"))
    return hit.distinct().groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def clustered(spark: SparkSession, sf_dir: str, allowed=None) -> V.Search:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    centres = V.centres_of(e, "embedding", max(e.count() // V.ROWS, 32))
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    V.assigned(e, "embedding", centres).write.partitionBy("cluster").parquet(folder)
    asks = e.join(R.small_side(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), R.BROADCAST_TERMS), "doc_id").select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("asked"))
    return V.Search(spark.read.parquet(folder), centres, asks, "item_id", "asked", "doc_id", "embedding", 10, allowed)


@query("clustered_knn", f"WITH {VECTOR_SQL} SELECT item_id, doc_id, score, rank FROM vs WHERE rank <= 10")
def clustered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``knn_exact`` finds, by clusters that are left out where their radius allows."""
    return clustered(spark, sf_dir).hits()


@query(
    "filtered_knn",
    f"WITH {VECTOR_SQL}, f AS (SELECT cv.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cv JOIN embeddings ON vec_id = doc_id WHERE label = 3) SELECT item_id, doc_id, score, rank FROM f WHERE rank <= 10",
)
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of the rows with one label: the filter is in the search, not behind it."""
    return clustered(spark, sf_dir, F.col("label") == 3).hits()


@query("clusters_compared")
def clusters_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all rows, how many each item was compared with."""
    return clustered(spark, sf_dir).report()


@query(
    "centroid_classify",
    """WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS c, i, avg(CAST(v AS DOUBLE)) AS mv FROM x GROUP BY ALL),
    s AS (SELECT vec_id, label, c, round(sum(CAST(v AS DOUBLE) * mv) / (sqrt(sum(CAST(v AS DOUBLE) * v)) * sqrt(sum(mv * mv))), 6) AS score FROM x JOIN m USING (i) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c) AS k FROM s) SELECT vec_id, label, c AS nearest_label, score FROM r WHERE k = 1""",
)
def centroid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector to the label with the nearest mean vector."""
    e = table(spark, sf_dir, "embeddings")
    centres = R.mean_vector(e, "label", "embedding", "centre").withColumnRenamed("label", "c")
    return R.classified(e.select("vec_id", "label", "embedding"), centres, "embedding", "c", "centre").drop("embedding")


@query(
    "embedding_cache_misses",
    """SELECT count(*) AS texts, count(DISTINCT md5(text)) AS to_embed, count(*) - count(DISTINCT md5(text)) AS saved FROM documents""",
)
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are embedded once per content hash: how many that leaves."""
    n = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("texts"), F.count("*").alias("to_embed"), (F.sum("n") - F.count("*")).alias("saved"))


@query(
    "similar_in_other_groups",
    f"""WITH {VECTOR_SQL}, o AS (SELECT cv.item_id, cv.doc_id, cv.score, e.label FROM cv JOIN embeddings e ON e.vec_id = doc_id JOIN embeddings s ON s.vec_id = item_id WHERE e.label <> s.label),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY score DESC, doc_id) AS r FROM o) SELECT item_id, label, doc_id, score FROM k WHERE r = 1""",
)
def similar_in_other_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar row of every other label, one per label."""
    e = table(spark, sf_dir, "embeddings")
    asks = e.join(R.small_side(table(spark, sf_dir, "benchmark").select("item_id"), R.BROADCAST_TERMS), F.expr("vec_id = item_id")).select("item_id", F.col("embedding").alias("asked"), "label")
    return R.nearest_of_groups(e.withColumnRenamed("vec_id", "doc_id"), asks, "item_id", "asked", "doc_id", "embedding", "label")


@query(
    "best_overlapping_sentence",
    rf"""WITH {BM25_SQL}, c AS (SELECT item_id, doc_id FROM kw WHERE rank <= 5), se AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS sentence FROM documents WHERE doc_id IN (SELECT doc_id FROM c)),
    qb AS (SELECT DISTINCT item_id, substr(t, i, 2) AS b FROM (SELECT item_id, t, unnest(generate_series(1, length(t) - 1)) AS i FROM (SELECT item_id, lower(regexp_replace(text, '\s', '', 'g')) AS t FROM benchmark))),
    sb AS (SELECT DISTINCT doc_id, sentence, substr(t, i, 2) AS b FROM (SELECT doc_id, sentence, t, unnest(generate_series(1, length(t) - 1)) AS i FROM (SELECT DISTINCT doc_id, sentence, lower(regexp_replace(sentence, '\s', '', 'g')) AS t FROM se))),
    z AS (SELECT item_id, count(*) AS size FROM qb GROUP BY item_id), s AS (SELECT item_id, doc_id, sentence, count(*) AS common FROM c JOIN sb USING (doc_id) JOIN qb USING (item_id, b) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY common DESC, doc_id, sentence) AS k FROM s) SELECT item_id, doc_id, md5(sentence) AS sentence, round(common / size, 6) AS cover FROM r JOIN z USING (item_id) WHERE k = 1""",
)
def best_overlapping_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among an item's five best documents, the sentence that holds most of its letter pairs."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    squash = lambda c: F.lower(F.regexp_replace(c, "\\s", ""))
    heads = keyword_hits(spark, sf_dir).filter("rank <= 5").select("item_id", "doc_id")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "[.\\n]"), lambda x: F.btrim(x)))).alias("sentence"))
    items = table(spark, sf_dir, "benchmark").select("item_id", pairs(squash(F.col("text"))).alias("q"))
    met = heads.join(items, "item_id").join(texts, "doc_id").withColumn("bare", squash(F.col("sentence"))).filter(F.char_length("bare") >= 2)
    met = met.withColumn("common", F.size(F.array_intersect("q", pairs(F.col("bare"))))).filter("common > 0")
    w = Window.partitionBy("item_id").orderBy(F.desc("common"), "doc_id", "sentence")
    best = met.withColumn("k", F.row_number().over(w)).filter("k = 1")
    return best.select("item_id", "doc_id", F.md5("sentence").alias("sentence"), F.round(F.col("common") / F.size("q"), 6).alias("cover"))


PINNED_SQL = f"""WITH {BM25_SQL}, wk AS (SELECT DISTINCT doc_id // 8 AS work, 'Rule ' || (doc_id // 8) % 40 AS title, 'Institute ' || chr(CAST(65 + (doc_id // 8) % 7 AS INT)) AS owner FROM documents),
pl AS (SELECT doc_id // 8 AS work, 'a' || (doc_id % 8 + 1) AS article, doc_id % 3 + 1 AS p FROM documents),
ak AS (SELECT item_id AS ask, CASE WHEN item_id % 5 = 0 THEN 'Institute B' END AS chosen, CASE WHEN item_id % 4 IN (0, 2) THEN 'Institute ' || chr(CAST(65 + item_id % 7 AS INT)) END AS said, CASE WHEN item_id % 4 < 2 THEN 'Rule ' || item_id % 40 END AS title,
  CASE WHEN item_id % 4 < 2 THEN 'a' || (item_id % 9 + 1) END AS article, item_id % 3 + 1 AS p FROM benchmark),
ow AS (SELECT *, coalesce(chosen, said) AS owner FROM ak),
rk AS (SELECT ask, work, 'a' || (doc_id % 8 + 1) AS article, max(score) AS score FROM kw JOIN ow ON ask = item_id JOIN wk ON work = doc_id // 8 WHERE ow.owner IS NULL OR ow.owner = wk.owner GROUP BY ALL),
lu AS (SELECT ask, pl.work, pl.article, CASE WHEN pl.p = o.p THEN pl.article || '.p' || pl.p ELSE pl.article END AS path FROM ow o JOIN wk ON wk.title = o.title AND (coalesce(said, chosen) IS NULL OR coalesce(said, chosen) = wk.owner) JOIN pl ON pl.work = wk.work AND pl.article = o.article
  WHERE o.owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ask ORDER BY pl.p <> o.p, pl.work) = 1),
al AS (SELECT ask, work, article, score, lu.path FROM rk FULL JOIN lu USING (ask, work, article))
SELECT ask, row_number() OVER (PARTITION BY ask ORDER BY path IS NULL, score DESC NULLS LAST, work, article) AS place, work, article, score, path IS NOT NULL AS pinned, path FROM al QUALIFY place <= 10"""


@query("pinned_search", PINNED_SQL)
def pinned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items ask, some of them after a cited place or within an institute: eight documents make a work, its articles are found by keywords or by number."""
    text = lambda c: c.cast("string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("work"), F.concat(F.lit("a"), text(F.col("doc_id") % 8 + 1)).alias("article"))
    institute = lambda c: F.concat(F.lit("Institute "), F.char(F.lit(65) + c % 7))
    works = d.select("work").distinct().select("work", F.concat(F.lit("Rule "), text(F.col("work") % 40)).alias("title"), institute(F.col("work")).alias("owner"))
    places = d.select("work", F.explode(F.array("article", F.concat("article", F.lit(".p"), text(F.col("doc_id") % 3 + 1)))).alias("path"))
    k = F.col("item_id")
    said = F.when(k % 4 % 2 == 0, F.concat(institute(k), F.lit(" "))).otherwise("")
    cited = F.when(k % 4 < 2, F.concat(F.lit("Rule "), text(k % 40), F.lit(" 제"), text(k % 9 + 1), F.lit("조 제"), text(k % 3 + 1), F.lit("항"))).otherwise("expenses")
    asked = table(spark, sf_dir, "benchmark").select(k.alias("ask"), F.concat(said, cited).alias("question"), F.when(k % 5 == 0, "Institute B").alias("chosen"))
    aliases = works.select(F.col("owner").alias("name"), "owner").distinct()
    hits = keyword_hits(spark, sf_dir).join(d, "doc_id").groupBy(k.alias("ask"), "work", "article").agg(F.max("score").alias("score"))
    return O.searched(asked, hits, works, places, aliases)
