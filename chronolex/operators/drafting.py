"""Drafts of regulations: scanned pages, headers, where a body begins, joined lines, unit documents, chunks, checks, scopes, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that are no title, and those that begin a body (fixed values).
LEADER, NUMBERS, REVISION, CLASS = "[.·…]{4,}", "^[0-9\\s.-]+$", "^\\s*[<\\[(]?\\s*(제정|개정|전부\\s*개정|일부\\s*개정|시행)\\s*[0-9'’(]", "원규분류\\s*:?\\s*([A-Z0-9-]+)"
ARTICLE, HEADED, CHAPTER = "^제[0-9]+조", "^제[0-9]+조\\s*\\([^)]+\\)", "^제([0-9]+)장"
PAGE_PARTS = ["header", "footer", "page_number", "aside_text"]
BLOCKS = "pages array<struct<page_idx: int, blocks: array<struct<index: int, type: string, content: string, bbox: array<double>>>>>"


def gutters(boxes: DataFrame, page: str) -> DataFrame:
    """(page, gutter): the middle of landscape pages that hold two pages side by side. boxes has x0, x1, width, height."""
    mid = F.col("width") / 2
    n = boxes.groupBy(page, "width", "height").agg(
        F.count("*").alias("n"), F.count_if(F.col("x1") <= mid).alias("left"), F.count_if(F.col("x0") >= mid).alias("right"), F.count_if((F.col("x0") < mid - 3) & (F.col("x1") > mid + 3)).alias("cross")
    )
    two = (F.col("width") > F.col("height")) & (F.col("n") >= 20) & (F.col("left") >= 10) & (F.col("right") >= 10) & (F.col("cross") <= 0.02 * F.col("n"))
    return n.select(page, F.when(two, mid).alias("gutter"))


def recognised_lines(scans: DataFrame, doc: str) -> DataFrame:
    """(doc, no, text, page, x0, y0): lines of recognised pages (JSON in ``scan``) in reading order.

    What belongs to the page and not to its text goes, a table gives a line per row, and boxes become
    points of the page's size (width, height; null where that isn't known).
    """
    pages = scans.withColumn("p", F.from_json("scan", BLOCKS)).select(doc, "width", "height", F.explode("p.pages").alias("p"))
    inner = lambda x, tag: F.regexp_extract_all(x, F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1))
    rows = F.filter(F.transform(inner(F.col("b.content"), "tr"), lambda r: F.array_join(inner(r, "td"), " | ")), lambda r: F.regexp_replace(r, "[ |]", "") != "")
    lines = F.filter(F.transform(F.split("b.content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = pages.select(doc, "width", "height", F.col("p.page_idx").alias("page_idx"), F.explode("p.blocks").alias("b")).filter(~F.col("b.type").isin(PAGE_PARTS))
    d = d.select(doc, "page_idx", F.col("b.index").alias("k"), "width", "height", F.col("b.bbox").alias("bbox"), F.posexplode(F.when(F.col("b.type") == "table", rows).otherwise(lines)).alias("j", "text"))
    no = F.row_number().over(Window.partitionBy(doc).orderBy("page_idx", "k", "j"))
    at = lambda i, side: F.round(F.col("bbox")[i] * F.col(side), 1)
    return d.select(doc, no.alias("no"), "text", (F.col("page_idx") + 1).alias("page"), at(0, "width").alias("x0"), at(1, "height").alias("y0"))


def header(lines: Column) -> dict[str, Column]:
    """title, class code and number of revisions of a document's lines."""
    coded = lambda x: x.rlike(CLASS)
    revised = lambda x: x.rlike(REVISION)
    titled = F.filter(lines, lambda x: ~coded(x) & ~revised(x) & ~x.rlike(LEADER) & ~x.rlike(NUMBERS) & (F.position(F.lit("목"), F.substring(x, 1, 2)) == 0))
    return {"title": F.get(titled, F.lit(0)), "code": F.nullif(F.regexp_extract(F.coalesce(F.get(F.filter(lines, coded), F.lit(0)), F.lit("")), CLASS, 1), F.lit("")), "revisions": F.size(F.filter(lines, revised))}


def body_start(lines: Column) -> Column:
    """Index (from 0) of the first article with a heading that is no entry of a table of contents, or of the first chapter up to three lines before; the number of lines if there is none."""
    place = F.sequence(F.lit(0), F.size(lines) - 1)
    bare = lambda x: F.trim(F.regexp_replace(x, HEADED, "")) == ""
    follows = lambda k: F.coalesce(F.get(lines, k + 1), F.lit(""))
    entry = lambda k: bare(F.get(lines, k)) & (follows(k).rlike(ARTICLE) | follows(k).rlike(CHAPTER))
    first = F.array_min(F.filter(place, lambda k: F.get(lines, k).rlike(HEADED) & ~F.get(lines, k).rlike(LEADER) & ~entry(k)))
    chapter = F.array_max(F.filter(place, lambda k: (k < first) & (k >= first - 3) & (F.regexp_extract(F.get(lines, k), CHAPTER, 1) == "1")))
    return F.coalesce(chapter, first, F.size(lines))


def line_joins(ends: DataFrame, lexicon: DataFrame, word_end: str) -> DataFrame:
    """ends with ``rule`` and ``apart``: whether the words a and b at a line's end and the next one's start are two words.

    lexicon has word and n. The rules in order: the whole is known and a part isn't; both parts are and
    the whole is rare beside them; the whole is known; a ends like a word and b is known; else one word.
    """
    count = lambda k: lexicon.select(F.col("word").alias(k), F.col("n").alias(f"n_{k}"))
    d = ends.withColumn("ab", F.concat("a", "b"))
    for k in ("a", "b", "ab"):
        d = d.join(count(k), k, "left").fillna(0, [f"n_{k}"])
    a, b, ab = F.col("n_a"), F.col("n_b"), F.col("n_ab")
    rare = ab < F.greatest(F.lit(1), F.floor(F.least(a, b) / 10))
    rule = F.when((ab >= 2) & ((a == 0) | (b == 0)), 1).when((a >= 1) & (b >= 1) & rare, 2).when(ab >= 1, 3).when(F.col("a").rlike(word_end) & (b >= 1), 4).otherwise(5)
    return d.withColumn("rule", rule).withColumn("apart", F.col("rule").isin(2, 4)).drop("ab", "n_a", "n_b", "n_ab")


def unit_documents(provisions: DataFrame, size: int) -> DataFrame:
    """(version, path, window, full_label, breadcrumb, text): a document per provision but chapters, long ones in windows of equal room.

    provisions has version, title, path, parent, unit, label, heading and text; ancestors come by joins
    on the parent's path, three levels at most, never by a loop.
    """
    up = lambda k: provisions.select("version", F.col("path").alias(f"path{k}"), F.col("parent").alias(f"parent{k}"), F.col("label").alias(f"label{k}"), F.col("unit").alias(f"unit{k}"), F.col("heading").alias(f"heading{k}"))
    d = provisions.filter("unit <> 'chapter'").withColumn("parent0", F.col("parent"))
    for k in (1, 2, 3):
        d = d.join(up(k).withColumnRenamed(f"path{k}", f"parent{k - 1}"), ["version", f"parent{k - 1}"], "left")
    labels = [F.when(F.col(f"unit{k}") != "chapter", F.col(f"label{k}")) for k in (3, 2, 1)]
    d = d.withColumn("full_label", F.concat_ws(" ", "title", *labels, "label"))
    crumb = lambda k: F.concat_ws(" ", f"label{k}", f"heading{k}")
    d = d.withColumn("breadcrumb", F.concat_ws(" > ", "title", *[F.nullif(crumb(k), F.lit("")) for k in (3, 2, 1)], F.concat_ws(" ", "label", "heading")))
    n = F.char_length("text")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(n / F.lit(size)).cast("int"), F.lit(1))), lambda k: F.struct(k.alias("window"), F.substring(F.col("text"), (k - 1) * size + 1, F.lit(size)).alias("text")))
    pieces = F.when(n <= size, F.array(F.struct(F.lit(0).alias("window"), F.col("text").alias("text")))).otherwise(many)
    return d.select("version", "path", "full_label", "breadcrumb", F.inline(pieces))


def article_chunks(provisions: DataFrame, size: int) -> DataFrame:
    """(version, path, text): whole articles with what is below them, or their paragraphs where that is longer than size; p10 follows p9."""
    own = provisions.filter("unit <> 'chapter'").withColumn("article", F.split_part("path", F.lit("."), F.lit(1)))
    w = Window.partitionBy("version", "article")
    place = F.transform(F.regexp_extract_all("path", F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("long"))
    d = own.withColumn("all", F.sum(F.char_length("text") + 1).over(w))
    whole = d.filter(F.col("all") <= size).groupBy("version", F.col("article").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "path", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(d.filter(F.col("all") > size).select("version", "path", "text"))


def quality_issues(versions: DataFrame) -> DataFrame:
    """(version, kind, detail) of versions with status, numbers (array), chars, toc (array)."""
    n = F.size("numbers")
    missing = F.array_except(F.sequence(F.lit(1), F.array_max("numbers")), F.col("numbers"))
    differ = F.array_sort(F.array_union(F.array_except("toc", "numbers"), F.array_except("numbers", "toc")))
    low = (n == 0) | (F.col("chars") < 10 * n)
    text = lambda a: F.array_join(F.slice(a, 1, 20), ",")
    issue = lambda when, kind, detail: F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    found = F.array(
        issue(F.col("status") == "CONFLICT", "CONFLICT", F.col("status")),
        issue(F.col("status") == "UNCERTAIN", "EFFECTIVE_DATE", F.col("status")),
        issue(low, "LOW_TEXT", n.cast("string")),
        issue(~low & (F.size(missing) > 0), "GAP", text(missing)),
        issue(~low & (F.size("toc") > 0) & (F.size(differ) > 0), "TOC", text(differ)),
    )
    return versions.select("version", F.inline(F.filter(found, lambda x: x.isNotNull())))


def scope_plan(seeds: DataFrame, cited: DataFrame, children: list[str], most: int, least: int = 1) -> DataFrame:
    """(norm, reason, parent, citations, place): seeds (norm, ord), then what is cited most, each followed by its children, at most so many.

    cited has norm and n. A name that comes twice keeps its first place. The list is capped by what it is for.
    """
    ranked = cited.filter(F.col("n") >= least).withColumn("ord", F.struct(F.lit(2).alias("g"), (-F.col("n")).alias("a"), F.col("norm").alias("b")))
    bases = seeds.select("norm", F.struct(F.lit(1).alias("g"), F.col("ord").cast("long").alias("a"), F.col("norm").alias("b")).alias("ord"), F.lit("CONFIG").alias("reason")).unionByName(ranked.select("norm", F.col("ord"), F.lit("CITED").alias("reason")))
    child = F.exists(F.array(*[F.lit(c) for c in children]), lambda c: F.endswith(F.col("norm"), c))
    family = F.array(F.struct(F.lit(0).alias("k"), F.col("norm").alias("name"), F.col("reason").alias("why"), F.lit(None).cast("string").alias("parent")), *[F.struct(F.lit(k + 1).alias("k"), F.concat("norm", F.lit(c)).alias("name"), F.lit("CHILD").alias("why"), F.col("norm").alias("parent")) for k, c in enumerate(children)])
    each = bases.select("ord", F.inline(F.filter(family, lambda x: (x["k"] == 0) | ~child)))
    first = each.groupBy(F.col("name").alias("norm")).agg(F.min(F.struct("ord", "k", "why")).alias("f"), F.min_by("parent", F.when(F.col("parent").isNotNull(), F.struct("ord", "k"))).alias("parent"))
    top = first.join(cited.select("norm", F.col("n").alias("citations")), "norm", "left").fillna(0, ["citations"]).orderBy("f.ord", "f.k").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("f.ord", "f.k"))).select("norm", F.col("f.why").alias("reason"), "parent", "citations", "place")


def catalogue_matches(plan: DataFrame, rows: DataFrame, kept: DataFrame, children: list[str]) -> DataFrame:
    """(id, reason): rows (id, norm, abbr, law) that the plan names (norm), that are children of such a row, or whose law is kept; the first reason counts."""
    names = plan.select(F.col("norm").alias("_n")).distinct()
    each = rows.select("id", "norm", F.explode(F.array_distinct(F.array_compact(F.array("norm", "abbr")))).alias("_n"))
    direct = each.join(names, "_n", "left_semi").select("id", "norm").distinct()
    official = direct.select(F.explode(F.array(*[F.concat("norm", F.lit(c)) for c in children])).alias("norm")).distinct()
    child = rows.join(official, "norm", "left_semi").select("id", F.lit(2).alias("p"))
    keep = rows.join(kept.select("law").distinct(), "law", "left_semi").select("id", F.lit(3).alias("p"))
    found = direct.select("id", F.lit(1).alias("p")).unionByName(child).unionByName(keep).groupBy("id").agg(F.min("p").alias("p"))
    return found.select("id", F.when(F.col("p") == 1, "NAMED").when(F.col("p") == 2, "CHILD").otherwise("KEPT").alias("reason"))


def statute_links(references: DataFrame, names: DataFrame, statutes: DataFrame, articles: DataFrame) -> DataFrame:
    """references (id, name, article) with law, found, outcome and reason.

    names (name, law) may give a name several laws; statutes has law and abolished, articles law, article
    and gone. Only a name with one law is linked.
    """
    one = names.groupBy("name").agg(F.countDistinct("law").alias("laws"), F.min("law").alias("law"))
    d = references.join(one, "name", "left").withColumn("law", F.when(F.col("laws") == 1, F.col("law")))
    d = d.join(statutes, "law", "left").join(articles.withColumn("found", F.lit(True)), ["law", "article"], "left")
    outcome = F.when(F.col("laws") == 1, "linked").when(F.col("laws") > 1, "ambiguous").otherwise("unmatched")
    linked = F.col("law").isNotNull()
    reason = F.when(linked & F.col("abolished"), "law_abolished").when(linked & F.col("found") & F.col("gone"), "article_deleted").when(linked & F.col("found").isNull() & F.col("article").isNotNull(), "article_missing")
    return d.select("id", "name", "article", "law", F.coalesce("found", F.lit(False)).alias("found"), outcome.alias("outcome"), reason.alias("reason"))


def decide(ledger: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The ledger (key, state, since, abolished_on) after decisions (key, confirm), with ``error`` where one may not be taken.

    Only a candidate is confirmed, and only a candidate or what is abolished is rejected.
    """
    d = ledger.join(decisions, key, "left")
    yes, no = F.col("confirm") & (F.col("state") == "CANDIDATE"), ~F.col("confirm") & F.col("state").isNotNull()
    error = F.when(F.col("confirm") & ~F.coalesce(F.col("state") == "CANDIDATE", F.lit(False)), "not a candidate").when(~F.col("confirm") & F.col("state").isNull(), "nothing to reject")
    return d.select(key, F.when(yes, "ABOLISHED").when(no, F.lit(None)).otherwise(F.col("state")).alias("state"), F.when(yes, F.col("since")).when(no, F.lit(None)).otherwise(F.col("abolished_on")).alias("abolished_on"), error.alias("error"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, white space aside, in lower case."""
    t = F.lower(F.regexp_replace(text, "\\s", ""))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))


def match_items(questions: DataFrame, items: DataFrame) -> DataFrame:
    """(q, item, score): the item (label, extra) that shares most pairs of letters with a question, two of its label's at least, if it leads alone.

    Both sides meet on the pairs, in an inverted index, so a question is never compared with every item.
    """
    own = items.select("item", F.explode(bigrams(F.col("label"))).alias("b"), F.lit(2).alias("w")).unionByName(items.select("item", F.explode(bigrams(F.col("extra"))).alias("b"), F.lit(1).alias("w")))
    met = questions.select("q", F.explode(bigrams(F.col("text"))).alias("b")).join(own, "b").groupBy("q", "item").agg(F.sum("w").alias("score"), F.count_if(F.col("w") == 2).alias("in_label")).filter("in_label >= 2")
    top = met.groupBy("q").agg(F.max("score").alias("score"), F.max_by("item", F.struct("score", "item")).alias("item"))
    alone = met.join(top.select("q", "score"), ["q", "score"]).groupBy("q").agg(F.count("*").alias("same")).filter("same = 1")
    return top.join(alone, "q", "left_semi").select("q", "item", "score")


def report_lines(rows: DataFrame, key: str, values: list[str], title: str) -> DataFrame:
    """(no, line): a Markdown table of an aggregate with few rows, in the order of the key."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(key)) + 3).alias("no"), bar([F.col(c).cast("string") for c in (key, *values)]).alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(1, f"# {title}"), (2, f"| {' | '.join([key, *values])} |"), (3, f"|{'---|' * (1 + len(values))}")], "no int, line string")
    return head.unionByName(body)
