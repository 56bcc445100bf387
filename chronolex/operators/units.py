"""What a search indexes: a document per provision with its numbers, labels, context, and the text of its article.

The provisions of an article are gathered in one row and find what lies above and below there, and versions are dealt once, so no provision is
shuffled for a join. An article's cost is the square of its provisions in comparisons of paths, not in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.structure import SYLLABLES

#: Units that only give context; units that are called by their place; units that stand on top of a path (fixed values).
CONTEXT = ("chapter", "section")
BELOW = ("paragraph", "item", "subitem")
TOP = ("article", "annex", "supp_article")
EMBEDDED = ("article", "paragraph", "annex")
SUPPLEMENT = "부칙"


def numbers(path: Column) -> dict[str, Column]:
    """Numbers in a path as columns; null where it has none, and in supplements, so that a search by number finds the body only."""
    body, copy = path.rlike(r"^a[0-9]"), "(?:~[0-9]+)?"
    part = lambda pattern, k, when: F.when(when, F.nullif(F.regexp_extract(path, pattern, k), F.lit("")).cast("int"))
    branch = lambda pattern, when: F.when(when & (F.regexp_extract(path, pattern, 1) != ""), F.coalesce(F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")).cast("int"), F.lit(0)))
    article, item, annex = rf"^a([0-9]+)(?:-([0-9]+))?{copy}(?:\.|$)", rf"\.i([0-9]+)(?:-([0-9]+))?{copy}(?:\.|$)", rf"^(?:annex|form)([0-9]+)(?:-([0-9]+))?{copy}$"
    syllable = part(rf"\.s([0-9]+){copy}$", 1, body)
    yes = F.lit(True)
    return {
        "article_no": part(article, 1, body), "article_branch": branch(article, body), "paragraph_no": part(rf"\.p([0-9]+){copy}(?:\.|$)", 1, body), "item_no": part(item, 1, body),
        "item_branch": branch(item, body), "subitem": F.when(syllable.isNotNull(), F.substring(F.lit(SYLLABLES), syllable, F.lit(1))), "annex_no": part(annex, 1, yes), "annex_branch": branch(annex, yes),
    }


def _date(path: Column) -> Column:
    """``2024. 1. 17.`` of a supplement's path, null if it has no date."""
    d = F.try_to_date(F.regexp_extract(path, "@([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    return F.date_format(d, "yyyy. M. d.")


def _named(p: DataFrame) -> DataFrame:
    """The provisions with head (as a text begins), line (as it stands below others) and formal (as it is cited)."""
    unit, path, text, day = F.col("unit"), F.col("path"), F.coalesce("text", F.lit("")), _date(F.col("path"))
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("("), "heading", F.lit(")"))).otherwise("")
    head = F.when(unit == "supplement", F.concat_ws(" ", F.lit(SUPPLEMENT), day)).otherwise(F.concat("label", heading))
    nth = lambda tag, k: F.regexp_extract(path, rf"\.{tag}([0-9]+)(?:-([0-9]+))?", k)
    after = lambda tag, word: F.concat(F.lit("제"), nth(tag, 1), F.lit(word), F.when(nth(tag, 2) != "", F.concat(F.lit("의"), nth(tag, 2))).otherwise(""))
    syllable = F.substring(F.lit(SYLLABLES), F.nullif(nth("s", 1), F.lit("")).cast("int"), F.lit(1))
    formal = (
        F.when((unit == "paragraph") & (nth("p", 1) != ""), after("p", "항"))
        .when((unit == "item") & (nth("i", 1) != ""), after("i", "호"))
        .when((unit == "subitem") & (nth("s", 1) != ""), F.concat(syllable, F.lit("목")))
        .when(unit == "supplement", F.when(day.isNotNull(), F.concat(F.lit(f"{SUPPLEMENT}("), day, F.lit(")"))).otherwise(SUPPLEMENT))
        .otherwise(F.col("label"))
    )
    line = F.when(unit.isin(*BELOW), F.btrim(F.concat_ws(" ", "label", text))).when(unit == "supp_article", F.btrim(F.concat_ws(" ", head, text))).otherwise(text)
    return p.withColumn("text", text).withColumn("head", head).withColumn("formal", formal).withColumn("line", line)


def search_units(provisions: DataFrame, current: Column, size: int = 1200) -> DataFrame:
    """A row per provision, or per window of a long one: its path (with #n for a window) and base_path, numbers, labels, breadcrumb, context
    (what stands above it in its article), article_text (on the article itself) and embed_text.

    provisions: version, title, ord, path, parent, unit, label, heading, text; a path says where a provision lies in its article (``a3.p1.i2``), a parent
    what an article lies in. Chapters and sections are context only. ``current`` tells which get a text to embed: articles, paragraphs, annexes that are no forms.
    """
    p = _named(provisions)
    steps = F.split("path", r"\.")
    p = p.withColumn("article_path", steps[0]).withColumn("_depth", F.size(steps)).withColumn("_current", current)
    own = F.struct("_depth", "ord", "path", "unit", "formal", "head", "line", "text", "title", "_current")
    g = p.groupBy("version", "article_path").agg(
        F.collect_list(F.when(~F.col("unit").isin(*CONTEXT), own)).alias("_all"), F.first(F.when(F.col("_depth") == 1, F.struct("parent")), True).alias("_top")
    )

    # what an article lies in: two levels of chapters, sections or supplements
    name = F.when(F.col("unit").isin(*CONTEXT), F.concat_ws(" ", "label", F.nullif("heading", F.lit("")))).otherwise(F.col("formal"))
    outer = F.struct("path", name.alias("name"), F.when(F.col("unit") == "supplement", F.col("formal")).alias("supplement"), "parent")
    outers = p.filter(F.col("unit").isin(*CONTEXT, "supplement")).groupBy("version").agg(F.collect_list(outer).alias("_outers"))
    at = lambda path: F.get(F.filter("_outers", lambda x: x["path"] == path), F.lit(0))
    g = g.join(outers.hint("shuffle_hash"), "version", "left").withColumn("_in", at(F.col("_top.parent")))
    around = F.array_compact(F.array(at(F.col("_in.parent"))["name"], F.col("_in.name")))

    # what lies above in the article, and below articles and paragraphs, in the order of the document
    inside = lambda x, y: F.startswith(x["path"], F.concat(y["path"], F.lit(".")))
    above = lambda x: F.sort_array(F.filter("_all", lambda y: (y["_depth"] < x["_depth"]) & inside(x, y)))
    below = lambda x: F.when(x["_depth"] <= 2, F.transform(F.sort_array(F.transform(F.filter("_all", lambda y: (y["_depth"] > x["_depth"]) & inside(y, x)), lambda y: F.struct(y["ord"].alias("ord"), y["line"].alias("line")))), lambda y: y["line"]))
    each = F.transform("_all", lambda x: F.struct(x.alias("_x"), above(x).alias("_above"), below(x).alias("_below")))
    d = g.select("version", "article_path", around.alias("_outer"), F.col("_in.supplement").alias("_supplement"), F.inline(each))
    d = d.select("version", "article_path", "_outer", "_supplement", "_x.*", F.when(F.size("_above") > 0, F.col("_above")).alias("_above"), "_below")
    none = F.array().cast("array<string>")
    lines, outside = F.coalesce("_below", none), F.coalesce("_outer", none)
    is_top = F.col("_above").isNull()
    top_head = F.when(is_top, F.col("head")).otherwise(F.get("_above", F.lit(0))["head"])
    own = lambda x: F.when(x["unit"].isin(*TOP), x["head"]).otherwise(x["formal"])
    crumb = F.when(F.col("unit").isin(*TOP, "supplement"), F.col("head")).otherwise(F.col("formal"))
    inner = F.coalesce("_above", F.array().cast(d.schema["_above"].dataType))
    label = F.concat_ws(" ", "title", F.when(F.col("article_path").startswith("supp") & (F.col("unit") != "supplement"), F.col("_supplement")), F.array_join(F.transform(inner, lambda x: x["formal"]), " "), "formal")
    d = d.withColumn("full_label", F.regexp_replace(label, " {2,}", " "))
    d = d.withColumn("breadcrumb", F.concat_ws(" > ", F.array("title"), outside, F.transform(inner, own), F.array(crumb)))
    upper = F.filter(inner, lambda x: (x["_depth"] > 1) | (x["text"] != ""))
    d = d.withColumn("context", F.when(is_top, "").otherwise(F.array_join(F.concat(F.array(top_head), F.transform(upper, lambda x: x["line"])), " ")))
    filled = lambda a: F.filter(a, lambda x: x != "")
    whole = F.when(is_top, F.array_join(F.concat(F.array(top_head), filled(F.concat(F.array("text"), lines))), "\n"))
    embeds = F.col("_current") & F.col("unit").isin(*EMBEDDED) & ~F.col("path").startswith("form")
    part = F.array_join(F.concat(F.array(top_head), filled(F.concat(F.array("line"), lines))), "\n")
    d = d.withColumn("article_text", whole).withColumn("_embed", F.when(embeds, F.coalesce(whole, part))).withColumn("_head", top_head)

    room = F.greatest(F.lit(size) - F.char_length("_head") - 1, F.lit(1))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.char_length("text") / room).cast("int"), F.lit(1))), lambda k: F.struct(k.alias("window"), F.substring(F.col("text"), (k - 1) * room + 1, room).alias("piece")))
    fits = F.char_length("_head") + 1 + F.char_length("text") <= size
    d = d.select("*", F.inline(F.when(fits, F.array(F.struct(F.lit(0).alias("window"), F.col("text").alias("piece")))).otherwise(windows)))
    first, alone = F.col("window") <= 1, F.col("window") == 0
    embed = F.when(alone, F.col("_embed")).when(F.col("_embed").isNotNull(), F.concat("_head", F.lit("\n"), "piece"))
    return d.select(
        "version", F.when(alone, F.col("path")).otherwise(F.concat("path", F.lit("#"), F.col("window").cast("string"))).alias("path"), F.col("path").alias("base_path"), "article_path", "ord", F.when((F.col("unit") == "annex") & F.col("path").startswith("form"), "form").otherwise(F.col("unit")).alias("unit"),
        *[c.alias(n) for n, c in numbers(F.col("path")).items()], F.col("formal").alias("label"), "full_label", "breadcrumb", "context", F.col("piece").alias("text"), "window", F.when(first, F.col("article_text")).alias("article_text"), embed.alias("embed_text"),
    )
