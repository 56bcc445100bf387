"""Citations of a provision in all the ways that regulations write them, as one row each.

One alternation finds the tokens of a text in order: a name or a word that stands for one, and a place
after it. What a token takes from those before it (the name of a list, "the same law", the article of a
lone paragraph) comes from windows over the tokens of one provision, so texts are never shuffled. Where few
texts recur in many provisions, each is read once and its citations are sent to the provisions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.patterns import in_order, loose, maybe, one_of, silent, word_ending
from chronolex.functions.wording import LAW_ENDINGS, LETTER, RULE_ENDINGS, definitions
from chronolex.operators.citations import EXCEPTION, MUTATIS, PLACE, path_of

#: Words of the domain (fixed values). Short names of statutes; names of rules that are an ending alone.
SHORT_NAMES = "법 영 시행령 시행규칙".split()
WHOLE_NAMES = ["정관"]
#: Words before an ending that point to this rule, to the one named last, or to no certain one.
THIS, SAME_ONE, SOME = "이 본 당해".split(), "같은 동".split(), "관련 관계 해당 각 다른 위 상기".split()
DECREES = "시행령 시행규칙".split()
#: What joins the places of a list, and what spans a range of them.
JOINS, RANGES = "및 또는 이나 와 과 , · ㆍ".split(), "부터 내지 ~ ∼ ～".split()
#: Particles after a name, by what they can mean.
FROM, AT, OBJECT, INTO = "에서 으로부터".split(), ["에"], "을 를 의".split(), "으로 로".split()
#: Verbs: a citation is what something is based on, what is applied as well, what handed a matter over.
BASED, APPLIED, HANDED = "따라 따른 따르 의하여 의한 의거 근거 근거하여".split(), ["준용"], ["위임"]
#: Of these, what a purpose clause says of the rule that it carries out.
ENACTING = "따라 의하여 의거 근거하여".split()
APART, DECIDED = "따로 별도로".split(), ["정한다", "정할 수 있다", "정하는 바에 따른다"]
AMENDING, AMENDED_PARTS = ["개정"], ["중", "일부를", "전부를", "을", "를"]
PURPOSE = "목적"
#: Up to so many different texts (as counted by a sketch) are read once and sent; of more, each provision is read.
FEW_TEXTS = 20_000

RULE = one_of(RULE_ENDINGS + LAW_ENDINGS)
LIST = one_of(JOINS + RANGES)
OWN = in_order(one_of(THIS), RULE)
SAME = in_order(one_of(SAME_ONE), RULE) + maybe("\\s?" + one_of(DECREES))
VAGUE = in_order(one_of(SOME), RULE)
ANNEX = "(별표|별지)\\s*(?:제\\s*)?([0-9]+)\\s*(?:호)?(?:의\\s*([0-9]+))?(?:\\s*서식)?"
ALONE = "제\\s*[0-9]+\\s*항|전항"
PLAIN = silent(PLACE)
#: A name in one word; one of several words, none of which is a topic of the sentence; and one that was marked as known.
NAME = word_ending(RULE, LETTER)
WORD_OF_NAME = f"(?!{one_of(JOINS)}\\s){LETTER}*[가-힣A-Za-z0-9&&[^은는고며]]\\s"
LONG_NAME = f"(?<!{LETTER})(?:{WORD_OF_NAME}){{1,9}}{LETTER}*{loose('관한 법률')}{maybe(chr(92) + 's?' + one_of(DECREES))}"
MARKED = "『[^』]+』"
WHO = one_of([], "「[^」]+」", MARKED, OWN, SAME, VAGUE, f"(?<!{LETTER}){one_of(SHORT_NAMES)}(?=\\s?제)", f"(?<!{LETTER}){one_of(WHOLE_NAMES)}", loose("같은 조"), LONG_NAME, NAME)
#: What follows a citation: a remark in brackets, "as ruled by", a particle and a verb. Groups: particle, verb.
FOLLOWS = f"^\\s*{maybe(chr(92) + '([^()]{1,20}' + chr(92) + ')' + chr(92) + 's*')}{maybe('의' + chr(92) + 's*규정' + chr(92) + 's*')}({one_of(FROM + AT + OBJECT)})\\s*({one_of(BASED + APPLIED + HANDED)})"
USED = f"\\s?{one_of(FROM + AT + OBJECT)}\\s?{one_of(BASED + APPLIED + HANDED)}"
AMENDS = f"^\\s?{one_of(AMENDED_PARTS)}[^.]{{0,20}}{one_of(AMENDING)}"
DECIDES = one_of(DECIDED)
BY_NAME = f"\\s?{one_of(FROM + INTO)}\\s?"
DELEGATED = one_of([], f"{maybe(NAME + BY_NAME)}{one_of(APART)}\\s?{DECIDES}", f"{NAME}{BY_NAME}{DECIDES}")
TOKEN = "|".join([
    "“[^”]*”(?!이?라 한다)",
    f"{NAME}(?={AMENDS.removeprefix('^')})",
    DELEGATED,
    f"{maybe(LIST + chr(92) + 's*')}{maybe(WHO + chr(92) + 's?')}{one_of([], PLAIN, silent(ANNEX), ALONE)}",
    "「[^」]+」",
    f"{one_of([], MARKED, LONG_NAME, NAME)}(?={USED})",
])
CITED = f"({TOKEN})(?=([^\\n]{{0,60}}))"
#: The next place belongs to the same list: a heading in brackets, then what joins.
GOES_ON = f"^{maybe(chr(92) + 's*' + chr(92) + '([^()]{1,30}' + chr(92) + ')')}\\s*{LIST}\\s*(?:제|별|전)"
#: Articles of a form itself, as of a contract to be signed, and the note that tells which article a form belongs to.
CLAUSE, BELONGS = "제\\s?[0-9]+\\s?조\\s?\\([^)]{1,20}\\)", "^[^()]{0,20}관련\\s?\\)"


def _got(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def abbreviations(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, abbreviation, name) that the texts of a document define; the least name if there are several. Rows come dealt by document."""
    d = texts.select(doc, F.inline(definitions(F.coalesce(F.col(text), F.lit(""))))).repartition(doc)
    return d.groupBy(doc, "abbreviation").agg(F.min("name").alias("name"))


def cited(texts: DataFrame, text: str, doc: str, path: str, heading: str, known: DataFrame, few: int = FEW_TEXTS) -> DataFrame:
    """(doc, path, place, kind, title, target, rel) of a provision's citations, ``place`` counting from 1.

    ``known`` has (doc, abbreviation, name). Kinds: external and named (another rule, in brackets or
    not), named_annex, annex, internal, delegation, delegation_named. A null text cites nothing. A
    previous paragraph of a first one, and quoted words, are no citations. A list takes the name before
    it; "the same law" takes the last name; a lone paragraph that follows takes the article.
    Articles of a form's own text, as of a contract in an annex, are none of the rule's. Names in 『』 (as ``names.marked`` sets
    them) are names as they stand. doc and path name a provision.

    What a provision cites depends on its text, path and heading alone, but for the full names of abbreviations, which come in
    at the end. So up to ``few`` different ones are read once each; texts are equal if two 64-bit hashes of them are.
    """
    d = texts.select(doc, F.col(path).alias("path"), F.col(heading).alias("_h"), F.col(text).alias("_text"))
    named = [F.col(c) for c in ("path", "_h", "_text")]
    nulls = [c.isNull() for c in named]
    if d.select(F.approx_count_distinct(F.xxhash64(*named, *nulls))).first()[0] <= few:
        keys = {"_k1": F.xxhash64(*named, *nulls), "_k2": F.xxhash64(F.lit(2), *nulls, *reversed(named))}
        one = _read(d.select("path", "_h", "_text").distinct().withColumns(keys), list(keys))
        own = ["path", "place", "kind", "_base", "_tail", "target", "rel"]
        one = one.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_found"))
        d = d.select(doc, *[c.alias(k) for k, c in keys.items()]).join(F.broadcast(one), list(keys)).select(doc, "_found")
        found = lambda d: d.select(doc, "_full", F.inline("_found"))
    else:
        d, found = _read(d, [doc, "path"]), lambda d: d
    full = known.filter("abbreviation IS NOT NULL").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("abbreviation", "name"))).alias("_full"))
    d = found(d.join(full.hint("shuffle_hash"), doc, "left"))
    name = F.coalesce(F.get(F.filter("_full", lambda x: x["abbreviation"] == F.col("_base")), F.lit(0))["name"], "_base")
    return d.select(doc, "path", "place", "kind", F.concat(name, "_tail").alias("title"), "target", "rel")


def _read(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, path, place, kind, _base and _tail of the title (null where there is none), target and rel of each citation in (keys, path, _h, _text)."""
    text, key = F.col("_text"), list(dict.fromkeys([*keys, "path"]))
    tokens = F.arrays_zip(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(CITED), F.lit(CITED_AFTER)).alias("after"))
    form = F.col("path").rlike("^(?:annex|form)") & (F.regexp_count(text, F.lit(CLAUSE)) >= 2)
    d = texts.select(*key, "_h", F.coalesce(form, F.lit(False)).alias("_form"), F.posexplode(tokens).alias("_at", "_x"))
    d = d.select("*", "_x.t", F.substring("_x.after", 1, 30).alias("after"), F.col("_x.after").alias("_next")).drop("_x").filter(~F.col("t").startswith("“"))
    t = F.regexp_replace("t", f"^{LIST}\\s*", "")
    article = f"(?:{PLACE})$"
    who = F.rtrim(F.regexp_replace(t, f"(?:{PLAIN}|{ANNEX}|{ALONE})$", ""))
    delegated = t.rlike(f"{DECIDES}$")
    amends = F.col("after").rlike(AMENDS) & ~t.rlike("[0-9]\\s*(?:조|항|호)|^「")
    d = d.withColumns({
        "_t": t, "_amends": amends, "_deleg": delegated,
        "_joined": F.col("t").rlike(f"^{LIST}\\s*") & F.coalesce(F.lag("_next").over(Window.partitionBy(*key).orderBy("_at")).rlike(GOES_ON), F.lit(False)),
        "_art": path_of(*[F.regexp_extract(t, article, k) for k in range(1, 6)]),
        "_annex": F.concat(F.when(_got(t, f"{ANNEX}$") == "별표", "annex").when(_got(t, f"{ANNEX}$") == "별지", "form"), _got(t, f"{ANNEX}$", 2), F.coalesce(F.concat(F.lit("-"), _got(t, f"{ANNEX}$", 3)), F.lit(""))),
        "_para": F.when(t.rlike(f"^(?:같은\\s?조\\s?)?(?:{ALONE})$"), F.coalesce(_got(t, "제\\s*([0-9]+)\\s*항$"), F.lit("전"))),
        "_who": F.nullif(F.when(delegated, F.trim(F.regexp_replace(t, f"{maybe(BY_NAME)}\\s?{maybe(one_of(APART))}\\s?{DECIDES}$", ""))).otherwise(who), F.lit("")),
    })
    w = F.col("_who")
    named = w.isNotNull() & ~w.rlike(f"^{one_of([], OWN, SAME, VAGUE, loose('같은 조'))}$")
    d = d.withColumn("_bracket", F.coalesce(w.startswith("「"), F.lit(False))).withColumn("_name", F.when(named, F.trim(F.regexp_replace(w, "[「」『』]", ""))))

    before = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*key).orderBy("_at")
    place = F.col("_art").isNotNull() | F.col("_annex").isNotNull() | F.col("_para").isNotNull()
    same = F.coalesce(w.rlike(f"^{SAME}$"), F.lit(False))
    other = F.when(F.col("_name").isNotNull() & ~F.col("_amends") & ~F.col("_deleg"), F.struct(F.col("_name").alias("name"), F.lit("").alias("tail"), F.when(F.col("_bracket"), "external").otherwise("named").alias("kind")))
    amended = F.last(F.when(F.col("_amends"), F.col("_name")), ignorenulls=True).over(before)
    d = d.withColumns({"_last": F.last(other, ignorenulls=True).over(before), "_amended": F.when(F.col("path").startswith("supp"), amended)})
    # a run is a name and the list after it
    opens = w.isNotNull() | ~F.col("_joined")
    tail = F.regexp_extract(w, f"(\\s?{one_of(DECREES)})$", 1)
    same_tail = F.when((tail != "") & ~w.rlike(f"^{in_order(one_of(SAME_ONE), one_of(DECREES))}$"), F.concat(F.lit(" "), F.trim(tail))).otherwise("")
    own = F.when(other.isNotNull(), other).when(same & F.col("_last").isNotNull(), F.struct(F.col("_last.name").alias("name"), same_tail.alias("tail"), F.col("_last.kind").alias("kind")))
    own = F.coalesce(own, F.when(F.col("_amended").isNotNull() & w.isNull() & F.col("_para").isNull(), F.struct(F.col("_amended").alias("name"), F.lit("").alias("tail"), F.lit("named").alias("kind"))))
    d = d.withColumn("_own", own).withColumn("_run", F.sum(opens.cast("int")).over(until))
    run = Window.partitionBy(*key, "_run").orderBy("_at")
    d = d.withColumn("_of", F.first("_own").over(run))
    article_of = F.struct(F.substring_index("_art", ".", 1).alias("a"), F.col("_of").alias("of"))
    listed = F.last(F.when(F.col("_art").isNotNull(), article_of), ignorenulls=True)
    d = d.withColumns({"_list": listed.over(run), "_prev": listed.over(before)})

    back = F.when(w.rlike(f"^{loose('같은 조')}$"), F.col("_prev")).when(F.col("_joined"), F.col("_list"))
    here = F.struct(F.substring_index("path", ".", 1).alias("a"), F.lit(None).cast("struct<name:string,tail:string,kind:string>").alias("of"))
    lone = F.when(F.col("_para").isNotNull(), F.coalesce(back, here))
    number = F.when(F.col("_para") == "전", (F.regexp_extract("path", "\\.p([0-9]+)", 1).try_cast("int") - 1).cast("string")).otherwise(F.col("_para"))
    of = F.when(F.col("_para").isNotNull(), lone["of"]).otherwise(F.col("_of"))
    target = F.coalesce("_art", "_annex", F.concat(lone["a"], F.lit(".p"), number))
    kind = F.when(F.col("_deleg"), F.when(F.col("_name").isNotNull(), "delegation_named").otherwise("delegation")).when(F.col("_annex").isNotNull(), F.when(of.isNotNull(), "named_annex").otherwise("annex"))
    after = F.col("after")
    foreign = of.isNotNull()
    particle, verb = F.regexp_extract(after, FOLLOWS, 1), F.regexp_extract(after, FOLLOWS, 2)
    based = foreign & particle.isin(AT) & verb.isin(BASED)
    carries_out = foreign & ((particle.isin(FROM) & verb.isin(HANDED)) | (based & verb.isin(ENACTING) & ((F.col("path") == "a1") | (F.trim("_h") == PURPOSE))))
    rel = F.when(F.col("_deleg"), "DELEGATION").when(F.col("_annex").isNotNull(), "CITATION").when(carries_out, "IMPLEMENTS")
    rel = rel.when(after.rlike("^\\s*" + maybe("의\\s*규정\\s*") + EXCEPTION), "EXCEPTION").when(after.rlike(MUTATIS), "MUTATIS").when(based, "BASIS").otherwise("CITATION")
    first = (F.col("_para") == "전") & (F.coalesce(number.try_cast("int"), F.lit(0)) < 1)
    d = d.withColumns({"kind": F.coalesce(kind, of["kind"], F.lit("internal")), "_base": F.when(F.col("_deleg"), F.col("_name")).otherwise(of["name"]), "_tail": F.when(F.col("_deleg"), "").otherwise(of["tail"]), "target": target, "rel": rel})
    clause = F.col("_form") & F.col("_art").isNotNull() & of.isNull() & ~F.col("_next").rlike(BELONGS)
    d = d.filter(~F.coalesce(clause, F.lit(False))).filter(~F.col("_amends") & ~F.coalesce(first, F.lit(False)) & (place | F.col("_deleg") | F.col("_name").isNotNull()))
    return d.withColumn("place", F.row_number().over(until)).select(*key, "place", "kind", "_base", "_tail", "target", "rel")


CITED_AFTER = re.compile(CITED.replace("[가-힣A-Za-z0-9&&[^은는고며]]", ".")).groups
