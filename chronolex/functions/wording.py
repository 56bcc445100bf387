"""Labels, names and answers in the wording of regulations, as column expressions; words and patterns are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolex.functions.patterns import loose, one_of, word_ending

#: Glyphs of word processors and what they stand for (fixed values).
GLYPHS = {"\U000f0852": "“", "\U000f0853": "”", "\uf09e": "·", "\U000f02ea": "·", "\uf06f": "□", "\uf0fe": "☑", "\uf0a1": "○", "\uf0a7": "▪", "\uf06d": "❍", "\U000f0099": "~", "\U000f012b": "", "\U000f0036": "→", "\U000f03c5": "□"}
QUOTE, RULED = "\uf000", "[\\x{f0800}-\\x{f08ff}\\x{f000}]{3,}"
#: Parts of a path with their labels (fixed values).
SEGMENTS = (
    ("^supp.*$", "부칙"), ("^annex([0-9]+)$", "별표 $1"), ("^form([0-9]+)$", "별지 제$1호 서식"), ("^c([0-9]+)$", "제$1장"), ("^a([0-9]+)-([0-9]+)$", "제$1조의$2"), ("^a([0-9]+)$", "제$1조"),
    ("^p([0-9]+)$", "제$1항"), ("^i([0-9]+)-([0-9]+)$", "제$1호의$2"), ("^i([0-9]+)$", "제$1호"), ("^s(.)$", "$1목"),
)
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
#: A letter of a name; what names of rules and of statutes end with (fixed values).
LETTER = "[가-힣A-Za-z0-9·ㆍ]"
RULE_ENDINGS = "규정 규칙 요령 지침 세칙 기준 예규 훈령 고시 내규 정관 편람 강령".split()
LAW_ENDINGS = "법률 법 시행령".split()
#: Names that say nothing of which statute, and endings of statutes' names (fixed values).
BARE_LAWS = ["법", "영", "법률", "시행령", "시행규칙"]
LAW_ENDING = "(법|법률|령|시행규칙)$"


def glyphs(text: Column) -> Column:
    """Known glyphs by characters, ruled lines by a blank, and the paired quote glyph by quotes in turn where it is even in number, else by blanks."""
    t = F.regexp_replace(text, RULED, " ")
    for glyph, character in GLYPHS.items():
        t = F.replace(t, F.lit(glyph), F.lit(character))

    def turned(x: Column) -> Column:
        n = F.size(x["parts"])
        paired = F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.when(i == n - 1, "").when(i % 2 == 0, "“").otherwise("”"))), "")
        return F.when(n % 2 == 1, paired).otherwise(F.array_join(x["parts"], " "))

    # As a lambda's variable the parts are computed once, not for each of them.
    return F.transform(F.array(F.struct(F.split(t, QUOTE).alias("parts"))), turned)[0]


def path_label(path: Column) -> Column:
    """a12-2.p3 as 제12조의2 제3항; a path with a part that isn't known stays as it is."""

    def label(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, words in reversed(SEGMENTS):
            out = F.when(part.rlike(pattern), F.regexp_replace(part, pattern, words)).otherwise(out)
        return out

    parts = F.transform(F.split(path, "[./]"), lambda x: label(F.split_part(x, F.lit("~"), F.lit(1))))
    return F.when(F.coalesce(path, F.lit("")) == "", "전체").when(F.exists(parts, lambda x: x.isNull()), path).otherwise(F.array_join(parts, " "))


def unit_label(unit: Column, label: Column) -> Column:
    """① as 제1항, 3. as 제3호, 4의2. as 제4호의2, 가. as 가목; others stay."""
    t = F.trim(label)
    place = F.position(F.substring(t, 1, 1), F.lit(CIRCLED))
    paragraph = F.when((unit == "paragraph") & (F.char_length(t) == 1) & (place > 0), F.concat(F.lit("제"), place.cast("string"), F.lit("항")))
    item = F.when((unit == "item") & t.rlike("^[0-9]+의[0-9]+\\.?$"), F.regexp_replace(t, "^([0-9]+)의([0-9]+)\\.?$", "제$1호의$2")).when((unit == "item") & t.rlike("^[0-9]+\\.?$"), F.regexp_replace(t, "^([0-9]+)\\.?$", "제$1호"))
    return F.coalesce(paragraph, item, F.when((unit == "subitem") & t.rlike("^[가-힣]\\.?$"), F.concat(F.substring(t, 1, 1), F.lit("목"))), t)


def law_pending(kind: Column, name: Column) -> Column:
    """Whether a reference waits for its statute: it has a statute's name that is not a bare one."""
    return (kind == "REFERENCE") & ~F.coalesce(name.isin(BARE_LAWS), F.lit(True)) & F.regexp_replace(name, "\\s", "").rlike(LAW_ENDING)


def in_scope(name: Column, endings: list[str], without: list[str], without_endings: list[str]) -> Column:
    """Whether a name (white space aside) has one of the endings and is none of the excluded ones."""
    n = F.regexp_replace(F.coalesce(name, F.lit("")), "\\s", "")
    ends = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.endswith(n, x)) if xs else F.lit(False)
    return (n != "") & ~n.isin(without) & ~ends(without_endings) & ends(endings)


def answer_mode(question: Column, has_days: Column, patterns: dict[str, str]) -> Column:
    """judgment or general: patterns has fact, permit, ask_ok, asks and info."""
    q = F.coalesce(question, F.lit(""))
    is_ = {k: q.rlike(v) for k, v in patterns.items()}
    fact = has_days | is_["fact"]
    return F.when(is_["permit"] | (fact & (has_days | is_["ask_ok"] | ~is_["asks"])), "judgment").otherwise("general")


#: How a name is shortened: the name in brackets or as a word, or a decree of the same law; then the abbreviation in quotes.
SHORTENED = (
    f"(?:「([^」]+)」|{loose('같은 법')}\\s?(시행령|시행규칙)|({word_ending(one_of(RULE_ENDINGS + LAW_ENDINGS), LETTER)}))"
    "\\s*\\(\\s?이하\\s*[“\"‘']\\s?([^”\"’']{1,20}?)\\s?[”\"’']\\s?이?라\\s?(?:한다|함)\\s?\\)"
)


def definitions(text: Column) -> Column:
    """Array of (abbreviation, name) that a text defines: 「name」 or a name in one word, (이하 “abbreviation”이라 한다).

    A decree of the same law is that of the name defined before it; without one it is nothing.
    """
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(SHORTENED), F.lit(k)).alias(n) for k, n in enumerate(("bracket", "decree", "word", "short"), 1)])
    kind = "array<struct<abbreviation:string,name:string>>"
    state = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast(kind).alias("out"))

    def step(so_far: Column, x: Column) -> Column:
        own = F.trim(F.when(x["bracket"] != "", x["bracket"]).when(x["word"] != "", x["word"]))
        name = F.coalesce(own, F.concat(so_far["last"], F.lit(" "), x["decree"]))
        more = F.array(F.struct(F.trim(x["short"]).alias("abbreviation"), name.alias("name"))).cast(kind)
        return F.struct(F.coalesce(own, so_far["last"]).alias("last"), F.when(name.isNull(), so_far["out"]).otherwise(F.concat(so_far["out"], more)).alias("out"))

    return F.aggregate(found, state, step, lambda x: x["out"])


def terms(text: Column) -> Column:
    """Array of (term, definition) of the sentences that define a term of two letters or more: “term”이란 ... 말한다."""
    found = F.regexp_extract_all(text, F.lit("“[^”]+”이?란 [^.]*말한다"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, "“([^”]+)”", 1)).alias("term"), F.trim(x).alias("definition")))
    return F.filter(pairs, lambda x: F.char_length(x["term"]) >= 2)


def purpose(text: Column) -> Column:
    """What a purpose clause says, the statutes that it cites by name aside; empty for other clauses."""
    said = F.regexp_extract(text, "\\(목적\\)\\s*([^\\n]*)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(said, "「[^」]*」(\\s*제[0-9]+조)?", " "), "\\s+", " "))


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of a claim that the evidence does not have."""
    of = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(of(claim), of(evidence)))
