"""Text functions as column expressions, so they stay in the JVM and reach whole-stage code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolex.operators.diff import bare

CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u200b-\\u200d\\u2060\\ufeff]"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"
PHONE = "\\+?[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}"
ADDRESS = "\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b"
CARD = "\\b[0-9]{16}\\b"


def clean(text: Column) -> Column:
    """Without control and zero-width characters; runs of blanks become one; trimmed. Line feeds stay."""
    t = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), "[ \\t\\u00a0\\u3000]+", " ")
    return F.btrim(F.regexp_replace(t, " ?\\n ?", "\n"), F.lit(" \n\t"))


def name_key(text: Column) -> Column:
    """Names are equal if they are so without white space and middle dots."""
    return bare(text)


def squash(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+", "")


def despace(line: Column) -> Column:
    """A line whose words are all single letters (four or more) is one word spelt out: its blanks go."""
    return F.when(line.rlike("^(?:\\S ){3,}\\S$"), F.replace(line, F.lit(" "))).otherwise(line)


def collapse_repeats(text: Column, least: int = 4) -> Column:
    """Runs of one character of ``least`` or more become a single one (letters and digits aside)."""
    return F.regexp_replace(text, "([^\\p{L}\\p{N}\\s])\\1{%d,}" % (least - 1), "$1")


def mask_personal(text: Column) -> Column:
    """E-mail, telephone, network addresses and card numbers by tokens."""
    for pattern, token in ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (ADDRESS, "[IP]"), (CARD, "[CARD]")):
        text = F.regexp_replace(text, pattern, token)
    return text


def defects(text: Column) -> dict[str, Column]:
    """Counts of what extraction leaves behind."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return {"controls": count(CONTROL), "replacements": count("\\ufffd"), "private_use": count("[\\ue000-\\uf8ff]"), "page_numbers": count("(?m)^[ \\t]*-? ?[0-9]{1,4} ?-?[ \\t]*$"), "long_runs": count("([^\\s])\\1{9,}")}


def snippet(text: Column, needle: Column, around: int = 40) -> Column:
    """The text around the first occurrence, case aside, with dots where it is cut; null without one."""
    at = F.position(F.lower(needle), F.lower(text))
    start, end = F.greatest(at - around, F.lit(1)), at + F.char_length(needle) + around
    cut = F.substring(text, start, end - start)
    out = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(end <= F.char_length(text), "…").otherwise(""))
    return F.when(at > 0, out)


def windows(head: Column, text: Column, size: int = 1200) -> Column:
    """Pieces of a long text: array of (no, piece). No 0 is the whole if head and text fit, else 1, 2, ... of equal room."""
    room = F.lit(size) - F.char_length(head) - 1
    n = F.ceil(F.char_length(text) / room).cast("int")
    many = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct(k.alias("no"), F.substring(text, ((k - 1) * room + 1).cast("int"), room.cast("int")).alias("piece")))
    return F.when(F.char_length(text) <= room, F.array(F.struct(F.lit(0).alias("no"), text.alias("piece")))).otherwise(many)


def numbers_of(path: Column) -> Column:
    """a12-2.p3.i4 as a struct of article, branch, paragraph, item; null where a part is absent."""
    part = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit("")).cast("int")
    return F.struct(part("^a([0-9]+)").alias("article"), part("^a[0-9]+-([0-9]+)").alias("branch"), part("\\.p([0-9]+)").alias("paragraph"), part("\\.i([0-9]+)").alias("item"))


def host_of(url: Column) -> Column:
    """Host of a web address in lower case, ``www.`` and ``m.`` aside."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), "^(www|m)\\.", "")


#: Tags of tables that stay, and the attributes they keep if these are numbers (fixed values).
TABLE_TAGS = "table|thead|tbody|tfoot|tr|td|th|caption|colgroup|col|br|p|span|b|strong|em|i|u|sub|sup|ul|ol|li|div"
SPANS = ("colspan", "rowspan")
TAG = "<[a-zA-Z/!](?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
SCRIPTS = "(?is)<(script|style)\\b[^>]*>.*?(</\\1\\s*>|$)|<!--.*?(-->|$)"
HANDLER = "(?i)\\s+on[a-z]+\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s>]+)"
SCRIPT_LINK = "(?i)(href|src)\\s*=\\s*(?:\"\\s*javascript:[^\"]*\"|'\\s*javascript:[^']*'|javascript:[^\\s>]*)"


def _by_tags(html: Column, tag: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    parts = F.regexp_extract_all(html, F.lit(f"(?s){TAG}|[^<]+|<"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"(?s)^{TAG}$"), tag(x)).otherwise(text(x))), "")


def allowed_html(html: Column) -> Column:
    """Only the tags of tables, without attributes but numeric spans; other tags go, scripts, styles and comments with what they hold; null stays null."""

    def tag(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, "^</?([a-zA-Z0-9]+)", 1))
        kept = [F.regexp_extract(x, f"(?i)\\s{a}\\s*=\\s*[\"']?([0-9]+)[\"'\\s/>]", 1) for a in SPANS]
        attributes = [F.when(v != "", F.concat(F.lit(f' {a}="'), v, F.lit('"'))).otherwise("") for a, v in zip(SPANS, kept, strict=True)]
        opened = F.concat(F.lit("<"), name, *attributes, F.lit(">"))
        closed = F.when(name.isin("br", "col"), "").otherwise(F.concat(F.lit("</"), name, F.lit(">")))
        return F.when(name.rlike(f"^(?:{TABLE_TAGS})$"), F.when(x.startswith("</"), closed).otherwise(opened)).otherwise("")

    return _by_tags(F.regexp_replace(html, SCRIPTS, ""), tag, lambda x: F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))


def harmless_html(html: Column) -> Column:
    """The page without scripts, event handlers, links that run a script and refreshes; all else stays."""

    def tag(x: Column) -> Column:
        calm = F.regexp_replace(F.regexp_replace(x, HANDLER, ""), SCRIPT_LINK, '$1="#"')
        return F.when(x.rlike("(?is)^<meta\\b.*http-equiv\\s*=\\s*[\"']?refresh"), "").otherwise(calm)

    return _by_tags(F.regexp_replace(html, "(?is)<script\\b[^>]*>.*?(</script\\s*>|$)", ""), tag, lambda x: x)
