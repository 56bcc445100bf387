"""Quotes, quantities, deadlines and notes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolex.functions.text import squash

#: A quantity with its unit; a month has 28 to 31 days (fixed values).
QUANTITY = "[0-9]+(?:\\.[0-9]+)? ?(?:days?|weeks?|months?|years?|%)"
LIMIT = "([0-9]+) ?(day|week|month)s?"
DAYS_OF = {"day": (1, 1), "week": (7, 7), "month": (28, 31)}
NOTE = "<(?:Amended|New|Deleted)[^<>]*>"


def verbatim(quote: Column, text: Column) -> Column:
    """The piece of the text that equals the quote but for white space, as the text has it; null without one or for a blank quote."""
    letters = F.regexp_extract_all(squash(quote), F.lit("(?s)."), F.lit(0))
    pattern = F.array_join(F.transform(letters, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "\\s*")
    return F.when(F.size(letters) > 0, F.regexp_substr(text, pattern))


def quote_span(quote: Column, text: Column) -> Column:
    """struct(start, end) of the quote in code points from 0, white space aside; null without one."""
    piece = verbatim(quote, text)
    start = F.position(piece, text) - 1
    return F.when(piece.isNotNull(), F.struct(start.alias("start"), (start + F.char_length(piece)).alias("end")))


def quantities(text: Column, pattern: str = QUANTITY) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def value_change(before: Column, after: Column, pattern: str = QUANTITY) -> Column:
    """``a → b`` if exactly one quantity went and one came, else null."""
    a, b = quantities(before, pattern), quantities(after, pattern)
    gone, come = F.filter(a, lambda x: ~F.array_contains(b, x)), F.filter(b, lambda x: ~F.array_contains(a, x))
    return F.when((F.size(gone) == 1) & (F.size(come) == 1), F.concat(gone[0], F.lit(" → "), come[0]))


def deadline_verdict(elapsed: Column, text: Column) -> Column:
    """met, missed or conditional (within what the length of months leaves open) by the only limit in the text; null if it has none or several."""
    n, unit = F.regexp_extract_all(text, F.lit(LIMIT), F.lit(1)), F.regexp_extract_all(text, F.lit(LIMIT), F.lit(2))
    days = lambda k: lambda x, u: x.cast("long") * reduce(lambda c, i: c.when(u == i[0], i[1][k]), DAYS_OF.items(), F.when(F.lit(False), 0))
    spans = F.array_distinct(F.arrays_zip(F.zip_with(n, unit, days(0)).alias("least"), F.zip_with(n, unit, days(1)).alias("most")))
    only = F.get(spans, F.lit(0))
    verdict = F.when(elapsed <= only["least"], "met").when(elapsed > only["most"], "missed").otherwise("conditional")
    return F.when((F.size(spans) == 1) & elapsed.isNotNull(), verdict)


def split_notes(text: Column, pattern: str = NOTE) -> Column:
    """struct(text, notes): amendment notes taken out, the rest with single blanks."""
    rest = F.btrim(F.regexp_replace(F.regexp_replace(text, pattern, " "), "\\s+", " "))
    return F.struct(rest.alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("notes"))


def yes_no(value: Column, yes: list[str], no: list[str]) -> Column:
    """True or false for a word of these (white space, case and a last full stop aside), else null."""
    v = F.lower(F.regexp_replace(squash(F.coalesce(value, F.lit(""))), "\\.$", ""))
    return F.when(v.isin(yes), True).when(v.isin(no), False)


def _sizes(text: Column, most: bool) -> Column:
    n, unit = F.regexp_extract_all(text, F.lit(LIMIT), F.lit(1)), F.regexp_extract_all(text, F.lit(LIMIT), F.lit(2))
    return F.zip_with(n, unit, lambda x, u: x.cast("long") * reduce(lambda c, i: c.when(u == i[0], i[1][most]), DAYS_OF.items(), F.when(F.lit(False), 0)))


def value_supported(value: Column, quote: Column) -> Column:
    """Whether the first quantity of a value is one of its quote's; a value without quantities rests on its words, so it is. A null quote supports no quantity."""
    same = lambda c: F.transform(quantities(F.coalesce(c, F.lit(""))), lambda x: F.regexp_replace(F.regexp_replace(x, " ", ""), "s$", ""))
    first = F.get(same(value), F.lit(0))
    return first.isNull() | F.array_contains(same(quote), F.coalesce(first, F.lit("")))


def in_bounds(value: Column, least: Column, most: Column) -> Column:
    """Whether one of the spans of a value has between so many days (a month has 31); without a span there is nothing to hold against; a null bound is none."""
    spans = _sizes(F.coalesce(value, F.lit("")), True)
    return (F.size(spans) == 0) | F.exists(spans, lambda n: F.coalesce(n >= least, F.lit(True)) & F.coalesce(n <= most, F.lit(True)))
