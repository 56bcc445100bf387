"""Answers held against the evidence they cite: sources, quotes, numbers, deadlines, and the verdict against its explanation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators import alignment as A


@dataclass(frozen=True)
class Wording:
    """The words of one language that the checks look for; blanks in phrases may be missing in texts or be longer."""

    #: Units by what they are called, the longest first where one begins another; units of places in a text.
    units: tuple[str, ...] = ("주일", "개월", "만원", "천원", "원", "일", "주", "월", "년", "회", "시간", "%", "조", "항", "호")
    places: tuple[str, ...] = ("조", "항", "호")
    same: tuple[tuple[str, str], ...] = (("주일", "주"),)
    #: Units of deadlines with the least and the most days each has, and what follows them.
    spans: tuple[tuple[str, int, int], ...] = (("일", 1, 1), ("주일", 7, 7), ("주", 7, 7), ("개월", 28, 31), ("월", 28, 31))
    within: str = "이내"
    day: str = "일"
    #: Verdicts with phrases that an explanation of theirs must not have (fixed values).
    against: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("충족", ("기한을 넘", "기한이 지났", "기한을 지나", "초과하였", "위반", "늦었")),
        ("미충족", ("문제없", "문제가 없", "충족합니다", "기한 내에 있", "기한 안에 있", "기한 안입니다")),
    )
    #: Words that turn a sentence round, and the end of a sentence: a quote has as many of them as its source (fixed values).
    negations: tuple[str, ...] = ("아니", "않", "없", "못")
    sentence_end: str = "다."


KOREAN = Wording()
NUMBER = "[0-9]+(?:\\.[0-9]+)?"


def _phrase(phrase: str) -> str:
    """A phrase as a pattern: special characters stand for themselves, a blank for any white space or none."""
    return "".join("\\s*" if c == " " else c if c.isalnum() else "\\" + c for c in phrase)


def _one_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(_phrase(w) for w in words) + ")"


def _pairs(text: Column, pattern: str, wording: Wording) -> Column:
    """Distinct struct(n, unit) of a pattern with two groups, units by one name each."""
    t = F.coalesce(text, F.lit(""))

    def unit(u: Column) -> Column:
        for other, name in wording.same:
            u = F.when(u == other, name).otherwise(u)
        return u

    both = F.zip_with(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), lambda n, u: F.struct(n.alias("n"), unit(u).alias("unit")))
    return F.array_distinct(both)


def quantities(text: Column, wording: Wording = KOREAN) -> Column:
    """The numbers of a text with their units ('' without one)."""
    return _pairs(text, f"({NUMBER})\\s*({_one_of(wording.units)}?)", wording)


def deadlines(text: Column, wording: Wording = KOREAN) -> Column:
    """The limits of a text (a whole number, a unit of time, then 'within')."""
    return _pairs(text, f"([0-9]+)\\s*({_one_of([u for u, _, _ in sorted(wording.spans, key=lambda s: -len(s[0]))])})\\s*{_phrase(wording.within)}", wording)


def _days(limit: Column, least: bool, wording: Wording) -> Column:
    out = F.lit(None).cast("long")
    for unit, a, b in wording.spans:
        out = F.when(limit["unit"] == unit, limit["n"].cast("long") * (a if least else b)).otherwise(out)
    return out


def derived(text: Column, wording: Wording = KOREAN) -> Column:
    """Numbers that follow from the limits of a text: their days, the fewest and the most."""
    limits = deadlines(text, wording)
    of = lambda least: F.transform(limits, lambda x: _days(x, least, wording).cast("string"))
    return F.array_distinct(F.concat(of(True), of(False)))


def numbers_match(explanation: Column, evidence: Column, free: Column, wording: Wording = KOREAN) -> Column:
    """Whether an explanation's numbers are known.

    A number is if it is one of ``free`` (an array of strings), or stands in the evidence with the same unit, or stands there at all and is without a unit or
    the number of a place. A limit must be a limit of the evidence, or be one in days, whatever is free. Months have no one number of days.
    """
    said, shown = quantities(explanation, wording), quantities(evidence, wording)
    bare = F.transform(shown, lambda x: x["n"])
    plain = F.forall(said, lambda x: F.array_contains(free, x["n"]) | F.array_contains(shown, x) | (x["unit"].isin("", *wording.places) & F.array_contains(bare, x["n"])))
    limits = deadlines(evidence, wording)
    exact = F.filter(limits, lambda x: _days(x, True, wording) == _days(x, False, wording))
    in_days = F.transform(exact, lambda x: F.struct(_days(x, True, wording).cast("string").alias("n"), F.lit(wording.day).alias("unit")))
    return plain & F.forall(deadlines(explanation, wording), lambda x: F.array_contains(F.concat(limits, in_days), x))


def consistent(verdict: Column, explanation: Column, wording: Wording = KOREAN) -> Column:
    """False if an explanation says what its verdict rules out; nulls say nothing."""
    out = F.lit(True)
    for name, phrases in wording.against:
        out = F.when((verdict == name) & F.coalesce(explanation, F.lit("")).rlike(_one_of(phrases)), False).otherwise(out)
    return out


def verified(answers: DataFrame, cites: DataFrame, evidence: DataFrame, wording: Wording = KOREAN, coverage: float = 0.85) -> DataFrame:
    """(answer, citations_exist, quotes_match, numbers_match, consistent, dropped, problems): what is wrong with each answer.

    answers: answer, question, verdict, explanation, allowed (array of numbers that may be said, or null). cites: answer, id, quote; a null id cites
    nothing. evidence: answer, id, title, label, text, once per (answer, id). All sources of an answer must exist (and there must be one); one
    quote that aligns with its source is enough, the others are dropped; numbers are held against the sources that are left (against all if none is).
    """
    there = cites.join(evidence.withColumn("_there", F.lit(True)), ["answer", "id"], "left")
    pairs = A.aligned(there, "quote", "text", coverage, min_chars=1, one_line=True, counted=_one_of(wording.negations), tail="[^\\n]{0,30}?(?:" + _phrase(wording.sentence_end) + "|$)")
    kept = F.col("piece").isNotNull()
    source = F.concat_ws(" ", "title", "label", "text")
    # an answer cites a handful of sources, so they may be gathered
    own = pairs.groupBy("answer").agg(
        F.count("*").alias("_cites"), F.bool_and(F.col("_there").isNotNull()).alias("_exist"), F.count_if(kept).alias("_kept"),
        F.array_join(F.array_sort(F.collect_list(F.when(kept, source))), "\n").alias("_text"), F.array_join(F.array_sort(F.collect_list(source)), "\n").alias("_all"),
    )
    d = answers.join(own, "answer", "left").fillna(0, ["_cites", "_kept"])
    exist = F.coalesce("_exist", F.lit(False))
    held = F.when(exist, F.col("_kept")).otherwise(0)
    text = F.coalesce(F.when(held > 0, F.col("_text")).otherwise(F.col("_all")), F.lit(""))
    asked = F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(f"({NUMBER})"), F.lit(1))
    free = F.concat(asked, F.coalesce("allowed", F.array().cast("array<string>")), derived(text, wording))
    checks = {"citation": exist, "quote": held > 0, "number": numbers_match(F.col("explanation"), text, free, wording), "consistency": consistent(F.col("verdict"), F.col("explanation"), wording)}
    d = d.select("answer", *[c.alias(n) for n, c in checks.items()], (F.col("_cites") - held).alias("dropped"))
    problems = F.array_compact(F.array(*[F.when(~F.col(n), n) for n in checks]))
    names = {"citation": "citations_exist", "quote": "quotes_match", "number": "numbers_match", "consistency": "consistent"}
    return d.select("answer", *[F.col(k).alias(v) for k, v in names.items()], "dropped", problems.alias("problems"))
