"""Dates, spans of time and money in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of units of time where only bounds matter (fixed values).
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def dotted_date(text: Column) -> Column:
    """``2024. 3. 1.``, ``'24.3.1`` (from 50 on: last century), ``20240301``, ``2024-03-01``; null if impossible."""
    t = F.btrim(text)
    year = F.regexp_extract(t, "^'?([0-9]{2,4})\\s*[./-]\\s*([0-9]{1,2})\\s*[./-]\\s*([0-9]{1,2})\\.?$", 1)
    part = lambda k: F.lpad(F.regexp_extract(t, "^'?([0-9]{2,4})\\s*[./-]\\s*([0-9]{1,2})\\s*[./-]\\s*([0-9]{1,2})\\.?$", k), 2, "0")
    whole = F.when(F.length(year) == 4, year).when((F.length(year) == 2) & (F.try_to_number(year, F.lit("99")) >= 50), F.concat(F.lit("19"), year)).when(F.length(year) == 2, F.concat(F.lit("20"), year))
    compact = F.when(t.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
    return F.try_to_date(F.coalesce(F.concat(whole, F.lit("-"), part(2), F.lit("-"), part(3)), compact), "yyyy-MM-dd")


def span_days(text: Column) -> Column:
    """Sum of ``3 weeks 2 days`` and the like in days; null without one."""
    total, any_found = F.lit(0), F.lit(False)
    for unit, days in DAYS.items():
        n = F.regexp_extract(text, f"([0-9]+) ?{unit}s?", 1)
        total = total + F.coalesce(n.try_cast("int"), F.lit(0)) * days
        any_found = any_found | (n != "")
    return F.when(any_found, total)


def sum_of_money(text: Column) -> Column:
    """``3 million 250 thousand`` as a number; null without one or with another currency's sign."""
    part = lambda u: F.coalesce(F.regexp_extract(text, f"([0-9]+) {u}", 1).try_cast("long"), F.lit(0))
    total = part("billion") * 1_000_000_000 + part("million") * 1_000_000 + part("thousand") * 1_000
    return F.when((total > 0) & ~text.rlike("[€£¥]"), total)
