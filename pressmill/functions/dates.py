"""Dates of feed items, ages and cutoffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

MAX_AGE_DAYS = 14
#: Months by their first letters, zones by their hours from UTC, and the years that two digits mean.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
CENTURY = {(0, 49): 2000, (50, 99): 1900}

_zone = "|".join(sorted(ZONES, key=len, reverse=True))
_TIME = r"(?<![\d:])(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d+))?)?(?![\d:])\s*(?:(am|pm)(?![a-z]))?"
_MONTH = rf"(?<![a-z])({'|'.join(MONTHS)})[a-z]*"
_ZONE = rf"(?<![a-z])({_zone})(?![a-z])"
#: A distance from UTC stands behind a time or a zone.
_OFFSET = rf"(?:(?<![\d:])\d{{1,2}}:\d{{1,2}}(?::\d{{1,2}}(?:[.,]\d+)?)?\s*(?:(?:am|pm)\s*)?(?:(?:{_zone})\s*)?|(?<![a-z])(?:{_zone})\s*)([+-])(\d{{1,2}}):?(\d{{2}})?(?!\d)"


def parse_date(text: Column) -> Column:
    """An instant as browsers' scripts read dates, else null; what names no zone is UTC.

    Words, numbers and signs may stand in any order that tells what they are: a month's name or number, a day, a year
    (four digits or two), a time, a zone. A number above 31 in front is the year; of numbers alone the month comes
    first. What is left out is one (of a time: zero). What stands in brackets and words before the first number say
    nothing; other unknown words make it no date. A day that its month lacks runs on into the next.
    """
    bare = F.lower(F.trim(F.regexp_replace(text, r"\([^()]*\)", " ")))
    return once(bare, lambda x: once(_parts(x), lambda p: _instant(p)))


def _parts(x: Column) -> Column:
    """What a date is made of: texts, empty where it has none; numbers beside its time; and whether it has other words."""
    part = lambda pattern, k: F.regexp_extract(x, pattern, k)
    days = F.regexp_replace(F.regexp_replace(x, rf"(?<=\d)t(?=\d)|{_OFFSET}", " "), rf"{_TIME}|{_ZONE}|{_MONTH}", " ")
    told = {"hour": part(_TIME, 1), "minute": part(_TIME, 2), "second": part(_TIME, 3), "fraction": part(_TIME, 4), "half": part(_TIME, 5)}
    told |= {"month": part(_MONTH, 1), "zone": part(_ZONE, 1), "sign": part(_OFFSET, 1), "hours": part(_OFFSET, 2), "minutes": part(_OFFSET, 3)}
    numbers = F.transform(F.regexp_extract_all(days, F.lit(r"\d+"), F.lit(0)), lambda n: F.coalesce(n.try_cast("int"), F.lit(1 << 30)))
    odd = days.rlike(r"\d[^a-z]*[a-z]") | days.contains(":")
    return F.struct(*[v.alias(k) for k, v in told.items()], numbers.alias("n"), odd.alias("odd"))


def _instant(p: Column) -> Column:
    whole = lambda name: F.coalesce(p[name].try_cast("int"), F.lit(0))
    nth = lambda i: F.coalesce(F.get(p["n"], F.lit(i)), F.lit(1))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), p["month"]).cast("int")
    large = ~nth(0).between(1, 31)  # no day, so the year
    month = F.when(named > 0, named).otherwise(F.when(large, nth(1)).otherwise(nth(0)))
    day = F.when(named > 0, F.when(large, nth(1)).otherwise(nth(0))).otherwise(F.when(large, nth(2)).otherwise(nth(1)))
    year = F.when(large, nth(0)).otherwise(F.when(named > 0, nth(1)).otherwise(nth(2)))
    for (lo, hi), base in CENTURY.items():
        year = F.when(year.between(lo, hi), year + base).otherwise(year)
    hour = F.when(p["half"] == "", whole("hour")).otherwise(whole("hour") % 12 + F.when(p["half"] == "pm", 12).otherwise(0))
    right = F.when(p["half"] == "", (whole("hour") < 24) | (whole("hour") == 24) & (whole("minute") + whole("second") == 0)).otherwise(whole("hour").between(0, 12))
    right &= month.between(1, 12) & day.between(1, 31) & year.between(1, 9999) & F.size(p["n"]).between(1, 3) & (whole("minute") < 60) & (whole("second") < 60) & ~p["odd"]
    away = F.when(p["sign"] != "", F.when(p["sign"] == "-", -1).otherwise(1) * (whole("hours") * 60 + whole("minutes")))
    zone = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for z, h in ZONES.items() for x in (z, 60 * h)]), F.nullif(p["zone"], F.lit(""))), F.lit(0))
    days = F.unix_date(F.make_date(F.when(right, year), month, F.lit(1))) + day - 1
    seconds = days.cast("long") * 86400 + hour * 3600 + whole("minute") * 60 + whole("second") - F.coalesce(away, zone) * 60
    millis = F.coalesce(F.substring(F.rpad(p["fraction"], 3, "0"), 1, 3).try_cast("int"), F.lit(0))
    return F.timestamp_millis(F.when(right, seconds * 1000 + millis))


def published_at(iso: Column, pub: Column) -> Column:
    """The ISO date if there is one, else the other; one that can't be read is null and has no substitute."""
    return parse_date(F.coalesce(F.nullif(iso, F.lit("")), F.nullif(pub, F.lit(""))))


def cutoff(now: Column, days: int = MAX_AGE_DAYS) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def is_fresh(when: Column, since: Column) -> Column:
    """Not before the cutoff; unknown and future dates are fresh."""
    return when.isNull() | (when >= since)


def minutes_old(when: Column, now: Column) -> Column:
    """Whole minutes; a date that is missing counts from the epoch."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.coalesce(F.unix_seconds(when.cast("timestamp")), F.lit(0))
    return F.floor(seconds / 60)


def days_left(end: Column, now: Column) -> Column:
    """Whole days, cut off toward zero."""
    return ((F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 86400).cast("bigint")


def stamp(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd_HH-mm-ss")
