"""Release times and decisions. Times are minutes after midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import group

# How release times, press releases and decisions are worded.
TIME = r"(\d{1,2})(?::(\d{2}))?\s*([ap])\.?\s*m\.?"
PAGE_TIME = rf"(?iU)For release at\s+{TIME}"
MINUTES_TIME = rf"(?iU)statement[^.]{{0,80}}?(?:to be\s+)?(?:released|for release)\s+at\s+{TIME}"
OTHER_DAY = r"(?U)^\s*(?:\(EDT\)|\(EST\)|EDT|EST)?\s*,?\s*on\s+\w+day"
PRESS_TITLE = r"(?i)Minutes of (the )?Federal Open Market Committee"
RAISE = r"(?iU)\b(decided|voted|agreed)\b[^.]{0,80}\b(raise|increase|firm)"
LOWER = r"(?iU)\b(decided|voted|agreed)\b[^.]{0,80}\b(lower|reduce|cut|ease)"
HOLD = r"(?iU)\b(decided|voted|agreed)\b[^.]{0,80}\b(maintain|keep|leave)"
SUFFIXES = "abcde"


def minutes_of_day(hour: Column, minute: Column, half: Column) -> Column:
    """Minutes after midnight from a twelve-hour clock; a missing minute is 0; null if there is no such minute."""
    m = F.coalesce(F.nullif(minute, F.lit("")).cast("int"), F.lit(0))
    value = (hour.cast("int") % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)) * 60 + m
    return F.when(m < 60, value)


def time_on_page(paragraphs: Column, top: int = 12) -> Column:
    """The release time that a page prints in its first paragraphs."""
    hit = F.get(F.filter(F.slice(paragraphs, 1, top), lambda p: p.rlike(PAGE_TIME)), F.lit(0))
    return minutes_of_day(group(hit, PAGE_TIME, 1), F.regexp_extract(hit, PAGE_TIME, 2), group(hit, PAGE_TIME, 3))


def times_in_minutes(paragraphs: Column) -> Column:
    """All release times of statements that minutes mention for the same day, in order."""
    text = F.array_join(paragraphs, " ")
    every = lambda k: F.regexp_extract_all(text, F.lit(MINUTES_TIME + "(?=(.{0,40}))"), F.lit(k))
    rows = F.arrays_zip(every(1).alias("h"), every(2).alias("m"), every(3).alias("p"), every(4).alias("tail"))
    same_day = F.filter(rows, lambda r: ~r["tail"].rlike(OTHER_DAY))
    return F.transform(same_day, lambda r: minutes_of_day(r["h"], r["m"], r["p"]))


def clock(minutes: Column) -> Column:
    """HH:mm:ss of minutes after midnight."""
    return F.format_string("%02d:%02d:00", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def _found(time, source, note) -> Column:
    return F.struct(time.cast("int").alias("time"), F.lit(source).alias("source"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))


def resolve_statement_time(statement: Column, minutes: Column) -> Column:
    """(time, source, note): the page's own time, else the one time that the minutes mention."""
    page = time_on_page(statement)
    distinct = F.array_sort(F.array_distinct(F.coalesce(times_in_minutes(minutes), F.array().cast("array<int>"))))
    none = F.lit(None)
    return (
        F.when(page.isNotNull(), _found(page, "statement_page", ""))
        .when(F.size(distinct) == 1, _found(F.get(distinct, F.lit(0)), "minutes", ""))
        .when(F.size(distinct) > 1, _found(none, "unverified", F.concat(F.lit("ambiguous times in minutes: "), F.array_join(F.transform(distinct, clock), ","))))
        .otherwise(_found(none, "unverified", "no time found"))
    )


def press_release_urls(day: Column) -> Column:
    """The addresses at which a day's press releases may stand, in order."""
    stamp = F.date_format(day, "yyyyMMdd")
    return F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(F.lit("/newsevents/pressreleases/monetary"), stamp, s, F.lit(".htm")))


def minutes_time(paragraphs: Column, found: Column) -> Column:
    """(time, source, note) of minutes from the press release that announces them (``found``: there is one)."""
    t = time_on_page(paragraphs)
    none = F.lit(None)
    return (
        F.when(~found, _found(none, "unverified", "no minutes press release found"))
        .when(t == 0, _found(none, "unverified", "press release says 12:00 a.m. (implausible)"))
        .when(t.isNotNull(), _found(t, "minutes_press_release", ""))
        .otherwise(_found(none, "unverified", "press release has no time"))
    )


def decision(text: Column) -> Column:
    """raise, lower, hold or unclear, from the first sentence that tells."""
    kinds = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=\.)\s+"), lambda s: F.when(s.rlike(RAISE), "raise").when(s.rlike(LOWER), "lower").when(s.rlike(HOLD), "hold"))
    return F.coalesce(F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0)), F.lit("unclear"))
