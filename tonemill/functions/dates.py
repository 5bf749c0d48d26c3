"""Calendar parsing: months, event kinds, date spans, release dates, addresses with dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Month names as calendars print them, and addresses of statements and minutes.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
STATEMENT_HREF = (
    r"(?i)(/newsevents/press(?:releases)?/monetary/?\d{8}[a-z]\d?\.htm"
    r"|/boarddocs/press/(?:monetary|general)/\d{4}/\d{8}/(?:default\.htm)?"
    r"|/fomc/\d{8}default\.htm)$"
)
MINUTES_HREF = r"(?i)(/monetarypolicy/fomc(?:minutes)?\d{8}\.htm|/fomc/minutes/(?:\d{4}/)?\d{8}(?:min)?\.htm)$"
RELEASED = r"(?U)Released\s+([A-Z][a-z]+)\.?\s+(\d{1,2}),\s*(\d{4})"
PAGE_DATE = rf"(?U)({MONTH})\s+(\d{{1,2}}),\s*(\d{{4}})"


def group(text: Column, pattern: str, k: int) -> Column:
    """Group ``k`` of the first match; null without one or if the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def month_number(name: Column) -> Column:
    """Month from its first three letters in any case; null if unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(F.btrim(name), F.lit(3)))).cast("int"), F.lit(0))


def make_day(year: Column, month: Column, day: Column) -> Column:
    """A date; null if there is none such."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def classify_event(label: Column) -> Column:
    """Kind of an event from its label; the first that applies."""
    low = F.lower(label)
    return (
        F.when(low.contains("cancel"), "cancelled").when(low.contains("notation vote"), "notation_vote").when(low.contains("conference call"), "conference_call")
        .when(low.contains("unscheduled"), "unscheduled").otherwise("scheduled")
    )


def date_span(text: Column, year: Column, default_month: Column | None = None) -> Column:
    """(start, end) of a printed span such as ``January 30-31``, ``Apr/May 30-1``, ``30-1`` (with a default month) or
    ``22``; null if it can't be read, null dates if they don't exist."""
    default = F.coalesce(default_month, F.lit("")) if default_month is not None else F.lit("")
    plain = F.regexp_replace(F.btrim(F.regexp_replace(text, r"\(.*?\)|\*", "")), "[–—]", "-")
    form = rf"(?U)^(?:({MONTH})\s+)?(\d{{1,2}})(?:\s*-\s*(?:({MONTH})\s+)?(\d{{1,2}}))?"

    def cut(x):
        both = group(x["t"], rf"(?U)^({MONTH}/{MONTH})\s+", 1)
        return F.struct(F.regexp_replace(x["t"], rf"(?U)^{MONTH}/{MONTH}\s+", "").alias("rest"), F.split(F.coalesce(both, x["d"]), "/").alias("months"), x["y"].alias("y"))

    def read(x):
        return F.struct(*[group(x["rest"], form, k).alias(n) for k, n in enumerate(("m1", "d1", "m2", "d2"), 1)], x["months"].alias("months"), x["y"].alias("y"))

    def months(x):
        start = month_number(F.coalesce(x["m1"], F.get(x["months"], F.lit(0))))
        second = F.when(x["m2"].isNotNull(), month_number(x["m2"])).when((F.size(x["months"]) == 2) & x["m1"].isNull(), month_number(F.get(x["months"], F.lit(1))))
        return F.struct(start.alias("start"), second.alias("second"), x["d1"].alias("d1"), x["d2"].alias("d2"), x["y"].alias("y"))

    def made(x):
        first = make_day(x["y"], x["start"], x["d1"])
        last = F.when(x["d2"].isNull(), first).otherwise(make_day(x["y"], F.coalesce(x["second"], x["start"]), x["d2"]))
        return F.when(x["d1"].isNotNull() & x["start"].isNotNull(), F.struct(first.alias("start"), last.alias("end")))

    return let(let(let(let(F.struct(plain.alias("t"), year.alias("y"), default.alias("d")), cut), read), months), made)


def release_date(text: Column) -> Column:
    """The date after ``Released``; null if there is none."""
    return make_day(group(text, RELEASED, 3), month_number(group(text, RELEASED, 1)), group(text, RELEASED, 2))


def date_in_url(url: Column) -> Column:
    """The first eight digits of an address as a date; null if there are none or they are no date."""
    return F.try_to_date(group(url, r"(\d{8})", 1), "yyyyMMdd")


def page_date(paragraphs: Column, top: int = 8) -> Column:
    """The first printed date in the first paragraphs."""
    hit = F.get(F.filter(F.slice(paragraphs, 1, top), lambda p: p.rlike(PAGE_DATE)), F.lit(0))
    return make_day(group(hit, PAGE_DATE, 3), month_number(group(hit, PAGE_DATE, 1)), group(hit, PAGE_DATE, 2))


def in_new_york(day: Column, minutes: Column) -> Column:
    """The instant of a day and minutes after midnight in New York; null if either is."""
    made = F.make_timestamp(F.year(day), F.month(day), F.day(day), (minutes / 60).cast("int"), minutes % 60, F.lit(0), F.lit("America/New_York"))
    return F.when(day.isNotNull() & minutes.isNotNull(), made)


def pick_urls(links: Column, text: Column) -> Column:
    """(statement_url, minutes_url, minutes_release_date) of a calendar entry's links and text."""
    first = lambda cond: F.get(F.filter(links, cond), F.lit(0))["href"]
    after = F.substr(text, F.greatest(F.instr(text, "Minutes"), F.lit(1)))
    return F.struct(
        first(lambda x: x["href"].rlike(STATEMENT_HREF)).alias("statement_url"),
        first(lambda x: ~x["href"].contains("#") & x["href"].rlike(MINUTES_HREF)).alias("minutes_url"),
        release_date(after).alias("minutes_release_date"),
    )
