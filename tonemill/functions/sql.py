"""The engine's functions in SQL: table functions over pages, for LATERAL joins, and scalar functions with the native expressions as their bodies.

``register`` makes them known to a session:

* ``calendar_entries(html, kind, site)``: (at, label, year, dates, month, links, text) of a calendar page, ``kind`` archive or recent;
* ``page_paragraphs(html)``: (i, paragraph);
* ``event_kind(label)``, ``month_number(name)``, ``url_day(url)``: SQL functions, which Spark inlines, so they cost what the expressions cost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dates
from .html import archive_entries, html_to_paragraphs, recent_entries


class CalendarEntries:
    """A row for each entry of a calendar page; none for a null page."""

    def eval(self, html: str, kind: str, site: str) -> Iterator[tuple]:
        read = {"archive": archive_entries, "recent": recent_entries}.get(kind)
        if read is None:
            raise ValueError(f"unknown kind of calendar: {kind}")
        for at, e in enumerate(read(html, site)):
            yield at, e["label"], e["year"], e["dates"], e["month"], [{"href": a, "text": b} for a, b in e["links"]], e["text"]


class PageParagraphs:
    """A row for each paragraph of a page; none for a null page."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from enumerate(html_to_paragraphs(html, True))


ENTRY = "at int, label string, year int, dates string, month string, links array<struct<href:string,text:string>>, text string"
SCALARS = {"event_kind": ("label", "string", dates.classify_event), "month_number": ("name", "int", dates.month_number), "url_day": ("url", "date", dates.date_in_url)}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; those of the same names are replaced."""
    spark.udtf.register("calendar_entries", F.udtf(CalendarEntries, returnType=ENTRY))
    spark.udtf.register("page_paragraphs", F.udtf(PageParagraphs, returnType="i int, paragraph string"))
    for name, (argument, kind, make) in SCALARS.items():
        analyzed = spark.createDataFrame([], f"{argument} string").select(make(F.col(argument)))._jdf.queryExecution().analyzed()
        body = analyzed.expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} STRING) RETURNS {kind} RETURN {body}")
