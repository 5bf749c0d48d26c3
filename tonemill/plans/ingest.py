"""From calendar pages to meetings, and from meetings to cleaned documents. Pages come from a table (key, html)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, dates, release
from ..functions.html import entries_udf, limit_batches, paragraphs_udf
from ..functions.text import ordered_join, scoring_sentences, word_count
from ..functions.urls import SITE, absolute_url
from ..operators.report import audit_of, keep_first, logged, rule_counts
from ..sources import files
from ..sources.pages import look_up_roles


def parse_calendars(calendars: DataFrame, site: str = SITE) -> DataFrame:
    """Meetings of calendar pages given as (ord, year, url, kind, html), as printed and in page order (ord, at); null dates where none can be read."""
    limit_batches(calendars.sparkSession)

    def read(kind):
        rows = calendars.where(F.col("kind") == kind)
        return rows.select("ord", F.col("year").alias("page_year"), F.col("url").alias("source_page"), F.posexplode(entries_udf(kind, site)(F.col("html"))).alias("at", "e"))

    rows = read("archive").unionByName(read("recent"))
    label = F.col("e.label")
    head = F.regexp_replace(F.regexp_replace(label, r"(?U)\s*-\s*\d{4}\s*$", ""), r"(?U)\s+(Meeting|Conference Call)\b.*$", "")
    year = F.coalesce("e.year", "page_year")
    span = dates.date_span(F.coalesce("e.dates", head), year, F.col("e.month"))
    kind = dates.classify_event(label)
    out = rows.select("ord", "at", year.alias("year"), label.alias("label"), span.alias("span"), kind.alias("event_type"), (kind == "scheduled").alias("scheduled"), dates.pick_urls(F.col("e.links"), F.col("e.text")).alias("u"), "source_page")
    return out.select("ord", "at", "year", "label", F.col("span.start").alias("meeting_start"), F.col("span.end").alias("meeting_end"), "event_type", "scheduled", "u.statement_url", "u.minutes_url", "u.minutes_release_date", "source_page")


def unreadable_meetings(calendars: DataFrame, site: str = SITE) -> DataFrame:
    """(source_page, label, year): the entries whose dates can't be read, which ``load_meetings`` refuses or leaves out."""
    return parse_calendars(calendars, site).where("meeting_start IS NULL OR meeting_end IS NULL").select("source_page", "label", "year")


def load_meetings(calendars: DataFrame, today: datetime.date, site: str = SITE, strict: bool = True) -> DataFrame:
    """Meetings up to ``today``, the first of each (meeting_end, label) in page order, by date. An entry whose dates can't be read
    fails the query; with ``strict`` off it is left out (``unreadable_meetings`` lists them)."""
    found = parse_calendars(calendars, site)
    if strict:
        said = F.concat(F.lit("unreadable meeting dates: "), F.coalesce("label", F.lit("")), F.lit(" on "), F.coalesce("source_page", F.lit("")))
        known = F.col("meeting_start").isNotNull() & F.col("meeting_end").isNotNull()
        found = found.withColumn("meeting_end", F.when(known, F.col("meeting_end")).otherwise(F.raise_error(said).cast("date")))
    found = found.where(F.col("meeting_end") <= F.lit(today))
    return keep_first(found, ["meeting_end", "label"], ["ord", "at"]).drop("ord", "at").orderBy("meeting_end", "label")


def announcing(found: str) -> Column:
    """Of the press releases of a day (found pages of paragraphs by place), those before the first missing one: the first whose title announces minutes."""
    before = F.filter(F.col(found), lambda x, i: x["k"] == i)
    return F.get(F.filter(before, lambda x: F.coalesce(F.exists(F.slice(x["page"], 1, 4), lambda p: p.rlike(release.PRESS_TITLE)), F.lit(False))), F.lit(0))


def find_press_release(days: DataFrame, pages: DataFrame, paragraphs, site: str = SITE) -> DataFrame:
    """(release_day, press_url, press_paras): for each day, of its press releases before the first missing one, the first whose title announces minutes."""
    asked = days.select("release_day").where("release_day IS NOT NULL").distinct()
    found = look_up_roles(asked, ["release_day"], {"press": release.press_release_urls(F.col("release_day"))}, pages, site, paragraphs)
    hit = announcing("press")
    return found.select("release_day", hit["url"].alias("press_url"), hit["page"].alias("press_paras"))


#: What identifies a meeting.
MEETING = ["meeting_start", "meeting_end", "event_type", "scheduled", "label"]


def clean_pages(meetings: DataFrame, pages: DataFrame, site: str = SITE) -> DataFrame:
    """Every statement and minutes document whose page has paragraphs, with ``c``: what cleaning kept and took. The page table is joined
    once: statements, minutes and the press releases that may announce minutes are asked for together, and each page found is parsed once."""
    paragraphs = paragraphs_udf()
    limit_batches(pages.sparkSession)
    empty = F.array().cast("array<string>")
    roles = {"st": F.array("statement_url"), "mn": F.array("minutes_url"), "press": F.when(F.col("minutes_release_date").isNotNull(), release.press_release_urls(F.col("minutes_release_date")))}
    extra = ["statement_url", "minutes_url", "minutes_release_date"]
    both = look_up_roles(meetings.select(*MEETING, *extra).distinct(), [*MEETING, *extra], roles, pages, site, paragraphs)
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0))["page"], empty)
    both = both.withColumns({"st": first("st"), "mn": first("mn")})

    url_date = dates.date_in_url(F.col("statement_url"))
    both = both.withColumns({"url_date": url_date, "released": F.coalesce(dates.page_date(F.col("st")), url_date), "hit": announcing("press")})
    text = lambda d: F.coalesce(d.cast("string"), F.lit("None"))
    statement = F.struct(
        F.concat_ws("_", F.lit("statement"), text(F.col("released")), F.col("event_type")).alias("doc_id"), F.lit("statement").alias("doc_type"), F.col("released").alias("release_date"),
        F.when(F.col("url_date").isNull() | (F.col("url_date") == F.col("released")), "ok").otherwise(F.concat(F.lit("url says "), F.col("url_date").cast("string"))).alias("release_date_check"),
        release.resolve_statement_time(F.col("st"), F.col("mn")).alias("rt"), clean.clean_statement(F.col("st")).alias("c"),
        absolute_url(F.col("statement_url"), site).alias("source_url"), ordered_join(F.col("st"), "\n\n").alias("raw_text"),
    )
    timed = release.minutes_time(F.col("hit.page"), F.col("hit").isNotNull())
    undated = F.struct(F.lit(None).cast("int").alias("time"), F.lit("unverified").alias("source"), F.lit("no release date").alias("note"))
    rt = F.when(F.col("minutes_release_date").isNull(), undated).otherwise(F.struct(timed["time"].alias("time"), timed["source"].alias("source"), F.concat(timed["note"], F.coalesce(F.concat(F.lit(" ["), F.col("hit.url"), F.lit("]")), F.lit(""))).alias("note")))
    minutes = F.struct(
        F.concat_ws("_", F.lit("minutes"), text(F.col("meeting_end")), F.col("event_type")).alias("doc_id"), F.lit("minutes").alias("doc_type"), F.col("minutes_release_date").alias("release_date"),
        F.when(F.col("minutes_release_date").isNotNull(), "calendar").otherwise("missing").alias("release_date_check"), rt.alias("rt"), clean.clean_minutes(F.col("mn")).alias("c"),
        absolute_url(F.col("minutes_url"), site).alias("source_url"), ordered_join(F.col("mn"), "\n\n").alias("raw_text"),
    )
    # Both documents of a meeting come from one row, so that what is above is computed once; the null ones are dropped after they were unfolded.
    each = F.explode_outer(F.array(F.when(F.size("st") > 0, statement), F.when(F.size("mn") > 0, minutes))).alias("d")
    return both.select(*MEETING, each).where("d IS NOT NULL").select(*MEETING, "d.*")


def documents_of(cleaned: DataFrame) -> DataFrame:
    """The documents among cleaned pages, by date."""
    clean_text = ordered_join(F.col("c.kept"), "\n\n")
    documents = cleaned.select(
        *MEETING, "doc_id", "doc_type", "release_date", "release_date_check", F.col("rt.time").alias("release_time_et"), dates.in_new_york(F.col("release_date"), F.col("rt.time")).alias("release_datetime"),
        F.col("rt.source").alias("time_source"), F.col("rt.note").alias("time_note"), "source_url", "raw_text", clean_text.alias("clean_text"), word_count(clean_text).alias("n_words"),
    )
    return documents.orderBy("release_date", "doc_type", "doc_id")


def stripped_of(cleaned: DataFrame) -> DataFrame:
    """(doc_id, rule, text, seq): the log of what cleaning took."""
    return logged(cleaned, "c.stripped", ["doc_id"]).select("doc_id", "rule", "text", "seq")


def build_documents(meetings: DataFrame, pages: DataFrame, site: str = SITE) -> tuple[DataFrame, DataFrame]:
    """(documents, stripped): every statement and minutes document whose page has paragraphs, and the log of what cleaning took. Where both
    are written, ``store_documents`` cleans each page once for the two of them."""
    cleaned = clean_pages(meetings, pages, site)
    return documents_of(cleaned), stripped_of(cleaned)


def store_documents(meetings: DataFrame, pages: DataFrame, documents_path: str, stripped_path: str, site: str = SITE) -> dict:
    """Write documents and log; return what was counted on the way (``Observation``): rows, documents by type, sentences, words, and the
    audit of rules (rule, n, chars). Pages are cleaned in one pass, whose result both tables are made of; nothing is read again to count."""
    from pyspark.sql import Observation

    spark = meetings.sparkSession
    seen = Observation("cleaned pages")
    cleaned = clean_pages(meetings, pages, site)
    log, kept = F.col("c.stripped"), ordered_join(F.col("c.kept"), "\n\n")
    counted = [F.count("*").alias("documents"), *[F.count_if(F.col("doc_type") == t).alias(t) for t in ("statement", "minutes")], F.count_if(F.col("rt.time").isNotNull()).alias("timed")]
    counted += [F.sum(F.size(scoring_sentences(kept)).cast("long")).alias("sentences"), F.sum(word_count(kept).cast("long")).alias("words"), *rule_counts(log, clean.RULES)]
    staged = f"{documents_path.rstrip('/')}.cleaned"
    cleaned.observe(seen, *counted).write.mode("overwrite").parquet(staged)
    whole = spark.read.schema(cleaned.schema).parquet(staged)
    documents_of(whole).write.mode("overwrite").parquet(documents_path)
    stripped_of(whole).write.mode("overwrite").parquet(stripped_path)
    files.remove(spark, staged)
    counts = seen.get
    return {k: counts[k] or 0 for k in ("documents", "statement", "minutes", "timed", "sentences", "words")} | {"stripped": audit_of(counts, clean.RULES)}


def summarise(meetings: DataFrame, documents: DataFrame, stripped: DataFrame | None = None) -> dict[str, DataFrame]:
    """The reports that follow an ingest, by name; the audit of rules where the log is given (``store_documents`` has counted it already)."""
    from ..operators import report

    kinds = ["statement", "statement_unsched", "minutes", "minutes_unsched"]
    scheduled = meetings.where("scheduled")
    out = {
        "documents by year and kind": report.crosstab(documents, F.year("meeting_end"), report.kind_of(F.col("doc_type"), F.col("scheduled")), kinds).orderBy("year"),
        "release dates": report.date_range(documents, by=["doc_type"]).orderBy("doc_type"),
        "release time sources": report.group_counts(documents, ["doc_type", "time_source", "release_time_et"]).orderBy("doc_type", "time_source", "release_time_et"),
        "scheduled without statement": scheduled.where("statement_url IS NULL").select("label"),
        "scheduled without minutes": scheduled.where("minutes_url IS NULL").select("label"),
    }
    return out if stripped is None else out | {"stripped by rule": report.rule_audit(stripped).orderBy("rule")}
