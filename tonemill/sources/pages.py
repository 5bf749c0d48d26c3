"""Page stores, sentence files, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import SITE, cache_key, decode_body
from .files import names

#: Schema of labelled sentences, one JSON object a line.
SENTENCES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "doc_id", "release_date", "sentence", "label", "note")])
MISSING = ".404"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A folder of stored pages as (key, html): files named by cache key; pages known as missing (a mark beside the pages, mostly without
    a byte, which Spark's reader passes over) have a null html. The marks are taken from the folder's listing."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    found = files.select(name.alias("key"), decode_body(F.col("content")).alias("html")).where(~F.col("key").endswith(MISSING))
    marks = [(n.removesuffix(MISSING),) for n in names(spark, path, MISSING)]
    return found.unionByName(spark.createDataFrame(marks, "key string").withColumn("html", F.lit(None).cast("string"))) if marks else found


def look_up(urls: DataFrame, pages: DataFrame, url_col: str, html_col: str, site: str = SITE) -> DataFrame:
    """``urls`` with the page of ``url_col`` as ``html_col``; null where the store has none (a left join on the key)."""
    store = pages.select(F.col("key").alias("\x00key"), F.col("html").alias(html_col))
    return urls.join(store, cache_key(F.col(url_col), site) == store["\x00key"], "left").drop("\x00key")


def look_up_roles(rows: DataFrame, keys: list[str], roles: dict[str, Column], pages: DataFrame, site: str = SITE, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """``rows`` (distinct by ``keys``, which may be null) with a column for each role: the pages found at its addresses, in order.

    A role's addresses are an array column; what is found is an array of (k, url, page), k the place of the address, without those that
    the store lacks or knows as missing; ``page`` is the html, or what ``read`` makes of it. All roles ask in one long table, so the page
    table is joined (and shuffled, if at all) once however many roles there are, and pages are read before they are folded back by row.
    """
    row = F.struct(*[F.col(f"`{k}`") for k in keys])

    def entries(role: str) -> Column:
        return F.transform(roles[role], lambda u, k: F.struct(F.lit(role).alias("role"), k.alias("k"), u.alias("url")))

    each = [entries(role) for role in roles]
    none = F.array().cast("array<struct<role:string,k:int,url:string>>")
    asked = rows.select(row.alias("\x00row"), F.explode(F.concat(*[F.coalesce(e, none) for e in each])).alias("a")).select("\x00row", "a.*")
    asked = asked.where("url IS NOT NULL").withColumn("key", cache_key(F.col("url"), site))
    store = pages.where("html IS NOT NULL").select("key", "html")
    found = asked.join(store, "key").select("\x00row", "role", "k", "url", (read(F.col("html")) if read else F.col("html")).alias("page"))
    held = {role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("k", "url", "page")))) for role in roles}
    folded = found.groupBy("\x00row").agg(*[v.alias(role) for role, v in held.items()])
    joined = rows.join(folded, row.eqNullSafe(F.col("\x00row")), "left")
    none = F.array().cast(folded.schema[next(iter(roles))].dataType)
    return joined.select(*rows.columns, *[F.coalesce(F.col(role), none).alias(role) for role in roles])


def fetch_counts(urls: DataFrame, pages: DataFrame, url_col: str, site: str = SITE) -> DataFrame:
    """One row: how many addresses the store has (n_cached), knows as missing (n_missing), or would have to fetch (n_network)."""
    known = urls.join(pages.withColumnRenamed("key", "\x00key"), cache_key(F.col(url_col), site) == F.col("\x00key"), "left")
    return known.agg(F.count_if(F.col("html").isNotNull()).alias("n_cached"), F.count_if(F.col("\x00key").isNotNull() & F.col("html").isNull()).alias("n_missing"), F.count_if(F.col("\x00key").isNull()).alias("n_network"))


def calendar_urls(spark: SparkSession, first_year: int = 1994, last_year: int = 2020, recent: str = "/monetarypolicy/fomccalendars.htm") -> DataFrame:
    """(ord, year, url, kind): an archive page for each year, then the current page."""
    years = spark.range(first_year, last_year + 1).select((F.col("id") - first_year).cast("int").alias("ord"), F.col("id").cast("int").alias("year"), F.concat(F.lit("/monetarypolicy/fomchistorical"), F.col("id").cast("string"), F.lit(".htm")).alias("url"), F.lit("archive").alias("kind"))
    last = spark.range(1).select(F.lit(last_year - first_year + 1).alias("ord"), F.lit(None).cast("int").alias("year"), F.lit(recent).alias("url"), F.lit("recent").alias("kind"))
    return years.unionByName(last)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sentences; blank lines are passed over."""
    return spark.read.schema(SENTENCES).json(path)


def write_sentences(df: DataFrame, path: str) -> None:
    """One JSON object a line with null labels written out; refuses to overwrite."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """A parquet table, replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """A CSV table with a header and quoted text."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_predictions`` wrote, as strings; text may go over lines."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
