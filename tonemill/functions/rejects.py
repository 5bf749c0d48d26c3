"""Values with the reason why there is none: what can't be read is set aside with its reason, and the rest goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dates import date_in_url, date_span, group, month_number
from .release import minutes_of_day


def _checked(value: Column, given: Column, wrong: Column, said: str) -> Column:
    """(value, reason): the reason is null unless ``wrong``."""
    return F.struct(value.alias("value"), F.when(wrong, F.concat(F.lit(f"{said}: "), F.coalesce(given.cast("string"), F.lit("")))).alias("reason"))


def month_checked(name: Column) -> Column:
    """A month's number; a name that isn't blank and no month's has a reason."""
    number = month_number(name)
    return _checked(number, name, number.isNull() & (F.btrim(name) != ""), "unknown month")


def url_day_checked(url: Column) -> Column:
    """The day in an address; eight digits that are no day have a reason."""
    digits, day = group(url, r"(\d{8})", 1), date_in_url(url)
    return _checked(day, digits, digits.isNotNull() & day.isNull(), "no such day")


def time_checked(hour: Column, minute: Column, half: Column) -> Column:
    """Minutes after midnight; a minute that no hour has has a reason."""
    value = minutes_of_day(hour, minute, half)
    return _checked(value, F.concat_ws(":", hour, minute), hour.isNotNull() & value.isNull(), "no such minute")


def span_checked(text: Column, year: Column) -> Column:
    """First and last day of a printed span; a span without either has a reason."""
    span = date_span(text, year)
    return _checked(span, text, text.isNotNull() & (span["start"].isNull() | span["end"].isNull()), "unreadable dates")


def judge(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each check's value, ``reasons`` (array of column and reason) and ``rejected`` (whether there are any)."""
    held = df.select("*", *[c.alias(f"\x00{name}") for name, c in checks.items()])
    reasons = F.array_compact(F.array(*[F.when(F.col(f"\x00{n}")["reason"].isNotNull(), F.struct(F.lit(n).alias("column"), F.col(f"\x00{n}")["reason"].alias("reason"))) for n in checks]))
    held = held.withColumn("reasons", reasons)
    return held.select(*df.columns, *[F.col(f"\x00{n}")["value"].alias(n) for n in checks], "reasons", (F.size("reasons") > 0).alias("rejected"))


def store_judged(spark: SparkSession, judged: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of judged rows, written in one pass into a folder for each; rejects have one row for each reason, with all columns."""
    judged.write.mode("overwrite").partitionBy("rejected").parquet(path)
    read = spark.read.schema(judged.schema).parquet(path)
    rejects = read.where("rejected").withColumn("r", F.explode("reasons"))
    return read.where("NOT rejected").drop("reasons", "rejected"), rejects.select(*[c for c in judged.columns if c not in ("reasons", "rejected")], F.col("r.column").alias("column"), F.col("r.reason").alias("reason"))
