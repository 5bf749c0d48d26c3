"""Seeded samples of an exact size, and orders that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

SEED, SIZE = 20261029, 150


def exact_sample(df: DataFrame, n: int = SIZE, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed whatever the partitions; fails if there are fewer. They are drawn once, into the shared
    folder: what is counted isn't drawn again."""
    key, path = F.xxhash64(F.lit(seed), F.col(id_col)), files.new_folder(df.sparkSession, "sample")
    df.orderBy(key, id_col).limit(n).write.parquet(path)
    picked = df.sparkSession.read.schema(df.schema).parquet(path)
    if picked.count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return picked


def one_of(items: Column, id_col: str = "doc_id", seed: int = SEED) -> Column:
    """One element of an array, seeded by the row's id; fails on an empty array."""
    at = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col)), F.size(items)).cast("int")
    return F.when(F.size(items) > 0, F.get(items, at)).otherwise(F.raise_error(F.lit("nothing to sample from")).cast("string"))


def sentence_sample(docs: DataFrame, sentences: Column, n: int = SIZE, seed: int = SEED) -> DataFrame:
    """(id, doc_id, release_date, sentence, label): one sentence from each of ``n`` documents, numbered by release date."""
    picked = exact_sample(docs, n, seed)
    number = F.row_number().over(Window.orderBy("release_date", "doc_id"))  # n rows
    return picked.select(F.format_string("v%03d", number).alias("id"), "doc_id", F.date_format("release_date", "yyyy-MM-dd").alias("release_date"), one_of(sentences, seed=seed).alias("sentence"), F.lit(None).cast("string").alias("label"))


def length_order(items: Column) -> Column:
    """Indices of an array's strings, shortest first, ties in their order."""
    rows = F.transform(items, lambda s, i: F.struct(F.char_length(s).alias("n"), i.alias("i")))
    return F.transform(F.array_sort(rows), lambda r: r["i"])


def restore_order(rows: Column, order: Column) -> Column:
    """Undo ``length_order``: the element at place k goes to index order[k]."""
    pairs = F.transform(order, lambda i, k: F.struct(i.alias("i"), F.get(rows, k).alias("row")))
    return F.transform(F.array_sort(pairs), lambda p: p["row"])
