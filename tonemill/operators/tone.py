"""Document tone: sentence labels, counts and scores, changes, resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import LABELS, Lexicon, sentence_label
from ..functions.text import scoring_sentences
from ..sources import files
from .scan import scan

Scorer = Callable[[Column], Column]


def lexicon_scorer(lexicon: Lexicon = Lexicon()) -> Scorer:
    """A scorer: sentence -> label, without leaving the JVM."""
    return lambda sentence: sentence_label(sentence, lexicon)


def label_documents(docs: DataFrame, scorer: Scorer | None = None, text_col: str = "clean_text") -> DataFrame:
    """``docs`` without the text, with ``sentences``: array of (sentence, label) in reading order. No shuffle."""
    scorer = scorer or lexicon_scorer()
    kept = [c for c in docs.columns if c != text_col]
    return docs.select(*kept, F.transform(scoring_sentences(F.col(text_col)), lambda s: F.struct(s.alias("sentence"), scorer(s).alias("label"))).alias("sentences"))


def sentence_table(labelled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, i, sentence, label): one row per sentence."""
    return labelled.select(id_col, F.posexplode("sentences").alias("i", "s")).select(id_col, "i", "s.sentence", "s.label")


def score_documents(labelled: DataFrame, labels: tuple[str, str, str] = LABELS) -> DataFrame:
    """Counts and score (up - down) / all for each document; documents without sentences keep a row with a null score."""
    count = lambda name: F.size(F.filter("sentences", lambda s: s["label"] == name))
    out = labelled.withColumns({"n_sentences": F.size("sentences"), f"n_{labels[0]}": count(labels[0]), f"n_{labels[1]}": count(labels[1])}).drop("sentences")
    return out.withColumn("score", F.try_divide(F.col(f"n_{labels[0]}") - F.col(f"n_{labels[1]}"), F.col("n_sentences")).cast("double"))


def tone_change(scored: DataFrame, part_by: list[str] | None = None, id_col: str = "doc_id", date_col: str = "release_date", flag_col: str = "scheduled") -> DataFrame:
    """``scored`` with ``tone_change``: score less that of the previous scheduled document of its kind; null for others. Without a kind to part
    by, the scheduled documents are scanned in ranges of their dates, so that no task holds all of them; the scores are written to the shared
    folder first, because the scheduled ones and the others are read apart."""
    flag = F.coalesce(F.col(flag_col), F.lit(False))
    if not part_by:
        path = files.new_folder(scored.sparkSession, "scored")
        scored.write.parquet(path)
        scored = scored.sparkSession.read.schema(scored.schema).parquet(path)
        before = scan(scored.where(flag), [date_col, id_col], {"\x00before": ("lag", "score")})
        changed = before.withColumn("tone_change", F.col("score") - F.col("\x00before")).drop("\x00before")
        return changed.unionByName(scored.where(~flag).withColumn("tone_change", F.lit(None).cast(changed.schema["tone_change"].dataType)))
    # Scheduled rows see scheduled rows alone, and no join is needed; the others need no order, so each is a partition of its own.
    order = Window.partitionBy(*part_by, F.when(~flag, F.xxhash64(id_col))).orderBy(date_col, id_col)
    return scored.withColumn("tone_change", F.when(flag, F.col("score") - F.lag("score").over(order)))


def not_done(docs: DataFrame, done: DataFrame, id_col: str | list[str] = "doc_id") -> DataFrame:
    """The documents that ``done`` doesn't hold: where a stopped run goes on."""
    return docs.join(done.select(id_col).distinct(), id_col, "left_anti")


def still_wanted(done: DataFrame, docs: DataFrame, id_col: str | list[str] = "doc_id") -> DataFrame:
    """The rows of ``done`` whose documents are still there: what a run that goes on takes over."""
    return done.join(docs.select(id_col).distinct(), id_col, "left_semi")


def choose_documents(docs: DataFrame, doc_type: str, since=None) -> DataFrame:
    """Documents of a type, released at ``since`` or later if given (undated ones then go)."""
    out = docs.where(F.col("doc_type") == doc_type)
    return out.where(F.col("release_date") >= F.lit(since).cast("date")) if since else out
