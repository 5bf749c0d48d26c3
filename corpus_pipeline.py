"""The corpus pipeline: documents, cleaned stage by stage and turned into tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's documents. Part of the training-data operators (``tonemill.llm``).

What every stage does with odd rows: a null or empty text is no text (the quality stage takes it out; the others let it pass), a null
id is an id of its own row, repeated rows are judged alike until the near-duplicate stage leaves one row of each id, a very long
text is read whole, an empty table gives an empty one, and columns beside those a stage reads pass through unchanged, whatever
their names (the last stage returns its own columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import bpe, decontaminate, jaccard, quality, secrets
from tonemill.llm.common import settle, table
from tonemill.llm.queries import BPE_RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (operator 3). Each row is judged by its own text and language; null and empty texts go;
    without trusted labels nothing else goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, and one row of each id (operator 6). Texts without
    words are in no group; rows without an id all stay."""
    return jaccard.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate (operator 1). Rows are judged by id and text, a null id is an id; without
    benchmark items, and without words, nothing goes."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew (operator 5). A null text stays null and keeps its n_chars;
    overlapping spans are one mark."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ids as little-endian unsigned 32-bit integers (operator 2). A null text has no tokens; every row
    stays, and so do repeats."""
    import public_tokenizers

    coded = bpe.bpe_encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id", "lang", "source", "n_chars"])
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", token_stage),
]

#: SQL expresses neither the lexed secrets nor the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{k}")
    return docs
