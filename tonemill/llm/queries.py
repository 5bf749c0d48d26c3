"""The registered queries of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, decontaminate, fertility, fim, jaccard, licences, neighbours, pii, quality, secrets, sql, wordpiece
from .common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(found)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    coded = bpe.bpe_encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id"])
    return bpe.digest_columns(coded)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_bytes", F.round("perplexity", 4).alias("perplexity"), F.col("keep").alias("kept"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema])
    return chat.digest_columns(chat.format_conversations(turns.unionByName(extra)))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest_columns(secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word shingles overlap by four fifths."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences declared in every document."""
    found = licences.scan_licences(table(spark, sf_dir, "documents"), keep=["doc_id"])
    best = F.array_sort("licence_matches", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return found.select("doc_id", F.size("licence_matches").cast("long").alias("n_matches"), F.get(best, F.lit(0))["licence"].alias("licence"), F.get(best, F.lit(0))["dice"].alias("dice"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every document."""
    import public_tokenizers

    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser fertility and the verdict of every document."""
    import public_tokenizers

    vocabularies = public_tokenizers.path(PIECES), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    return fertility.digest_columns(fertility.judge(table(spark, sf_dir, "documents"), *vocabularies, keep=["doc_id"]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from the output."""
    return fim.digest_columns(fim.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every usable embedding."""
    return codes.digest_columns(codes.compress(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_byte_bpe, op3_quality_classifier, op4_chat_format, op5_secret_scan, op6_jaccard_join, op7_licence_scan, op8_token_counts, op9_pii, op10_embedding_dedup,
        op11_quality_rules, op12_fill_in_middle, op13_vector_codes,
    )
}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
