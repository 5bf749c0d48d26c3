"""Scoring documents as they land, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicon import Lexicon
from ..operators import tone


def read_documents(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A stream over the parquet files of a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(docs: DataFrame, text_col: str = "clean_text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Counts and scores of streamed documents; stateless, so nothing is kept between batches."""
    return tone.score_documents(tone.label_documents(docs, tone.lexicon_scorer(lexicon), text_col))


def score_new(docs: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Score what is new since the last run and stop: the checkpoint knows what is done, and each file counts once."""
    return score_stream(docs, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
