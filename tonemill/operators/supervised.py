"""A supervised scorer: multinomial logistic regression over hashed words and word pairs, trained on labelled sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import LABELS

#: Slots of the hashed words and word pairs.
SLOTS = 1 << 14


def train(labelled: DataFrame, text_col: str = "sentence", label_col: str = "label", slots: int = SLOTS) -> PipelineModel:
    """The fitted scorer of (sentence, label); rows without a label are passed over."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.coalesce(text_col, F.lit("")).alias("sentence"), F.col(label_col).alias("label"))
    index = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        RegexTokenizer(inputCol="sentence", outputCol="words", pattern="[^a-z]+"), NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="f1", numFeatures=slots), HashingTF(inputCol="pairs", outputCol="f2", numFeatures=slots),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="f"), IDF(inputCol="f", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_index", regParam=0.01, maxIter=50),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(index.transform(rows))


def scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A scorer of sentence tables, as ``scoring.register_scorer`` takes it: adds ``label``; null sentences count as empty."""

    def run(sentences: DataFrame) -> DataFrame:
        kept = sentences.columns
        found = model.transform(sentences.withColumn("sentence", F.coalesce("sentence", F.lit(""))))
        return found.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("predicted").isin(*LABELS), F.col("predicted")).otherwise(LABELS[-1]).alias("label"))

    return run
