"""Zero-shot scoring by an entailment model: pairs, batches by length, labels from logits. The model itself is pluggable."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import LABELS
from ..functions.text import let

# The hypotheses, the models' names, and the batch limits.
HYPOTHESES = {
    "hawkish": "This text signals tighter monetary policy, rising inflation, or a strengthening economy.",
    "dovish": "This text signals easier monetary policy, falling inflation, or a weakening economy.",
    "neutral": "This text gives no signal about the direction of monetary policy or the economy.",
}
MODELS = {"zs-base": "MoritzLaurer/deberta-v3-base-zeroshot-v2.0", "zs-large": "MoritzLaurer/deberta-v3-large-zeroshot-v2.0"}
MAX_TOKENS, BATCH_SENTENCES = 256, 16

#: A model: premises and hypotheses of one batch -> one entailment logit each.
Model = Callable[[list[str], list[str]], list[float]]


def entailment_index(id2label: dict) -> int:
    """Place of the entailment class in a model's output."""
    found = [int(i) for i, name in id2label.items() if str(name).lower().startswith("entail")]
    if not found:
        raise ValueError(f"no entailment label in {id2label}")
    return found[0]


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return let(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))


def argmax_label(probs: Column, labels=LABELS) -> Column:
    """The label of the largest probability, the first on ties."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(probs, F.array_max(probs)).cast("int"))


def pairs(sentences: DataFrame, hypotheses: dict[str, str] = HYPOTHESES) -> DataFrame:
    """Each sentence with each hypothesis: (..., hypothesis_label, hypothesis). A literal of fixed size; no cross join."""
    every = F.array(*[F.struct(F.lit(k).alias("hypothesis_label"), F.lit(v).alias("hypothesis")) for k, v in hypotheses.items()])
    return sentences.withColumn("\x00h", F.explode(every)).select(*sentences.columns, "`\x00h`.hypothesis_label", "`\x00h`.hypothesis")


def load_transformer(name: str, cache_dir: str | None = None) -> Model:
    """A model of the transformers library, if that is installed."""
    import torch
    from transformers import AutoModelForSequenceClassification, AutoTokenizer

    model_id = MODELS.get(name, name)
    tokenizer = AutoTokenizer.from_pretrained(model_id, cache_dir=cache_dir)
    model = AutoModelForSequenceClassification.from_pretrained(model_id, cache_dir=cache_dir).eval()
    at = entailment_index(model.config.id2label)

    def run(premises, hypotheses):
        batch = tokenizer(premises, hypotheses, padding=True, truncation="only_first", max_length=MAX_TOKENS, return_tensors="pt")
        with torch.no_grad():
            return model(**batch).logits[:, at].tolist()

    return run


def score_sentences(sentences: DataFrame, load: Callable[[], Model], sentence_col: str = "sentence", hypotheses: dict[str, str] = HYPOTHESES, batch: int = BATCH_SENTENCES) -> DataFrame:
    """``sentences`` with ``probs`` and ``label``. ``load`` runs once in each worker; batches take sentences of like length."""
    schema = T.StructType([*sentences.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])
    texts = list(hypotheses.values())

    def run(frames):
        model = load()
        for frame in frames:
            order = np.argsort(frame[sentence_col].str.len().fillna(0).to_numpy(), kind="stable")
            logits: list = [None] * len(frame)
            for start in range(0, len(order), batch):
                part = order[start : start + batch]
                premises = [frame[sentence_col].iloc[i] or "" for i in part for _ in texts]
                values = model(premises, texts * len(part))
                for k, i in enumerate(part):
                    logits[i] = [float(v) for v in values[k * len(texts) : (k + 1) * len(texts)]]
            yield frame.assign(logits=pd.Series(logits, index=frame.index, dtype=object))

    scored = sentences.mapInPandas(run, schema).withColumn("probs", softmax(F.col("logits"))).drop("logits")
    return scored.withColumn("label", argmax_label(F.col("probs"), tuple(hypotheses)))


def batches_within(lengths: list[int], budget: int) -> list[tuple[int, int]]:
    """(start, end) of batches of ascending lengths: a batch's rows times its longest one stay within ``budget``, one row at least."""
    out, start = [], 0
    for end in range(1, len(lengths) + 1):
        if end == len(lengths) or (end - start + 1) * lengths[end] > budget:
            out.append((start, end))
            start = end
    return out


def score_by_length(sentences: DataFrame, load: Callable[[], Model], sentence_col: str = "sentence", hypotheses: dict[str, str] = HYPOTHESES, budget: int = BATCH_SENTENCES * MAX_TOKENS, length: Column | None = None) -> DataFrame:
    """``score_sentences`` with the whole table in order of length, so that batches hold sentences of like length wherever they came from.

    Rows are dealt into ranges of length (equal lengths by a hash, so that a frequent length fills several tasks), sorted there, and
    taken in batches whose padded size, rows times the longest, stays within ``budget``. ``length``: tokens of a row (its words and a third,
    at most MAX_TOKENS, if not given). All columns stay with their rows, so the order is undone by any key they hold.
    """
    schema = T.StructType([*sentences.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])
    texts, held = list(hypotheses.values()), len(sentences.columns)
    words = F.size(F.split(F.coalesce(F.col(sentence_col), F.lit("")), r"\s+"))
    tokens = F.least(F.lit(MAX_TOKENS), (F.ceil(words * 4 / 3) if length is None else length).cast("int"))
    ordered = sentences.withColumn("\x00tokens", F.coalesce(tokens, F.lit(1))).repartitionByRange("\x00tokens", F.xxhash64(sentence_col)).sortWithinPartitions("\x00tokens")

    def run(frames):
        model, waiting = load(), None

        def scored(frame):
            lengths = frame.iloc[:, held].tolist()
            logits: list = []
            for start, end in batches_within(lengths, budget):
                premises = [s or "" for s in frame[sentence_col].iloc[start:end] for _ in texts]
                values = model(premises, texts * (end - start))
                logits += [[float(v) for v in values[k * len(texts) : (k + 1) * len(texts)]] for k in range(end - start)]
            return frame.iloc[:, :held].assign(logits=pd.Series(logits, index=frame.index, dtype=object))

        for frame in frames:
            # The last batch of a frame may go on in the next.
            waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            last = batches_within(waiting.iloc[:, held].tolist(), budget)[-1][0] if len(waiting) else 0
            if last:
                yield scored(waiting.iloc[:last])
                waiting = waiting.iloc[last:].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield scored(waiting)

    scored = ordered.mapInPandas(run, schema).withColumn("probs", softmax(F.col("logits"))).drop("logits")
    return scored.withColumn("label", argmax_label(F.col("probs"), tuple(hypotheses)))
