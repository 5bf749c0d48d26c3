"""Scoring runs: validation of scorers on labelled sentences, document scores with resume, and checks of tone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.release import decision
from ..functions.text import scoring_sentences
from ..operators import metrics, nli, report, tone
from ..operators.scan import scan
from ..sources import files

#: A scorer of sentence tables: adds the column ``label``.
TableScorer = Callable[[DataFrame], DataFrame]


#: Scorers that were added by name, beside the built-in ones.
_ADDED: dict[str, Callable[[], TableScorer]] = {}


def register_scorer(name: str, make: Callable[[], TableScorer]) -> None:
    """Add a scorer by name: ``make`` gives a function from a table with ``sentence`` to one with ``label`` too."""
    if name in metrics.CANDIDATES:
        raise ValueError(f"{name} is built in")
    _ADDED[name] = make


def scorer_names() -> list[str]:
    """The names that ``scorer`` knows."""
    return [*metrics.CANDIDATES, *_ADDED]


def scorer(name: str, load_model: Callable[[str], Callable[[], nli.Model]] | None = None, lexicon: Lexicon = Lexicon()) -> TableScorer:
    """A scorer by name: ``lexicon`` stays native; others load a model in each worker, or were added by ``register_scorer``."""
    if name in _ADDED:
        return _ADDED[name]()
    if name == "lexicon":
        label: Callable[[Column], Column] = tone.lexicon_scorer(lexicon)
        return lambda sentences: sentences.withColumn("label", label(F.col("sentence")))
    load = load_model(name) if load_model else (lambda: nli.load_transformer(name))
    return lambda sentences: nli.score_by_length(sentences, load)


def validate(labelled: DataFrame, scorers: dict[str, TableScorer]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(predictions, results, majority, primary) of scorers on sentences (id, sentence, label as gold)."""
    gold = labelled.select("id", F.col("label").alias("gold"), "sentence")
    wide, long = gold, None
    for name, run in scorers.items():
        found = run(gold.select("id", "sentence")).select("id", F.col("label").alias(f"pred_{name}"))
        wide = wide.join(found, "id", "left")
        part = gold.select("id", "gold").join(found.select("id", F.lit(name).alias("scorer"), F.col(f"pred_{name}").alias("pred")), "id")
        long = part if long is None else long.unionByName(part)
    results = metrics.agreement(metrics.confusion(long, by=["scorer"]), by=["scorer"])
    rounded = results.select("scorer", *[F.round(c, 4).alias(c) for c in ("macro_f1", "accuracy", "kappa")])
    return wide.orderBy("id"), rounded, metrics.majority_share(gold), metrics.choose(rounded)


def validation_summary(validated: tuple[DataFrame, DataFrame, DataFrame, DataFrame], names: list[str]) -> dict:
    """The figures of ``validate`` as one nested value: candidates with their confusions, the majority's share, the primary scorer if all
    candidates were there. Its tables have a few rows each."""
    wide, results, majority, primary = validated
    candidates = {r.scorer: {"macro_f1": r.macro_f1, "accuracy": r.accuracy, "kappa": r.kappa} for r in results.collect()}
    for name in names:
        table: dict = {g: {} for g in metrics.LABELS}
        for r in metrics.confusion(wide.select("gold", F.col(f"pred_{name}").alias("pred"))).collect():
            table[r.gold][r.pred] = r.n
        candidates[name]["confusion_gold_by_pred"] = {g: {p: row[p] for p in metrics.LABELS} for g, row in table.items()}
    out = {"candidates": {n: candidates[n] for n in names}, "majority_class_accuracy": majority.first()[0]}
    best = primary.first()["primary"]
    return out | ({"primary": best} if best else {})


def check_summary(checked: tuple[DataFrame, DataFrame, DataFrame], name: str) -> dict:
    """The figures of ``check_tone`` as one nested value; its tables have a few rows each."""
    by_decision, correlations, series = checked
    both = correlations.first()
    return {"scorer": name, "statements": series.count(), "mean_score_by_decision": [r.asDict() for r in by_decision.collect()], **both.asDict()}


def score_documents(documents: DataFrame, doc_type: str, since=None, lexicon: Lexicon = Lexicon()) -> tuple[DataFrame, DataFrame]:
    """(tone, sentences) of one type's documents by the lexicon."""
    docs = tone.choose_documents(documents, doc_type, since).select("doc_id", "release_date", "scheduled", "clean_text")
    labelled = tone.label_documents(docs, tone.lexicon_scorer(lexicon))
    scored = tone.tone_change(tone.score_documents(labelled))
    return scored.orderBy("release_date", "doc_id"), tone.sentence_table(labelled)


#: What a batch of a slow scorer writes: one row per sentence, or one without a sentence for a document that has none.
PARTIAL = "doc_id string, text_hash long, i int, sentence string, label string"


def scored_so_far(spark: SparkSession, partial: str) -> DataFrame:
    """The rows of all batches that were written to their end."""
    whole = [f"{partial}/{n}" for n in files.names(spark, partial) if n.startswith("batch-") and files.exists(spark, f"{partial}/{n}/_SUCCESS")]
    return spark.read.schema(PARTIAL).parquet(*whole) if whole else spark.createDataFrame([], PARTIAL)


def score_with_model(spark: SparkSession, documents: DataFrame, doc_type: str, run: TableScorer, partial: str, since=None, batch: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(tone, sentences) by a slow scorer; a run that stopped goes on where it was, whatever was added, taken away or changed since.

    What is done is known by document and text, so a changed text is scored again and a document that is gone is left out. What is
    to do is written once to ``partial``, dealt into batches of about ``batch`` documents, and each batch reads its own part
    alone; a batch counts once it is written to its end. Call ``forget`` when the results are stored.
    """
    keys = ["doc_id", "text_hash"]
    docs = tone.choose_documents(documents, doc_type, since).select("doc_id", "release_date", "scheduled", "clean_text", F.xxhash64("clean_text").alias("text_hash"))
    todo = tone.not_done(docs.select(*keys, "clean_text"), scored_so_far(spark, partial), keys)
    n = -(-todo.count() // batch)
    if n:
        todo.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{partial}/todo")
        dealt = spark.read.schema("doc_id string, text_hash long, clean_text string, part int").parquet(f"{partial}/todo")
        for k in range(n):
            own = dealt.where(F.col("part") == k).select(*keys, F.posexplode_outer(scoring_sentences(F.col("clean_text"))).alias("i", "sentence"))
            labelled = run(own.where("sentence IS NOT NULL")).select(*keys, "i", "sentence", "label")
            none = own.where("sentence IS NULL").select(*keys, "i", "sentence", F.lit(None).cast("string").alias("label"))
            labelled.unionByName(none).write.parquet(f"{partial}/batch-{uuid.uuid4().hex}")
    found = tone.still_wanted(scored_so_far(spark, partial), docs, keys)
    sentences = found.where("sentence IS NOT NULL").select("doc_id", "i", "sentence", "label")
    counts = sentences.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_sentences"), F.count_if(F.col("label") == "hawkish").cast("int").alias("n_hawkish"), F.count_if(F.col("label") == "dovish").cast("int").alias("n_dovish"))
    scored = docs.drop("clean_text", "text_hash").join(counts, "doc_id", "left").na.fill(0, ["n_sentences", "n_hawkish", "n_dovish"])
    scored = scored.withColumn("score", F.try_divide(F.col("n_hawkish") - F.col("n_dovish"), F.col("n_sentences")).cast("double"))
    return tone.tone_change(scored).orderBy("release_date", "doc_id"), sentences


def forget(spark: SparkSession, partial: str) -> None:
    """Delete the batches of a run whose results are stored."""
    files.remove(spark, partial)


def check_tone(documents: DataFrame, scored: DataFrame, lexicon_scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by_decision, correlations, series) of scheduled documents: mean score by the decision read from the text, agreement
    with the lexicon in level and change, and the rows for a time-series chart."""
    rows = scored.where("scheduled").join(documents.select("doc_id", "clean_text"), "doc_id").withColumn("decision", decision(F.col("clean_text"))).drop("clean_text")
    joined = rows.join(lexicon_scored.select("doc_id", F.col("score").alias("lexicon")), "doc_id")
    level = joined.agg(F.round(report.correlation("score", "lexicon"), 3).alias("corr_with_lexicon_level"))
    change = report.changes_after_filter(joined, []).agg(F.round(report.correlation("tone_change", "lexicon_change"), 3).alias("corr_with_lexicon_change"))
    both = level.crossJoin(change)  # one row each
    series = rows.select("release_date", "score", "decision").orderBy("release_date")
    return report.mean_by(rows, "decision").orderBy("mean_score", "decision"), both, series


def event_returns(prices: DataFrame, horizons: tuple[int, ...] = (0, 1, 5), part_by: str = "asset", day: str = "day", price: str = "close") -> DataFrame:
    """Cumulative log returns from the day before to each horizon after it (declared by the reference, without code there)."""
    w = Window.partitionBy(part_by).orderBy(day)
    return prices.select(part_by, day, *[F.ln(F.lead(price, h).over(w) / F.lag(price, 1).over(w)).alias(f"ret_{h}") for h in horizons])


def holm(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``tests`` with ``p_holm``: step-down adjusted values. Without families to part by, tests are scanned in ranges of their values."""
    if not by:
        ranked = scan(tests.withColumn("\x00tie", F.xxhash64(*[F.col(f"`{c}`") for c in tests.columns])), [p, "\x00tie"], {"\x00k": ("row_number", None), "\x00m": ("total", None)})
        stepped = ranked.withColumn("\x00s", F.least(F.lit(1.0), F.col(p) * (F.col("\x00m") - F.col("\x00k") + 1)))
        return scan(stepped, [p, "\x00k"], {"p_holm": ("running_max", "\x00s")}).drop("\x00tie", "\x00k", "\x00m", "\x00s")
    part = Window.partitionBy(*by)
    order = part.orderBy(p)
    step = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(part) - F.row_number().over(order) + 1))
    return tests.withColumn("\x00s", step).withColumn("p_holm", F.max("\x00s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("\x00s")
