"""Time-ordered evaluation of the supervised scorer: each fold is scored by a model that has seen earlier sentences alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, supervised


def fold_days(labelled: DataFrame, folds: int, date_col: str = "release_date") -> list:
    """The first days of the folds: quantiles of the labelled sentences' days, the first fold beginning after about 1 / (folds + 1) of them."""
    known = labelled.where(F.col("label").isNotNull() & F.col(date_col).isNotNull()).select(F.col(date_col).cast("date").alias("d"))
    shares = [F.lit(k / (folds + 1)) for k in range(1, folds + 1)]
    row = known.agg(*[F.percentile_approx(F.datediff("d", F.lit("1970-01-01").cast("date")), s, 10_000).alias(f"q{i}") for i, s in enumerate(shares)], F.min("d").alias("first")).first()
    days = sorted({q for q in list(row)[:-1] if q is not None})
    first = None if row["first"] is None else row["first"].toordinal() - 719163
    return [d for d in days if d > first]  # nothing is known before the first day


def expanding_folds(labelled: DataFrame, folds: int = 5, date_col: str = "release_date", text_col: str = "sentence", slots: int = supervised.SLOTS) -> DataFrame:
    """(fold, first_day, n_train, n, accuracy, macro_f1, kappa): for each fold the sentences from its first day to the next fold's, scored by a model
    whose words, weights and document frequencies come from the sentences before that day. Sentences without label or day are passed over;
    a fold whose past holds fewer than two labels is left out.
    """
    day = F.datediff(F.col(date_col).cast("date"), F.lit("1970-01-01").cast("date"))
    rows = labelled.where(F.col("label").isNotNull() & F.col(date_col).isNotNull()).select(F.coalesce(text_col, F.lit("")).alias("sentence"), "label", day.alias("day"))
    first, parts, seen = fold_days(labelled, folds, date_col), [], []
    for k, start in enumerate(first):
        past, own = rows.where(F.col("day") < start), rows.where(F.col("day") >= start)
        if k + 1 < len(first):
            own = own.where(F.col("day") < first[k + 1])
        known = past.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).first()
        if known["labels"] < 2:
            continue
        model = supervised.train(past, slots=slots)
        guessed = supervised.scorer(model)(own.withColumnRenamed("label", "gold")).select(F.lit(k + 1).alias("fold"), "gold", F.col("label").alias("pred"))
        parts.append(guessed)
        seen.append((k + 1, start, known["n"]))
    spark = labelled.sparkSession
    facts = spark.createDataFrame(seen, "fold int, day int, n_train long").select("fold", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("first_day"), "n_train")
    if not parts:
        return facts.select("*", F.lit(None).cast("long").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("accuracy", "macro_f1", "kappa")])
    measured = metrics.agreement(metrics.confusion(reduce(DataFrame.unionByName, parts), by=["fold"]), by=["fold"])
    return facts.join(measured, "fold").select("fold", "first_day", "n_train", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "macro_f1", "kappa")]).orderBy("fold")
