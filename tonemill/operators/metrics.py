"""Agreement of predicted with gold labels: confusion, macro F1, accuracy, kappa, and the choice of a scorer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import LABELS

#: Candidates in order of cost, and how far below the best a cheaper one may lie.
CANDIDATES, TIE_MARGIN = ("lexicon", "zs-base", "zs-large"), 0.03


def _checked(column: str, labels) -> Column:
    return F.when(F.col(column).isin(list(labels)), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))))


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred", labels=LABELS, by: list[str] | None = None) -> DataFrame:
    """(by..., gold, pred, n), dense over the labels; a label outside them fails the query."""
    by = by or []
    seen = pairs.groupBy(*by, _checked(gold, labels).alias("gold"), _checked(pred, labels).alias("pred")).agg(F.count("*").alias("n"))
    cells = [F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred"), F.lit(0).cast("long").alias("n")) for g in labels for p in labels]
    # Dense without a cross join: the counts of each group meet a literal of all cells.
    groups = seen.groupBy(*by).agg(F.collect_list(F.struct("gold", "pred", "n")).alias("seen"))
    every = groups.select(*by, F.explode(F.concat("seen", F.array(*cells))).alias("c"))
    return every.groupBy(*by, "c.gold", "c.pred").agg(F.sum("c.n").alias("n"))


def agreement(counts: DataFrame, labels=LABELS, by: list[str] | None = None) -> DataFrame:
    """(by..., n, accuracy, macro_f1, kappa) from confusion counts."""
    by = by or []
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = {"n": F.sum("n"), "same": total(F.col("gold") == F.col("pred"))}
    for k, name in enumerate(labels):
        sums |= {f"tp{k}": total((F.col("gold") == name) & (F.col("pred") == name)), f"g{k}": total(F.col("gold") == name), f"p{k}": total(F.col("pred") == name)}
    one = counts.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items() if k != "n"], sums["n"].alias("n_all")).withColumnRenamed("n_all", "n")
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    f1 = [F.when(F.col(f"tp{k}") == 0, 0.0).otherwise(2 * F.col(f"tp{k}") / (F.col(f"g{k}") + F.col(f"p{k}"))) for k in range(len(labels))]
    observed = F.col("same") / F.col("n")
    expected = add([(F.col(f"g{k}") / F.col("n")) * (F.col(f"p{k}") / F.col("n")) for k in range(len(labels))])
    kappa = F.when(expected == 1, 0.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return one.select(*by, "n", observed.alias("accuracy"), (add(f1) / len(labels)).alias("macro_f1"), kappa.alias("kappa"))


def majority_share(pairs: DataFrame, gold: str = "gold") -> DataFrame:
    """One row: the share of the most frequent label."""
    return pairs.groupBy(gold).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("majority_class_accuracy"))


def choose(results: DataFrame, candidates=CANDIDATES, margin: float = TIE_MARGIN, by: list[str] | None = None) -> DataFrame:
    """(by..., primary): the cheapest candidate within the margin of the best macro F1; null unless all candidates are there. Without ``by`` one row."""
    by = by or []
    cost = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("scorer"))
    found = results.select(*by, "scorer", "macro_f1", cost.alias("cost")).groupBy(*by).agg(F.max("macro_f1").alias("best"), F.collect_list(F.struct("cost", "scorer", "macro_f1")).alias("all"))
    fit = F.array_sort(F.filter("all", lambda r: (r["macro_f1"] >= F.col("best") - margin) & (r["cost"] > 0)))
    whole = F.size(F.array_except(F.array(*[F.lit(c) for c in candidates]), F.transform("all", lambda r: r["scorer"]))) == 0
    return found.select(*by, F.when(whole, F.get(fit, F.lit(0))["scorer"]).alias("primary"))
