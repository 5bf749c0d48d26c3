"""Reports: cross-tabs, groups with null keys, rule audits, ranges, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def crosstab(df: DataFrame, index: Column, kind: Column, kinds: list[str], index_name: str = "year") -> DataFrame:
    """Counts by index (rows) and kind (columns, given so that the schema is stable), 0 where there is none."""
    return df.select(index.alias(index_name), kind.alias("kind")).groupBy(index_name).pivot("kind", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


def kind_of(doc_type: Column, scheduled: Column) -> Column:
    """The type, marked if it wasn't scheduled (or that is unknown)."""
    return F.when(scheduled, doc_type).otherwise(F.concat(doc_type, F.lit("_unsched")))


def group_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by keys; null is a group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def logged(df: DataFrame, log: str, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, seq, rule, text): one row for each entry of a log column (array of rule and text).

    Rows without entries are dropped after they were unfolded, not by a condition on the array: Spark would push that below what made
    the array and so clean each page once more.
    """
    return df.select(*(keep or []), F.posexplode_outer(log).alias("seq", "s")).where("seq IS NOT NULL").select(*(keep or []), "seq", "s.rule", "s.text")


def _of_rule(log: Column, rule: str) -> Column:
    return F.filter(log, lambda s: s["rule"] == rule)


def rule_counts(log: Column, rules: tuple[str, ...]) -> list[Column]:
    """Aggregates over a log column: entries and characters of each rule (n_0, chars_0, n_1, ...), for ``observe`` or ``agg``."""
    out = []
    for k, rule in enumerate(rules):
        own = _of_rule(log, rule)
        chars = F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(F.char_length(s["text"]), F.lit(0)))
        out += [F.sum(F.size(own).cast("long")).alias(f"n_{k}"), F.sum(chars).alias(f"chars_{k}")]
    return out


def row_counts(log: Column, rules: tuple[str, ...]) -> Column:
    """(n, chars) of each rule in a row's log, as one column: what ``summed_counts`` sums, computed once a row."""
    chars = lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(F.char_length(s["text"]), F.lit(0)))
    return F.array(*[let(_of_rule(log, rule), lambda own: F.struct(F.size(own).cast("long").alias("n"), chars(own).alias("chars"))) for rule in rules])


def summed_counts(counts: str, rules: tuple[str, ...]) -> list[Column]:
    """The aggregates of ``rule_counts`` over a column of ``row_counts``."""
    return [F.sum(F.col(counts)[k][c]).alias(f"{c}_{k}") for k in range(len(rules)) for c in ("n", "chars")]


def audit_of(counts: dict, rules: tuple[str, ...]) -> list[dict]:
    """(rule, n, chars) of the rules that took something, from what ``rule_counts`` counted."""
    return [{"rule": rule, "n": counts[f"n_{k}"], "chars": counts[f"chars_{k}"]} for k, rule in enumerate(rules) if counts.get(f"n_{k}")]


def rule_audit(stripped: DataFrame) -> DataFrame:
    """(rule, n, chars) of what cleaning took."""
    return stripped.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def date_range(df: DataFrame, date_col: str = "release_date", by: list[str] | None = None) -> DataFrame:
    """Number of rows, first and last date."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"))


def mean_by(df: DataFrame, key: str, value: str = "score", digits: int = 3) -> DataFrame:
    """(key, n, mean_value): all rows counted, nulls left out of the rounded mean."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), digits).alias(f"mean_{value}"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of the pairs without nulls; null for fewer than two or a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def changes_after_filter(joined: DataFrame, part_by: list[str], change: str = "tone_change", value: str = "lexicon", date_col: str = "release_date", id_col: str = "doc_id") -> DataFrame:
    """Rows with a change, in order; then the value's own change over those rows, the first of them gone."""
    order = Window.partitionBy(*part_by).orderBy(date_col, id_col)
    rows = joined.where(F.col(change).isNotNull())
    return rows.withColumn(f"{value}_change", F.col(value) - F.lag(value).over(order)).where(F.col(f"{value}_change").isNotNull())


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a least value by key, so rows combine before they are shuffled and no group is sorted."""
    row, rank = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in order])
    best = df.groupBy(*[F.col(f"`{k}`").alias(f"\x00{k}") for k in keys]).agg(F.min_by(row, rank).alias("\x00row"))
    return best.select([F.col("`\x00row`")[c].alias(c) for c in df.columns])
