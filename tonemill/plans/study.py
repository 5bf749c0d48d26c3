"""The event study that the blueprint lists as declared without code: days, returns, regression, resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import scan
from .scoring import event_returns, holm

__all__ = ["align_to_days", "bootstrap_slopes", "event_returns", "holm", "ols_hc1", "placebo_days", "placebo_test", "regressions"]


def align_to_days(events: DataFrame, days: DataFrame, date_col: str = "release_date", day_col: str = "day", by: list[str] | None = None) -> DataFrame:
    """``events`` with ``trading_day``: the first day at or after the event (as-of, forward), null for an event without a date. One row a date of
    either side is scanned (in ranges, where there is no key) and the events look their dates up; no range join."""
    by = by or []
    asked = events.select(*by, F.col(date_col).alias("\x00at"), F.lit(None).cast(days.schema[day_col].dataType).alias("\x00day"))
    dates = asked.unionByName(days.select(*by, F.col(day_col).alias("\x00at"), F.col(day_col).alias("\x00day"))).where(F.col("\x00at").isNotNull())
    dates = dates.groupBy(*by, "\x00at").agg(F.max("\x00day").alias("\x00day"))
    if not by:
        dates = scan(dates, ["\x00at"], {"\x00next": ("next", "\x00day")})
    else:
        # From the end: Spark computes a frame that ends with the partition anew for each row.
        later = Window.partitionBy(*by).orderBy(F.desc("\x00at")).rowsBetween(Window.unboundedPreceding, 0)
        dates = dates.withColumn("\x00next", F.last("\x00day", ignorenulls=True).over(later))
    found = dates.select(*[F.col(f"`{c}`").alias(f"\x00by{i}") for i, c in enumerate(by)], "\x00at", "\x00next")
    same = F.col(f"`{date_col}`") == F.col("\x00at")
    for i, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"\x00by{i}"))
    return events.join(found, same, "left").select(*[F.col(f"`{c}`") for c in events.columns], F.col("\x00next").alias("trading_day"))


def ols_hc1(df: DataFrame, y: str, xs: list[str]) -> list[dict]:
    """Least squares with an intercept and HC1 errors: one dict per term (term, coef, se, n). Two aggregations; only sums reach the driver."""
    terms = {"const": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs}
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs]))
    names, k = list(terms), len(terms)
    products = [F.sum(terms[a] * terms[b]) for a in names for b in names] + [F.sum(terms[a] * F.col(y)) for a in names]
    *sums, n = rows.agg(*[p.alias(f"s{i}") for i, p in enumerate(products)], F.count("*").alias("n")).first()
    if n <= k:
        raise ValueError("fewer rows than terms")
    xx, xy = np.array(sums[: k * k], dtype=float).reshape(k, k), np.array(sums[k * k :], dtype=float)
    inverse = np.linalg.inv(xx)
    beta = inverse @ xy
    residual = F.col(y) - sum((terms[a] * float(b) for a, b in zip(names, beta)), F.lit(0.0))
    meat = rows.agg(*[F.sum(residual * residual * terms[a] * terms[b]).alias(f"m{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).first()
    cover = inverse @ np.array(meat, dtype=float).reshape(k, k) @ inverse * n / (n - k)
    return [{"term": a, "coef": float(b), "se": float(s), "n": int(n)} for a, b, s in zip(names, beta, np.sqrt(np.diag(cover)))]


def bootstrap_slopes(df: DataFrame, y: str, x: str, id_col: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """(replicate, slope): Poisson bootstrap; each row's weight in each replicate follows from its id, so reruns agree."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("replicate")), F.lit(2**31)) + 0.5) / 2**31
    cuts, p, total = [], float(np.exp(-1)), 0.0
    for k in range(1, 9):
        total += p
        cuts.append(total)
        p /= k
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.select(id_col, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    s = rows.groupBy("replicate").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxy", F.col("x") * F.col("y")), ("sxx", F.col("x") * F.col("x")))])
    return s.select("replicate", F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).alias("slope"))


def placebo_days(days: DataFrame, events: DataFrame, n: int, day_col: str = "day", event_col: str = "trading_day", seed: int = 1) -> DataFrame:
    """``n`` days that are no event days, the same for the same seed."""
    free = days.select(day_col).distinct().join(events.select(F.col(event_col).alias(day_col)).distinct(), day_col, "left_anti")
    return free.orderBy(F.xxhash64(F.lit(seed), F.col(day_col)), day_col).limit(n)


def regressions(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """(by..., term, coef, se, n, collinear): least squares of y on xs with an intercept, for all groups at once, with HC1 errors of the slopes.

    Two grouped aggregations: centred moments, whose normal equations are solved by Cholesky steps as column expressions, and the sums of
    squared residuals times centred regressors. Groups with a regressor that the others explain, or with no more rows than terms, are marked
    ``collinear`` and have null coefficients. Rows with a null among y and xs are left out.
    """
    p = len(xs)
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs])).select(*by, F.col(y).cast("double").alias("\x00y"), *[F.col(x).cast("double").alias(f"\x00x{i}") for i, x in enumerate(xs)])
    n, pairs = F.count("*"), [(i, j) for i in range(p) for j in range(i + 1)]
    moments = [n.alias("n"), F.avg("\x00y").alias("\x00my"), *[F.avg(f"\x00x{i}").alias(f"\x00m{i}") for i in range(p)]]
    moments += [(F.covar_pop(f"\x00x{i}", f"\x00x{j}") * n).alias(f"\x00s{i}_{j}") for i, j in pairs] + [(F.covar_pop(f"\x00x{i}", "\x00y") * n).alias(f"\x00c{i}") for i in range(p)]
    g = known.groupBy(*by).agg(*moments)
    add = lambda terms: sum(terms, F.lit(0.0))
    low = lambda i, j: F.col(f"\x00l{i}_{j}")
    g = g.withColumn("collinear", F.col("n") <= p + 1)
    for i, j in pairs:  # the lower triangle of the root
        rest = F.col(f"\x00s{i}_{j}") - add(low(i, k) * low(j, k) for k in range(j))
        if i == j:
            g = g.withColumn("collinear", F.col("collinear") | (rest <= 1e-10 * F.col(f"\x00s{i}_{i}")) | (F.col(f"\x00s{i}_{i}") <= 0))
        g = g.withColumn(f"\x00l{i}_{j}", F.when(~F.col("collinear"), F.sqrt(rest) if i == j else rest / low(j, j)))
    unit = {(i, j): 1.0 if i == j else 0.0 for i in range(p) for j in range(p)}
    for name, right in [("b", [F.col(f"\x00c{i}") for i in range(p)]), *[(f"i{j}_", [F.lit(unit[i, j]) for i in range(p)]) for j in range(p)]]:
        for i in range(p):
            g = g.withColumn(f"\x00f{i}", (right[i] - add(low(i, k) * F.col(f"\x00f{k}") for k in range(i))) / low(i, i))
        for i in reversed(range(p)):
            g = g.withColumn(f"\x00{name}{i}", (F.col(f"\x00f{i}") - add(low(k, i) * F.col(f"\x00{name}{k}") for k in range(i + 1, p))) / low(i, i))
        g = g.drop(*[f"\x00f{i}" for i in range(p)])
    solved = g.select(*[F.col(f"`{c}`").alias(f"\x00k{k}") for k, c in enumerate(by)], "n", "collinear", "\x00my", *[f"\x00m{i}" for i in range(p)], *[f"\x00b{i}" for i in range(p)], *[f"\x00i{j}_{i}" for i in range(p) for j in range(p)])
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"\x00k{k}"))
    centred = lambda i: F.col(f"\x00x{i}") - F.col(f"\x00m{i}")
    residual = F.col("\x00y") - F.col("\x00my") - add(F.col(f"\x00b{i}") * centred(i) for i in range(p))
    keys = [f"\x00k{k}" for k in range(len(by))]
    once = [c for c in solved.columns if c not in keys]
    meat = known.join(solved, same).withColumn("\x00e", residual).groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in once], *[F.sum(F.col("\x00e") * F.col("\x00e") * centred(i) * centred(j)).alias(f"\x00q{i}_{j}") for i, j in pairs])
    q = lambda i, j: F.col(f"\x00q{max(i, j)}_{min(i, j)}")
    inverse = lambda i, j: F.col(f"\x00i{j}_{i}")
    se = lambda i: F.sqrt(add(inverse(i, j) * q(j, k) * inverse(i, k) for j in range(p) for k in range(p)) * F.col("n") / (F.col("n") - p - 1))
    intercept = F.col("\x00my") - add(F.col(f"\x00b{i}") * F.col(f"\x00m{i}") for i in range(p))
    terms = [F.struct(F.lit("const").alias("term"), intercept.alias("coef"), F.lit(None).cast("double").alias("se"))]
    terms += [F.struct(F.lit(x).alias("term"), F.col(f"\x00b{i}").alias("coef"), F.when(~F.col("collinear"), se(i)).alias("se")) for i, x in enumerate(xs)]
    return meat.select(*[F.col(f"\x00k{k}").alias(c) for k, c in enumerate(by)], F.explode(F.array(*terms)).alias("t"), "n", "collinear").select(*by, "t.term", "t.coef", "t.se", "n", "collinear")


def _slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def placebo_test(events: DataFrame, days: DataFrame, replicates: int = 200, seed: int = 1, id_col: str = "doc_id", x: str = "tone_change", day_col: str = "day", y: str = "ret") -> DataFrame:
    """One row (n, slope, p_value, low, high): the slope of the days' y on the events' x, and where it lies among slopes at placebo days.

    ``events`` has id, day and x. In each replicate every event is given a day drawn by a digest of seed, id and replicate, as good as at random
    and the same in each run; all replicates are one plan (events times replicates, joined with the numbered days, summed by
    replicate). p is the share of replicates whose slope is as far from 0, the event days' own counted in; low and high are the 2.5 and
    97.5 per cent points of the placebo slopes. Events without x or without their day's y are left out.
    """
    known = days.where(F.col(y).isNotNull()).select(F.col(day_col).alias("\x00day"), F.col(y).cast("double").alias("\x00y"))
    numbered = scan(known, ["\x00day"], {"\x00no": ("row_number", None), "\x00of": ("total", None)})
    own = events.where(F.col(x).isNotNull()).select(F.col(id_col).alias("\x00id"), F.col(day_col).alias("\x00at"), F.col(x).cast("double").alias("\x00x"))
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(e).alias(a) for a, e in (("sx", F.col("\x00x")), ("sy", F.col("\x00y")), ("sxy", F.col("\x00x") * F.col("\x00y")), ("sxx", F.col("\x00x") * F.col("\x00x")))]]
    slope = _slope(*[F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx")])
    used = own.join(numbered, F.col("\x00at") == F.col("\x00day"))
    actual = used.agg(*sums).select(F.col("n").cast("long").alias("n"), slope.alias("slope")).first()
    draws = used.select("\x00id", "\x00x", "\x00of", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("\x00r"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("\x00id").cast("string"), F.col("\x00r").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.withColumn("\x00drawn", digest % F.col("\x00of") + 1)
    made = draws.join(numbered.select(F.col("\x00no").alias("\x00drawn_no"), "\x00y"), F.col("\x00drawn") == F.col("\x00drawn_no")).groupBy("\x00r").agg(*sums).select(slope.alias("placebo"))
    own_slope = F.lit(actual["slope"]).cast("double")
    far = F.count_if(F.abs("placebo") >= F.abs(own_slope))
    return made.agg(
        F.lit(actual["n"]).cast("long").alias("n"), own_slope.alias("slope"), F.when(own_slope.isNotNull(), (far + 1) / (F.count("*") + 1)).alias("p_value"),
        F.percentile("placebo", F.lit(0.025)).alias("low"), F.percentile("placebo", F.lit(0.975)).alias("high"),
    )
