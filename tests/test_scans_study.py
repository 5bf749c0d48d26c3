"""Ordered scans in ranges, grouped regressions, the placebo distribution, and values that are set aside with their reasons."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonemill.functions import rejects
from tonemill.operators import tone
from tonemill.operators.scan import scan
from tonemill.plans import scoring, study

D = dt.date


def scan_rows(seed, n):
    rng = random.Random(seed)
    # A day with a third of all rows, days without a date, equal values, gaps.
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([D(2001, 1, 1), None, D(2001, 1, 1) + dt.timedelta(days=rng.randrange(90))]), rng.choice([None, 1.0, -2.0, rng.random()])) for i in range(n)]


ROWS = "id int, k string, day date, v double"


@pytest.mark.parametrize("by", [[], ["k"]])
def test_scan_equals_the_window(spark, by):
    order = ["day", "id"]
    wanted = {"before": ("lag", "v"), "top": ("running_max", "v"), "no": ("row_number", None), "coming": ("next", "v"), "of": ("total", None)}
    for n, parts in ((400, 7), (3, 5), (0, 3)):
        df = spark.createDataFrame(scan_rows(n, n), ROWS)
        w = Window.partitionBy(*by).orderBy(*order)
        want = df.select(
            "*", F.lag("v").over(w).alias("before"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"), F.row_number().over(w).alias("no"),
            F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("coming"), F.count("*").over(Window.partitionBy(*by)).alias("of"),
        )
        found = scan(df, order, wanted, by, parts)
        assert found.columns == want.columns and sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(ValueError):
        scan(df, order, {"x": ("mean", "v")})


def test_no_task_holds_all_rows(spark):
    df = spark.createDataFrame(scan_rows(1, 200), ROWS)
    scored = df.select(F.col("id").alias("doc_id"), F.col("day").alias("release_date"), (F.col("id") % 4 > 0).alias("scheduled"), F.col("v").alias("score"))
    events, days = df.select("id", F.col("day").alias("release_date")), spark.createDataFrame([(D(2001, 1, d),) for d in (3, 9, 20)], "day date")
    for out in (scan(df, ["day", "id"], {"b": ("lag", "v")}, parts=5), tone.tone_change(scored), study.align_to_days(events, days), scoring.holm(df.select("id", (F.abs(F.coalesce("v", F.lit(0.5))) / 100).alias("p")))):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_ranges_hold_alike_many_rows(spark):
    df = spark.createDataFrame([(i, D(2001, 1, 1)) for i in range(2000)], "id int, day date")  # one day
    from tonemill.operators.scan import range_of

    sizes = [r["count"] for r in df.groupBy(range_of(df, ["day", "id"], 8).alias("r")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * 2000 / 8


def test_a_sample_of_few_values_holds_them_all(spark):
    from tonemill.operators.scan import range_of

    df = spark.range(4000).select(F.expr("CAST(id % 40 AS INT)").alias("day"))  # each value a hundred times
    sizes = [r["count"] for r in df.groupBy(range_of(df, ["day"], 8).alias("r")).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2.5 * 4000 / 8


@pytest.mark.parametrize("by", [[], ["k"]])
def test_days_are_aligned_once_a_date(spark, by):
    events = spark.createDataFrame([(i, "ab"[i % 2], None if i % 10 == 9 else D(2001, 1, 1 + i % 7)) for i in range(300)], "id int, k string, release_date date")
    days = spark.createDataFrame([(k, D(2001, 1, d)) for k, d in (("a", 3), ("a", 3), ("a", 5), ("b", 1), ("b", 6), ("c", 7))], "k string, day date")
    out, known = study.align_to_days(events, days if by else days.drop("k"), by=by), days.collect()
    for r in out.collect():
        own = sorted(d for k, d in known if (not by or k == r.k) and r.release_date and d >= r.release_date)
        assert r.trading_day == (own[0] if own else None), r
    assert out.columns == ["id", "k", "release_date", "trading_day"] and out.count() == 300


def test_no_frame_ends_with_its_partition(spark):
    # Spark computes such a frame anew for each row.
    df = spark.createDataFrame(scan_rows(2, 50), ROWS)
    events, days = df.select("id", "k", F.col("day").alias("release_date")), df.select("k", "day").where("day IS NOT NULL")
    for made in (lambda: scan(df, ["day", "id"], {"c": ("next", "v")}, ["k"], 3), lambda: study.align_to_days(events, days, by=["k"])):
        assert "unboundedfollowing" not in made()._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("name", ["exact_sample", "tone_change_overall", "change_correlation"])
def test_texts_are_split_once(spark, name):
    from tonemill import queries

    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not any("documents.parquet" in f for f in found.inputFiles())  # what was made of them is read


def test_grouped_regressions_equal_the_driver_ones(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in ("a", "b", None):
        x = rng.normal(size=(60, 2)) * [1, 5] + [0, 1000]
        rows += [(g, "all", float(u), float(v), float(3 * u - 0.5 * v + rng.normal() * (1 + abs(u)))) for u, v in x]
    rows += [("same", "all", float(u), float(2 * u + 1), float(u)) for u in range(20)] + [("few", "all", 1.0, 2.0, 3.0), ("few", "all", 2.0, 5.0, 3.0)] + [("const", "all", 1.0, float(u), float(u)) for u in range(9)]
    rows += [("a", "all", None, 1.0, 1.0), ("a", "all", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, h string, u double, v double, y double")
    found = {(r.g, r.term): r for r in study.regressions(df, "y", ["u", "v"], ["g", "h"]).collect()}
    for g in ("a", "b", None):
        for want in study.ols_hc1(df.where(F.col("g").eqNullSafe(F.lit(g))), "y", ["u", "v"]):
            got = found[(g, want["term"])]
            assert got.coef == pytest.approx(want["coef"], rel=1e-6) and got.n == want["n"] == 60 and not got.collinear
            assert got.se is None if want["term"] == "const" else got.se == pytest.approx(want["se"], rel=1e-6)
    for g in ("same", "few", "const"):
        assert all(found[(g, t)].collinear and found[(g, t)].coef is None and found[(g, t)].se is None for t in ("const", "u", "v"))
    one = {r.term: r for r in study.regressions(df.where("g = 'b'"), "y", ["u"], ["g"]).collect()}
    assert [one["u"].coef, one["u"].se] == pytest.approx([study.ols_hc1(df.where("g = 'b'"), "y", ["u"])[1][k] for k in ("coef", "se")])


def test_placebo_equals_a_plain_loop(spark):
    import hashlib

    rng = random.Random(3)
    days = [(D(2001, 1, 1) + dt.timedelta(days=i), rng.gauss(0, 1) if i % 9 else None) for i in range(80)]
    events = [(f"e{i}", days[rng.randrange(80)][0], rng.choice([None, rng.gauss(0, 1)])) for i in range(40)] + [("late", D(2009, 1, 1), 1.0)]
    found = study.placebo_test(spark.createDataFrame(events, "doc_id string, day date, tone_change double"), spark.createDataFrame(days, "day date, ret double"), 30, 5).first()
    known = [(d, r) for d, r in sorted(days) if r is not None]
    returns = dict(known)
    own = [(i, x, returns[d]) for i, d, x in events if x is not None and d in returns]
    slope = lambda pairs: np.polyfit(*zip(*pairs), 1)[0]
    actual = slope([(x, y) for _, x, y in own])
    placebo = [slope([(x, known[int(hashlib.md5(f"5:{i}:{r}".encode()).hexdigest()[:8], 16) % len(known)][1]) for i, x, _ in own]) for r in range(1, 31)]
    assert found.n == len(own) and found.slope == pytest.approx(actual)
    assert found.p_value == pytest.approx((1 + sum(abs(s) >= abs(actual) for s in placebo)) / 31) and [found.low, found.high] == pytest.approx(list(np.quantile(placebo, [0.025, 0.975])))


def test_what_cannot_be_read_is_set_aside(spark, tmp_path):
    rows = [(1, "March", "/a/monetary20200102a.htm", "2", "15", "March 3-4"), (2, "Smarch", "/a/monetary20200231a.htm", "2", "75", "sometime"), (3, None, "/a/plain.htm", "12", "", None), (4, " ", None, None, None, "May 1"), (5, "mayor", "/20201301", "11", "59", "June 31")]
    df = spark.createDataFrame(rows, "id int, m string, url string, h string, mi string, span string")
    checks = {"month": rejects.month_checked(F.col("m")), "day": rejects.url_day_checked(F.col("url")), "time": rejects.time_checked(F.col("h"), F.col("mi"), F.lit("p")), "dates": rejects.span_checked(F.col("span"), F.lit(2020))}
    accepted, wrong = rejects.store_judged(spark, rejects.judge(df, checks), str(tmp_path / "judged"))
    assert {(r.id, r.column, r.reason) for r in wrong.collect()} == {
        (2, "month", "unknown month: Smarch"), (2, "day", "no such day: 20200231"), (2, "time", "no such minute: 2:75"), (2, "dates", "unreadable dates: sometime"), (5, "day", "no such day: 20201301"), (5, "dates", "unreadable dates: June 31"),
    }
    good = {r.id: (r.month, r.day, r.time) for r in accepted.collect()}
    assert good == {1: (3, D(2020, 1, 2), 855), 3: (None, None, 720), 4: (None, None, None)}
    none, nothing = rejects.store_judged(spark, rejects.judge(df.limit(0), checks), str(tmp_path / "none"))
    assert none.count() == nothing.count() == 0
