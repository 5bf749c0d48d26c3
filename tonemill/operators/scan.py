"""Ordered scans whose rows needn't meet in one task: lag, running maximum, row number, next value.

Rows are dealt into ranges of their order (bounds from a sample of the rows: at most SAMPLED a range, whatever the table), each
range is scanned by a window of its own, and one carried row a range (its count, last value, greatest value, first value) is
scanned once more, by key or, without keys, on the driver, which holds a row a range then. A key with a third of all rows is dealt over
ranges like the rest. Where the bounds lie changes the work, never the result. The ranges' windows are written to the shared folder
before they are carried on, so nothing is computed twice.

The order should tell rows apart (end it with an id): equal rows may come in any order, as in any window. Nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files

#: Values sampled for each range.
SAMPLED = 20
KINDS = ("lag", "running_max", "row_number", "next", "total")


def _bounds(df: DataFrame, order: list[str], parts: int) -> list:
    """Order values between ranges: every SAMPLED-th of a sample. Rows are drawn, not values: by a hash of their values equal rows would be
    drawn together, and the sample of a table with few values would be one of them."""
    values = df.select(*order)
    some = values.orderBy(F.rand(7)).limit(parts * SAMPLED).orderBy(*order).collect()
    return list(dict.fromkeys(some[SAMPLED::SAMPLED]))


def range_of(df: DataFrame, order: list[str], parts: int) -> Column:
    """The range of each row, from 0: how many bounds are not above its order's values (a binary search over literals)."""
    bounds = _bounds(df, order, parts)
    if not bounds:
        return F.lit(0)
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])
    kinds = [df.schema[c].dataType for c in order]
    literal = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, kinds, strict=True))]) for row in bounds])

    def step(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below, left = F.get(literal, middle) <= key, acc["low"] < acc["high"]
        return F.struct(F.when(left & below, middle + 1).otherwise(acc["low"]).alias("low"), F.when(left & ~below, middle).otherwise(acc["high"]).alias("high"))

    steps = F.array(*[F.lit(0)] * len(bounds).bit_length())
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step, lambda acc: acc["low"])


def _carried(spark: SparkSession, ranges: DataFrame, wanted: dict[str, tuple[str, str | None]], by: list[str]) -> DataFrame:
    """For each range what comes before it (after it, for the next value)."""
    if by:
        earlier = Window.partitionBy(*by).orderBy("\x00scan-range")
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*by).orderBy(F.desc("\x00scan-range")).rowsBetween(Window.unboundedPreceding, -1)
        out = {"lag": lambda c: F.lag(c).over(earlier), "running_max": lambda c: F.max(c).over(before), "next": lambda c: F.last(c, ignorenulls=True).over(after)}
        columns = [out[kind](f"\x00scan-s-{n}").alias(f"\x00scan-c-{n}") for n, (kind, _) in wanted.items() if kind in out]
        return ranges.select(*by, "\x00scan-range", F.coalesce(F.sum("\x00scan-n").over(before), F.lit(0)).alias("\x00scan-before"), F.sum("\x00scan-n").over(Window.partitionBy(*by)).alias("\x00scan-all"), *columns)
    rows = ranges.orderBy("\x00scan-range").collect()  # one a range
    names = [n for n, (kind, _) in wanted.items() if kind in ("lag", "running_max", "next")]
    total, made = sum(r["\x00scan-n"] for r in rows), []
    for i, r in enumerate(rows):
        values = []
        for n in names:
            kind = wanted[n][0]
            past, future = [x[f"\x00scan-s-{n}"] for x in rows[:i]], [x[f"\x00scan-s-{n}"] for x in rows[i + 1 :]]
            known = [v for v in (future if kind == "next" else past) if v is not None]
            values.append((past[-1] if past else None) if kind == "lag" else max(known, default=None) if kind == "running_max" else next(iter(known), None))
        made.append((r["\x00scan-range"], sum(x["\x00scan-n"] for x in rows[:i]), total, *values))
    kinds = ", ".join(f"`\x00scan-c-{n}` {ranges.schema[f'\x00scan-s-{n}'].dataType.simpleString()}" for n in names)
    return spark.createDataFrame(made, "`\x00scan-range` int, `\x00scan-before` long, `\x00scan-all` long" + (f", {kinds}" if kinds else ""))


def scan(df: DataFrame, order: list[str], wanted: dict[str, tuple[str, str | None]], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``wanted`` (name: kind and value column), in the order given, within each key of ``by``.

    Kinds: ``lag`` (the value of the row before), ``running_max`` (greatest value up to the row), ``row_number`` (from 1), ``next`` (the first
    value at or after the row that is not null), ``total`` (rows of the key).
    """
    by, spark = by or [], df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    own = Window.partitionBy(*by, "\x00scan-range").orderBy(*order)
    # What follows is read from the end: Spark computes a frame that ends with the partition anew for each row.
    back = Window.partitionBy(*by, "\x00scan-range").orderBy(F.desc("\x00scan-at")).rowsBetween(Window.unboundedPreceding, 0)
    local = {"lag": lambda v: F.lag(v).over(own), "running_max": lambda v: F.max(v).over(own.rowsBetween(Window.unboundedPreceding, 0)), "next": lambda v: F.last(v, ignorenulls=True).over(back)}
    if unknown := {kind for kind, _ in wanted.values()} - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    dealt = df.withColumn("\x00scan-range", range_of(df, order, parts).cast("int"))
    scanned = dealt.select("*", F.row_number().over(own).alias("\x00scan-at"), *[local[kind](v).alias(f"\x00scan-l-{n}") for n, (kind, v) in wanted.items() if kind in ("lag", "running_max")])
    scanned = scanned.select("*", *[local[kind](v).alias(f"\x00scan-l-{n}") for n, (kind, v) in wanted.items() if kind == "next"])
    path = files.new_folder(spark, "scan")
    scanned.write.parquet(path)
    scanned = spark.read.schema(scanned.schema).parquet(path)

    def carry(name: str, kind: str, value: str) -> Column:
        if kind == "lag":
            return F.max_by(value, "\x00scan-at").alias(f"\x00scan-s-{name}")
        return F.max(value).alias(f"\x00scan-s-{name}") if kind == "running_max" else F.max(F.when(F.col("\x00scan-at") == 1, F.col(f"\x00scan-l-{name}"))).alias(f"\x00scan-s-{name}")

    ranges = scanned.groupBy(*by, "\x00scan-range").agg(F.count("*").alias("\x00scan-n"), *[carry(n, kind, v) for n, (kind, v) in wanted.items() if kind in local])
    carried = _carried(spark, ranges, wanted, by)
    right = carried.select(*[F.col(f"`{c}`").alias(f"\x00scan-k{i}") for i, c in enumerate(by)], F.col("\x00scan-range").alias("\x00scan-r"), *[F.col(f"`{c}`") for c in carried.columns if c not in (*by, "\x00scan-range")])
    same = F.col("\x00scan-range") == F.col("\x00scan-r")
    for i, c in enumerate(by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"\x00scan-k{i}"))
    joined = scanned.join(right if by else F.broadcast(right), same)  # without keys a row a range
    done = {
        "lag": lambda n: F.when(F.col("\x00scan-at") == 1, F.col(f"\x00scan-c-{n}")).otherwise(F.col(f"\x00scan-l-{n}")), "running_max": lambda n: F.greatest(f"\x00scan-l-{n}", f"\x00scan-c-{n}"), "next": lambda n: F.coalesce(f"\x00scan-l-{n}", f"\x00scan-c-{n}"),
        "row_number": lambda n: F.col("\x00scan-at") + F.col("\x00scan-before"), "total": lambda n: F.col("\x00scan-all"),
    }
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[done[kind](n).alias(n) for n, (kind, _) in wanted.items()])
