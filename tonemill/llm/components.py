"""Connected components of an edge table, by alternating large and small stars.

Each round replaces every edge by edges to the smallest node known nearby, first for the larger neighbours, then for
the smaller ones; the edges end as stars around the smallest node of each component. A round is two grouped minima and
joins, its result is written to the shared folder in place of the last round's, and only two numbers of it reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; self-loops and null ends are passed over); component is the smallest node reached."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = settle(e, "components")
    mark = _mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        pairs = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        last, e = e, settle(small.select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "components")
        discard(last)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
