"""Operator 13: vector code compression, with the nearest codebook entries found by a vector-approximation file.

Vectors of integers floor(SCALE * x) are cut into PARTS; each part position has a codebook of at most ENTRIES entries, and a vector's
code is one entry a part. The nearest entry is found by filtering: an entry's coordinates are quantised to CELL_BITS bits, that is to
cells; for each query part a table holds the least and the greatest squared distance of each of its coordinates to each cell, and sums
over the table bound the distance to an entry from below and above. Only entries whose lower bound is not above the least upper bound
are compared by exact integer distances; ties go to the lower entry.

A round is one pass: each batch of vectors sums its parts by entry, Spark adds those sums up, and the new codebooks (PARTS * ENTRIES
rows, whatever the table) go to the driver and back. The last pass writes codes and errors; sums by label combine before their
shuffle, and labels that hold more than a thousandth of all rows (so at most a thousand) are joined by broadcast, the others by a
shuffle none of whose keys can be hot.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors of each length have codebooks of
their own (part k of PARTS ends before component (k + 1) * length // PARTS, so parts of short vectors can be empty, at distance 0);
fewer than ENTRIES distinct ids give as many entries; a repeated id begins a codebook once, by its least vector, and each of its rows
gets a code; a row with a null id gets a code and begins none; integers beyond LIMIT are cut to it, so that sums of squares stay
within 64 bits; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, settle, small, trimmed
from .neighbours import _by_length, _matrix

SCALE, PARTS, ENTRIES, ROUNDS, CELL_BITS = 256, 16, 64, 2, 4
#: Integers are cut to this size either way.
LIMIT = 1 << 24
#: Vectors compared at once within a worker.
CHUNK = 1024
#: A label with more than this share of all rows is hot.
HOT_SHARE = 1000


def integers(column: pa.Array) -> np.ndarray:
    """The rows of a list column as integers floor(SCALE * x)."""
    return np.clip(np.floor(SCALE * _matrix(column)), -LIMIT, LIMIT).astype(np.int64)


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends."""
    return [(k * dim // parts, (k + 1) * dim // parts) for k in range(parts)]


class Approximations:
    """The cells of one codebook's entries, and the search for the nearest entry through them."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        least, most = entries.min(axis=0), entries.max(axis=0)
        n = 1 << bits
        self.width = (most - least) // n + 1  # whole numbers, so that every entry lies within its cell
        self.cell = (entries - least) // self.width
        self.low = least + np.arange(n)[:, None] * self.width  # (cells, dim)
        self.high = self.low + self.width - 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (ties to the lower) and its squared distance."""
        lower, upper = (np.zeros((len(x), len(self.entries)), dtype=np.int64) for _ in range(2))
        for j in range(x.shape[1]):
            below, above = self.low[:, j] - x[:, j : j + 1], x[:, j : j + 1] - self.high[:, j]
            near, far = np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2
            lower += near[:, self.cell[:, j]]
            upper += far[:, self.cell[:, j]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))  # in order of rows, then entries; at least one a row
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, first) if len(x) else exact
        hit = np.flatnonzero(exact == best[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], best


class Codebooks:
    """One codebook for each part position of vectors of one length."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.found = [Approximations(b) for b in books]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and squared distances (rows, parts)."""
        answers = [a.nearest(x[:, s:e]) for a, (s, e) in zip(self.found, cuts(x.shape[1]), strict=True)]
        return np.stack([a[0] for a in answers], axis=1), np.stack([a[1] for a in answers], axis=1)

    def digest(self) -> str:
        """All entries' components by part, entry and position, in decimals with commas, as a digest."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    clean = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    return clean.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _smallest(usable: DataFrame) -> list:
    """The ENTRIES smallest ids, ascending. Each reading keeps ENTRIES rows a partition and goes on above the last id, so repeats cost no shuffle."""
    found: list = []
    while len(found) < ENTRIES:
        rest = usable.where(F.col("id") > F.lit(found[-1])) if found else usable.where("id IS NOT NULL")
        more = list(dict.fromkeys(r.id for r in rest.select("id").orderBy("id").limit(ENTRIES).collect()))
        if not more:
            break
        found += more
    return found[:ENTRIES]


def _first(usable: DataFrame) -> dict[int, Codebooks]:
    """The codebooks to begin with: parts of the ENTRIES smallest ids, for each length of vectors (a vector column has few lengths)."""
    out = {}
    for dim in sorted(r.dim for r in usable.select(F.size("v").alias("dim")).distinct().collect()):
        own = usable.where(F.size("v") == dim)
        ids = _smallest(own)
        rows = own.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if ids else []
        seeds = [r.v for r in rows] or [[0.0] * dim]
        x = integers(pa.array(seeds, type=pa.list_(pa.float64()))).reshape(len(seeds), dim) if dim else np.zeros((len(seeds), 0), dtype=np.int64)
        out[dim] = Codebooks([x[:, s:e] for s, e in cuts(dim)])
    return out


def _chunks(batches, column: int):
    """(length, part of a batch) of at most CHUNK vectors of equal length."""
    for whole in batches:
        for start in range(0, whole.num_rows, CHUNK):
            yield from _by_length(whole.slice(start, CHUNK), column)


def _ints(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return integers(batch.column(column)).reshape(batch.num_rows, dim) if dim else np.zeros((batch.num_rows, 0), dtype=np.int64)


def _moved(usable: DataFrame, books: dict[int, Codebooks]) -> dict[int, Codebooks]:
    """The codebooks after one round: each entry the floored mean of the parts nearest to it; unused entries stay."""
    shared = usable.sparkSession.sparkContext.broadcast(books)
    sums_schema = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("dim", "part", "entry", "place")], T.StructField("total", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(sums_schema)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, batch in _chunks(batches, 0):
            x = _ints(batch, 0, dim)
            code, _ = shared.value[dim].encode(x)
            total, count = held.setdefault(dim, (np.zeros((ENTRIES, dim), dtype=np.int64), np.zeros((PARTS, ENTRIES), dtype=np.int64)))
            for part, (s, e) in enumerate(cuts(dim)):
                np.add.at(total[:, s:e], code[:, part], x[:, s:e])
                count[part] += np.bincount(code[:, part], minlength=ENTRIES)
        for dim, (total, count) in held.items():
            rows = [(dim, part, entry, p, int(total[entry, p]), int(count[part, entry])) for part, (s, e) in enumerate(cuts(dim)) for entry in np.flatnonzero(count[part]).tolist() for p in range(s, e)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=schema.field(k).type) for k in range(6)], schema=schema)

    sums = bounded_batches(usable.select("v")).mapInArrow(trimmed(run), sums_schema)
    sums = sums.groupBy("dim", "part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = {dim: [b.copy() for b in books[dim].books] for dim in books}
    for r in sums.collect():  # one row a component of an entry
        out[r.dim][r.part][r.entry, r.place - cuts(r.dim)[r.part][0]] = int(r.total) // r.n
    shared.unpersist()
    return {dim: Codebooks(b) for dim, b in out.items()}


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, codes, error, label_error, codebooks_sha256): one row for each vector that is not dropped.

    ``codes``: one byte a part; ``error``: the squared distances to the entries, summed over the parts; ``label_error``: the errors
    of equal labels summed, nulls together; ``codebooks_sha256``: the codebooks of the vector's length.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col, label_col)
    books = _first(usable)
    for _ in range(rounds):
        books = _moved(usable, books)
    shared = spark.sparkContext.broadcast(books)
    coded_schema = T.StructType([usable.schema["id"], usable.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(coded_schema)
        for dim, batch in _chunks(batches, 2):
            code, far = shared.value[dim].encode(_ints(batch, 2, dim))
            packed = code.astype(np.uint8).tobytes()
            codes = pa.array([packed[k : k + PARTS] for k in range(0, len(packed), PARTS)], type=schema.field(3).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([dim] * batch.num_rows, type=pa.int32()), codes, pa.array(far.sum(axis=1))], schema=schema)

    coded = settle(bounded_batches(usable.select("id", "label", "v")).mapInArrow(trimmed(run), coded_schema), "codes")
    totals = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("label", "of"), "codes-labels")
    digests = F.create_map(*[F.lit(v) for dim, b in books.items() for v in (dim, b.digest())]) if books else F.create_map(F.lit(-1), F.lit(""))
    same = F.col("label").eqNullSafe(F.col("of"))
    if totals is not (few := small(totals)):
        joined = coded.join(few, same)
    else:  # labels above a thousandth of all rows are at most a thousand
        n = totals.agg(F.sum("n")).first()[0] or 0
        hot = totals.where(F.col("n") * HOT_SHARE > n)
        marked = coded.join(F.broadcast(hot.select(F.col("of").alias("hot"), F.col("label_error").alias("hot_error"))), F.col("label").eqNullSafe(F.col("hot")), "left")
        cold = marked.where("hot_error IS NULL").join(totals, same).select(*coded.columns, "label_error")
        joined = marked.where("hot_error IS NOT NULL").select(*coded.columns, F.col("hot_error").alias("label_error")).unionByName(cold)
    return joined.select(F.col("id").alias("vec_id"), "label", "codes", "error", "label_error", F.element_at(digests, F.col("dim")).alias("codebooks_sha256"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The query's columns: codes as lower-case hex digits."""
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")
