"""Operator 10: embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and halved. Each half has a codebook of its own (k-means on a bounded sample of
FIT_VECTORS vectors; words are as many as give cells of about A_CELL vectors), and every vector lies in the cell
that its two nearest words name. A query walks the grid's cells in the order of the summed squared distances of its
halves to the words (multi-sequence traversal: a heap that holds the next word of either half) until the target recall:
how far beyond the query's own cell it must go is measured, so that TARGET_RECALL of neighbours lie in a visited cell, on
neighbours that are made for the sample's vectors, their cosines spread evenly from the link's least cosine to one, and on
those that brute force finds within the sample. Every candidate of a visited cell is verified by its cosine in double
precision, so no link found is false. Vectors link within their number of components alone: each number that more than
BLOCK vectors have has an index of its own, the others are one cell each.

Cells are cut into blocks of about BLOCK vectors, and a block's queries into as many parts as its cell has blocks, so no task holds
a hot cell whole; members and queries meet as a matrix product, and what comes back are link counts and the edges of a
spanning forest, never pairs. What is shipped for a group of n vectors in one cell is 2 n * ceil(n / BLOCK) rows; equal vectors
are one row from the start.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; repeated ids
are one vector (the one that sorts first); a null id is passed over; equal vectors link (cosine 1); other columns are not
carried; with no usable vector every row stands alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, settle, small, trimmed
from .components import components

COSINE = 0.95
FIT_VECTORS, FIT_ROUNDS = 20_000, 8
WORDS_FEWEST, WORDS_MOST, A_CELL = 4, 4096, 128
TARGET_RECALL, MADE_NEIGHBOURS, ASKED_OF_ALL = 0.995, 4000, 1000
#: Vectors of one cell that one task holds together, about, and queries it multiplies at once.
BLOCK, QUERIES = 1024, 2048


def kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of k-means; fewer than k if there are fewer distinct points."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all points to all centres."""
    squares = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return np.sqrt(np.maximum(squares, 0))


def traverse(first: np.ndarray, second: np.ndarray, cells: np.ndarray, margin: float):
    """Cells with members (as i * words + j), nearest first, up to ``margin`` beyond the nearest words' summed squares.

    ``first``, ``second``: the query's squared distances to the words of either half.
    """
    least = first.min() + second.min()
    one, two = np.flatnonzero(first + second.min() <= least + margin), np.flatnonzero(second + first.min() <= least + margin)
    one, two = one[np.argsort(first[one], kind="stable")].tolist(), two[np.argsort(second[two], kind="stable")].tolist()
    near = first[one].tolist(), second[two].tolist()
    heap, seen = [(near[0][0] + near[1][0], 0, 0)], {(0, 0)}
    while heap:
        cost, a, b = heapq.heappop(heap)
        if cost > least + margin:
            return
        if cells[one[a], two[b]]:
            yield one[a] * cells.shape[1] + two[b]
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(one) and y < len(two) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (near[0][x] + near[1][y], x, y))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


class Index:
    """Codebooks, the traversal's margin, and which cells have members."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.one, self.two = one, two
        self.cells = np.zeros((len(one), len(two)), dtype=bool)
        self.margin = 0.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of both halves to their words."""
        h = x.shape[1] // 2
        return distances(x[:, :h], self.one), distances(x[:, h:], self.two)

    def measure(self, x: np.ndarray, cosine: float, recall: float = TARGET_RECALL, seed: int = 3) -> None:
        """Set the margin at which this share of neighbours lies in visited cells: of neighbours made for vectors of ``x``, and of those that brute force finds within ``x`` for some of them."""
        rng = np.random.default_rng(seed)
        asked = x[rng.choice(len(x), MADE_NEIGHBOURS)]
        c = rng.uniform(cosine, 1, len(asked))[:, None]
        away = rng.normal(size=asked.shape)
        away -= (away * asked).sum(1)[:, None] * asked
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
        found = [self._beyond(asked, c * asked + np.sqrt(1 - c * c) * away)]
        for k in range(0, ASKED_OF_ALL, 100):
            q, y = np.nonzero(asked[k : k + 100] @ x.T >= cosine)
            if len(q):
                some = rng.choice(len(q), min(len(q), 20_000), replace=False)
                found.append(self._beyond(asked[k + q[some]], x[y[some]]))
        self.margin = max(float(np.quantile(v, recall)) for v in (found[0], np.concatenate(found[1:] or found))) + 1e-9

    def _beyond(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (one, two), (i, j), at = self.halves(x), (d.argmin(1) for d in self.halves(y)), np.arange(len(x))
        return one[at, i] ** 2 + two[at, j] ** 2 - one.min(1) ** 2 - two.min(1) ** 2


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of length one, one row per id."""
    clean = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = clean.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    clean = clean.withColumn("top", norm).where("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    clean = clean.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return clean.groupBy("id").agg(F.min(F.transform("v", lambda x: x / F.col("length"))).alias("v"))


def _by_length(batch: pa.RecordBatch, column: int) -> list[tuple[int, pa.RecordBatch]]:
    """The parts of a batch whose vectors have equally many components."""
    lengths = pc.list_value_length(batch.column(column)).to_numpy()
    found = np.unique(lengths).tolist()
    return [(n, batch if len(found) == 1 else batch.filter(pa.array(lengths == n))) for n in found]


def fitted(every: DataFrame, dim: int, total: int, cosine: float) -> Index:
    """Codebooks and margin for the ``total`` vectors of ``dim`` components, from a bounded sample."""
    own = every.where(F.size("v") == dim)
    share = min(1.0, 1.2 * FIT_VECTORS / total)
    sample = np.array([r.v for r in (own.sample(share, 11) if share < 1 else own).limit(FIT_VECTORS).select("v").collect()] or [own.first().v])
    words = int(min(WORDS_MOST, max(WORDS_FEWEST, np.sqrt(total / A_CELL))))
    index = Index(kmeans(sample[:, : dim // 2], words), kmeans(sample[:, dim // 2 :], words))
    index.measure(sample, cosine)
    return index


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per id."""
    spark = vectors.sparkSession
    ids = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    # Equal vectors are one point with a weight from here on; they are known by 128 bits of their components.
    points = usable(vectors, id_col, vector_col).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    points = settle(points, "neighbours-vectors")
    classes = points.groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("p"), F.count("*").alias("m"))
    classes = settle(classes.select("h1", "h2", F.col("p.id").alias("rep"), F.col("p.v").alias("v"), "m"), "neighbours-classes")
    equal = small(settle(classes.where("m > 1").select("h1", "h2", "rep"), "neighbours-equal"))
    member = points.select("id", "h1", "h2").join(equal, ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    every = classes.select(F.col("rep").alias("id"), "v", "m")
    sizes = {r.dim: r["count"] for r in every.groupBy(F.size("v").alias("dim")).count().where(F.col("count") > BLOCK).collect()}
    # The codebooks fit on bounded samples; what they are changes the work, not the result.
    indexes = {dim: fitted(every, dim, total, cosine) for dim, total in sorted(sizes.items()) if dim > 1}
    book = spark.sparkContext.broadcast(indexes)

    id_type = every.schema["id"].dataType
    assigned_schema = T.StructType([T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("m", T.LongType())])

    def assign(batches):
        for whole in batches:
            for dim, batch in _by_length(whole, 1) if whole.num_rows else ():
                i = j = np.zeros(batch.num_rows)
                if dim in book.value:
                    one, two = book.value[dim].halves(_matrix(batch.column(1)))
                    i, j = one.argmin(1), two.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), batch.column(2)], names=[f.name for f in assigned_schema])

    assigned = settle(bounded_batches(every.select("id", "v", "m")).mapInArrow(trimmed(assign), assigned_schema), "neighbours-cells")
    # Which cells have members: one bitmap for each first word, at most WORDS_MOST of them for each index.
    for row in assigned.groupBy(F.size("v").alias("dim"), "i").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cast(j AS long) + 1))").alias("bits")).collect():
        if row.dim in indexes:
            cells = indexes[row.dim].cells
            cells[row.i] = np.unpackbits(np.frombuffer(bytes(row.bits), dtype=np.uint8), bitorder="little", count=cells.shape[1]).astype(bool)
    full = spark.sparkContext.broadcast(indexes)
    wide = F.create_map(*[F.lit(x) for dim, index in indexes.items() for x in (dim, index.cells.shape[1])]) if indexes else F.create_map(F.lit(0), F.lit(0))
    cell_of = (F.col("i") * F.coalesce(F.try_element_at(wide, F.size("v")), F.lit(0)) + F.col("j")).alias("cell")
    counts = assigned.groupBy(F.size("v").alias("dim"), cell_of).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Hot cells alone, at most one for every BLOCK vectors.
    blocks = spark.sparkContext.broadcast({(r.dim, r.cell): r.blocks for r in counts.where("blocks > 1").collect()})

    task_schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("asks", T.BooleanType()), T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("m", T.LongType())])

    def visit(batches):
        """Each vector as a member of its cell's block, once for every part of the queries, and as a query of all blocks of the cells that it visits."""
        from pyspark.sql.pandas.types import to_arrow_schema

        out, parts = to_arrow_schema(task_schema), blocks.value
        for whole in batches:
            for dim, batch in (p for start in range(0, whole.num_rows, 512) for p in _by_length(whole.slice(start, 512), 1)):
                x = _matrix(batch.column(1))
                index = full.value.get(dim)
                one, two = index.halves(x) if index else (None, None)
                i, j = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                place = np.frombuffer(x.tobytes(), dtype=np.uint64).reshape(x.shape)
                with np.errstate(over="ignore"):
                    spread = (place * np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64)).sum(1) >> np.uint64(17)
                ids_at = np.array([hash(v) for v in batch.column(0).to_pylist()], dtype=np.int64).view(np.uint64)
                rows, cell, block, asks = [], [], [], []
                for k in range(len(x)):
                    own = int(i[k]) * index.cells.shape[1] + int(j[k]) if index else 0
                    dealt = int(spread[k]) * 31 + int(ids_at[k])
                    n = parts.get((dim, own), 1)
                    rows += [k] * n
                    cell += [own] * n
                    block += [dealt % n * n + part for part in range(n)]
                    asks += [False] * n
                    for c in traverse(one[k] ** 2, two[k] ** 2, index.cells, index.margin) if index else (0,):
                        n = parts.get((dim, c), 1)
                        rows += [k] * n
                        cell += [c] * n
                        block += [b * n + dealt // n % n for b in range(n)]
                        asks += [True] * n
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(rows), type=pa.int32()), pa.array(cell, type=pa.int32()), pa.array(block, type=pa.int32()), pa.array(asks), batch.column(0).take(at), batch.column(1).take(at).cast(out.field(5).type), batch.column(4).take(at)], schema=out)

    found_schema = T.StructType([T.StructField("id", id_type), T.StructField("links", T.LongType()), T.StructField("other", id_type)])

    def meet(batches):
        """One partition, sorted by length, cell, block and asks: the block's members come first, then its queries."""
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(found_schema)
        key, members, weights, place, waiting = None, [], [], {}, []
        label = np.zeros(0, dtype=np.int64)

        def answer():
            nonlocal label
            rows = []
            if waiting and members:
                near = (np.vstack([w[1] for w in waiting]) @ np.vstack(members).T) >= cosine
                weight, names = np.array(weights), list(place)
                if len(label) != len(members):
                    label = np.arange(len(members))
                for q, (name, _, own) in enumerate(waiting):
                    linked = np.flatnonzero(near[q])
                    at = place.get(name)
                    n = int(weight[linked].sum())
                    if at is not None:  # itself: always a candidate, whatever its product rounds to
                        n -= int(weight[at]) * bool(near[q, at])
                        linked = linked[linked != at]
                        n += own - 1
                    if n:
                        rows.append((name, n, None))
                    if len(linked):
                        labels, where = np.unique(label[linked], return_index=True)
                        rows += [(name, 0, names[linked[w]]) for w in where]
                        if at is not None:
                            labels = np.union1d(labels, label[at])
                        if len(labels) > 1:
                            label[np.isin(label, labels)] = labels[0]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=out.field(k).type) for k in range(3)], schema=out) if rows else None

        for dim, batch in (p for whole in batches if whole.num_rows for p in _by_length(whole, 5)):
            x = _matrix(batch.column(5))
            cells, parts, asks, names, m = (batch.column(k).to_pylist() for k in (1, 2, 3, 4, 6))
            for k in range(len(x)):
                if (dim, cells[k], parts[k]) != key:
                    if (made := answer()) is not None:
                        yield made
                    key = (dim, cells[k], parts[k])
                    members.clear()
                    weights.clear()
                    place.clear()
                    label = label[:0]
                if asks[k]:
                    waiting.append((names[k], x[k], m[k]))
                    if len(waiting) >= QUERIES and (made := answer()) is not None:
                        yield made
                else:
                    place[names[k]] = len(members)
                    members.append(x[k])
                    weights.append(m[k])
        if (made := answer()) is not None:
            yield made

    spread = assigned.mapInArrow(trimmed(visit), task_schema).repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "asks")
    found = settle(spread.mapInArrow(trimmed(meet), found_schema), "neighbours-found")
    links = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "x")
    comp = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "y")
    out = ids.join(member.withColumnRenamed("id", "z"), ids["id"] == F.col("z"), "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(links, out["rep"] == links["x"], "left").join(comp, out["rep"] == comp["y"], "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
