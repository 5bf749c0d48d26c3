"""Operator 6: n-gram Jaccard join by vertical partitioning of the global n-gram order.

A document is its set of distinct word shingles, held as 64-bit hashes. The steps:

1. One pass gives each document its set size and a 128-bit digest of its set (documents with equal sets are one class
   from here on), and adds every shingle of every document to a sketch of counts (ROWS x SLOTS counters, whatever the input's
   size; a shingle's least counter is at least its number of documents). The global order is by that estimate in small steps,
   rare first, then by hash. Any order gives the same links; this one keeps frequent shingles out of the
   prefixes, so no passage that many documents share makes pairs, and nothing of it is cut at a number.
2. Two sets that reach the similarity share a shingle in their prefixes (the first n - ceil(0.8 n) + 1 in the global
   order). Documents that meet at a prefix shingle are compared to the one of them for which that shingle stands
   first, under length and positional bounds, instead of all to all. Shingles that the sketch calls hot are grouped by
   partial sums and joined, never gathered by their key.
3. Compared pairs are verified by fragments: the global order is cut into FRAGMENTS (the hot shingles are the last
   one), each fragment's overlap is counted on its own, and the counts are summed per pair.
4. Links give components. Where a prefix shingle's documents still lie in different components, the pairs across them are
   verified too (all that the bounds allow), so no link is lost; pairs within a component can't change the result.

Defined cases: null and empty texts, and texts of white space, have the empty set and link with nothing; fewer words than
a shingle make one shingle of the whole sequence; rows that repeat an id repeat its document: one row per id and set
size comes back, and where texts differ the smallest digest stands for the id's links; a null id gets no component; other
columns are not carried. Two different shingles share a hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, bounded_batches, discard, settle, sliced, small, trimmed
from .components import components

WORDS, AT_LEAST, OUT_OF = 5, 4, 5
#: Cuts of the global order by hash; the hot shingles are one more.
FRAGMENTS = 8
#: The sketch of counts, and the pieces in which it is summed. A shingle is hot from so many documents, and so many times the mean counter.
ROWS, SLOTS, PIECES = 2, 1 << 21, 64
HOT_FROM, HOT_TIMES = 512, 8
#: Shingles gathered by a worker before they are added to its sketch.
STRETCH = 500_000
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of an odd base up to the longest word."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 256), 0x9E3779B97F4A7C15, dtype=np.uint64))])
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` (A-Z lower-cased, split at white space of ASCII), and where each text's words begin (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ) for t in texts]
    buf = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    lengths = ends - starts
    inside = np.flatnonzero(~space)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _BYTE[buf[inside]] * _power(int(lengths.max()) + 1)[within]
    hashes = mixed(np.add.reduceat(values, first))
    edges = np.cumsum([1, *[len(r) + 1 for r in raw]])
    return hashes, np.searchsorted(starts, edges)


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, begin = word_hashes(texts)
    n = len(words)
    every = np.zeros(0, dtype=np.uint64)
    if n >= width:
        every = np.full(n - width + 1, 0x2545F4914F6CDD1D, dtype=np.uint64)
        for k in range(width):
            every += words[k : n - width + 1 + k] * _STEP[k]
        every = mixed(every)
    out = []
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(mixed(np.array([np.sum(words[a:b] * _STEP[32 : 32 + b - a]) + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(every[:0])
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    one, two = mixed(s + np.uint64(0x632BE59BD9B4E019)), mixed(s ^ np.uint64(0x8CB92BA72F3D8DD7))
    return int(one.sum(dtype=np.uint64).astype(np.int64)), int(two.sum(dtype=np.uint64).astype(np.int64))


def slots(s: np.ndarray, row: int) -> np.ndarray:
    """The counters of shingles in one row of the sketch."""
    return ((s >> np.uint64(32 * row)) & np.uint64(SLOTS - 1)).astype(np.int64)


class Order:
    """The global order: by the estimated number of documents in steps of an eighth of an octave (what chance collisions spread), then by hash."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch
        self.hot_from = max(HOT_FROM, HOT_TIMES * float(sketch[0].mean(dtype=np.float64)))

    def counts(self, s: np.ndarray) -> np.ndarray:
        """Upper bounds of the numbers of documents that hold each shingle."""
        return np.minimum.reduce([self.sketch[row][slots(s, row)] for row in range(ROWS)])

    def sort(self, s: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The places of a sorted set in the global order."""
        return np.argsort((8 * np.log2(counts + 1)).astype(np.uint8), kind="stable")


def _ids(df: DataFrame, id_col: str) -> T.DataType:
    return df.schema[id_col].dataType


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_summaries(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of two kinds. Documents: id, n, s1, s2. Pieces of a task's sketch (piece is not null): n is the piece's number."""
    schema = T.StructType([T.StructField("id", _ids(docs, id_col)), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("piece", T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        sketch, held, size = np.zeros((ROWS, SLOTS), dtype=np.float32), [], 0

        def add():
            every = np.concatenate(held)
            for row in range(ROWS):
                sketch[row] += np.bincount(slots(every, row), minlength=SLOTS)

        for whole in batches:
            for batch in sliced(whole, 1, AT_ONCE):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                digests = [set_digest(s) for s in sets]
                k = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([d[0] for d in digests], type=pa.int64()), pa.array([d[1] for d in digests], type=pa.int64()), pa.nulls(k, pa.binary())], schema=out)
                held += sets
                size += sum(map(len, sets))
                if size >= STRETCH:
                    add()
                    held, size = [], 0
        if size:
            add()
        for n, piece in enumerate(sketch.reshape(ROWS * PIECES, -1)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, out.field(0).type), pa.array([n], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([pa.compress(piece.tobytes(), "zstd", asbytes=True)], pa.binary())], schema=out)

    return bounded_batches(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(trimmed(run), schema)


def global_order(summaries: DataFrame) -> Order:
    """The order, from the summed sketches of all tasks: ROWS x SLOTS numbers, whatever the input's size."""
    width = 4 * SLOTS // PIECES

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(pa.decompress(piece.as_buffer(), decompressed_size=width, codec="zstd", asbytes=True), dtype=np.float32)
                total[n] = total[n] + own if n in total else own
        for n, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["n", "piece"])

    pieces = summaries.where("piece IS NOT NULL").select("n", "piece").repartition("n").mapInArrow(run, "n long, piece binary").collect()
    sketch = np.zeros((ROWS * PIECES, SLOTS // PIECES), dtype=np.float32)
    for n, piece in pieces:
        sketch[n] = np.frombuffer(pa.decompress(bytes(piece), decompressed_size=width, codec="zstd", asbytes=True), dtype=np.float32)
    return Order(sketch.reshape(ROWS, SLOTS))


def of_digest(docs: DataFrame, width: int) -> DataFrame:
    """The rows of (id, text, s1, s2) whose text has the digest that is given."""

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, 1, AT_ONCE):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                yield batch.filter(pa.array([set_digest(s) == d for s, d in zip(sets, zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))], type=pa.bool_()))

    return bounded_batches(docs).mapInArrow(trimmed(run), docs.schema)


def prefixes(docs: DataFrame, order, width: int) -> DataFrame:
    """(h, node, n, pos, hot): the prefix shingles of documents given as (id, text, s1, s2); where a digest is given, texts with another one are passed over. ``order``: a broadcast Order."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("node", docs.schema[0].dataType), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("hot", T.BooleanType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, glob = to_arrow_schema(schema), order.value
        for whole in batches:
            for batch in sliced(whole, 1, AT_ONCE):
                keep, parts, hot = [], [], []
                for i, (s, one, two) in enumerate(zip(shingle_sets(batch.column(1).to_pylist(), width), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    if len(s) and (one is None or set_digest(s) == (one, two)):
                        counts = glob.counts(s)
                        first = glob.sort(s, counts)[: len(s) - -(-len(s) * AT_LEAST // OUT_OF) + 1]
                        keep.append(i)
                        parts.append((s[first], len(s)))
                        hot.append(counts[first] >= glob.hot_from)
                if keep:
                    sizes = np.array([len(p) for p, _ in parts])
                    ids = batch.column(0).take(pa.array(np.repeat(keep, sizes)))
                    n = np.repeat(np.array([k for _, k in parts], dtype=np.int32), sizes)
                    pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate([p for p, _ in parts]))), ids, pa.array(n), pa.array(pos.astype(np.int32)), pa.array(np.concatenate(hot))], schema=out)

    return docs.mapInArrow(trimmed(run), schema)


def fragments(docs: DataFrame, order, width: int) -> DataFrame:
    """(node, f, part): each document's shingles by fragment of the global order; documents as for ``prefixes``."""
    schema = T.StructType([T.StructField("node", docs.schema[0].dataType), T.StructField("f", T.IntegerType()), T.StructField("part", T.ArrayType(T.LongType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, glob = to_arrow_schema(schema), order.value
        shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)
        for whole in batches:
            for batch in sliced(whole, 1, AT_ONCE):
                rows, f, parts = [], [], []
                for i, (s, one, two) in enumerate(zip(shingle_sets(batch.column(1).to_pylist(), width), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    if not len(s) or (one is not None and set_digest(s) != (one, two)):
                        continue
                    is_in = glob.counts(s) >= glob.hot_from
                    rare = s[~is_in]
                    cuts = np.searchsorted(rare >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                    for k, piece in enumerate([*(rare[a:b] for a, b in zip(cuts[:-1], cuts[1:])), s[is_in]]):
                        if len(piece):
                            rows.append(i)
                            f.append(k)
                            parts.append(piece)
                if rows:
                    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(parts))))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(f, type=pa.int32()), lists.cast(out.field(2).type)], schema=out)

    return docs.mapInArrow(trimmed(run), schema)


def _possible(n: str, pos: str, m: str, qos: str) -> str:
    """Length and positional bounds: an overlap of 4/9 of the summed sizes must still be possible."""
    return f"({OUT_OF} * {n} >= {AT_LEAST} * {m}) AND ({OUT_OF} * {m} >= {AT_LEAST} * {n}) AND ({AT_LEAST + OUT_OF} * least({n} - {pos}, {m} - {qos}) >= {AT_LEAST} * ({n} + {m}))"


def verified(pairs: DataFrame, reps: DataFrame, order, width: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose similarity is reached: fragment overlaps counted apart and summed. ``reps``: (id, text, s1, s2)."""
    nodes = pairs.select(F.col("a").alias("x")).union(pairs.select(F.col("b").alias("x"))).distinct()
    wanted = reps.join(small(nodes), reps[reps.columns[0]] == F.col("x"), "left_semi")
    parts = settle(fragments(wanted, order, width), "jaccard-fragments")
    ends = small(pairs)
    left = parts.join(ends, parts["node"] == ends["b"]).select("a", "b", "na", "nb", "f", "part")
    right = parts.join(small(pairs.select(F.col("a").alias("x")).distinct()), parts["node"] == F.col("x"), "left_semi").select(F.col("node").alias("x"), F.col("f").alias("g"), F.col("part").alias("other"))
    both = left.join(right, (F.col("a") == F.col("x")) & (F.col("f") == F.col("g"))).select("a", "b", "na", "nb", F.size(F.array_intersect("part", "other")).alias("o"))
    total = both.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(f"{OUT_OF} * o >= {AT_LEAST} * (na + nb - o)").select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    sc = docs.sparkSession.sparkContext
    summaries = settle(set_summaries(docs, id_col, text_col, width), "jaccard-sets")
    order = sc.broadcast(global_order(summaries))
    sets = summaries.where("piece IS NULL").drop("piece")
    one = sets.where("id IS NOT NULL AND n > 0").groupBy("id").agg(F.min(F.struct("s1", "s2", "n")).alias("s")).select("id", "s.*")
    # Classes of more than one; a third of all rows may be one class, so its rows aren't gathered by a key where that can be helped.
    shared = one.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k")
    shared = small(settle(shared, "jaccard-shared"))
    member = settle(one.join(shared, ["s1", "s2", "n"], "left").withColumn("rep", F.coalesce("rep", "id")), "jaccard-classes")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Copies are few beside the documents: they go by an anti-join that can be a broadcast, and the digests stay in step.
    copies = small(member.where("id <> rep").select(F.col("id").alias("copy")))
    chosen = texts.join(copies, texts["id"] == copies["copy"], "left_anti").where("id IS NOT NULL")
    # One row per node: an id that is repeated stands once, by its smallest digest; such ids are few, so only their rows are gathered by a key.
    repeated = sets.where("id IS NOT NULL AND n > 0").groupBy("id").agg(F.count("*").alias("k"), F.min(F.struct("s1", "s2")).alias("s"))
    repeated = small(settle(repeated.where("k > 1").select(F.col("id").alias("again"), "s.*"), "jaccard-repeated"))
    again = chosen.join(repeated, chosen["id"] == repeated["again"]).select("id", "text", "s1", "s2")
    again = settle(of_digest(again, width).dropDuplicates(["id"]), "jaccard-once")
    once = chosen.join(repeated, chosen["id"] == repeated["again"], "left_anti")
    chosen = once.select("id", "text", F.lit(None).cast("long").alias("s1"), F.lit(None).cast("long").alias("s2")).union(again)

    rows = settle(prefixes(chosen, order, width), "jaccard-prefixes")
    # Small parts, so that what a task sorts stays small beside its heap whatever the input.
    parts = max(1, 4 * rows.rdd.getNumPartitions())
    cold = rows.where("NOT hot").repartition(parts, "h").selectExpr("h", "node", "n", "pos", "count(*) OVER (PARTITION BY h) AS cnt", "min(struct(pos, n, node)) OVER (PARTITION BY h) AS head", "min(n) OVER (PARTITION BY h) AS least_n").where("cnt > 1")
    # A hot shingle's documents may be a third of all: sums within tasks, then a join that can be a broadcast or is split.
    heads = rows.where("hot").groupBy("h").agg(F.count("*").alias("cnt"), F.min(F.struct("pos", "n", "node")).alias("head"), F.min("n").alias("least_n")).where("cnt > 1")
    heads = small(settle(heads, "jaccard-heads"))
    warm = rows.where("hot").select("h", "node", "n", "pos").join(heads, "h").select("h", "node", "n", "pos", "cnt", "head", "least_n")
    # A row that no partner's size lets pass is dropped at once: the overlap left behind its place is too small.
    viable = f"{AT_LEAST + OUT_OF} * (n - pos) >= {AT_LEAST} * (n + greatest(least_n, ({AT_LEAST} * n + {OUT_OF - 1}) div {OUT_OF}))"
    groups = settle(cold.unionByName(warm).where(viable).select("h", "node", "n", "pos", "head", "cnt"), "jaccard-groups")
    discard(rows)

    tried = groups.where("node <> head.node").where(_possible("n", "pos", "head.n", "head.pos"))
    tried = tried.select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb")).distinct()
    tried = settle(tried, "jaccard-pairs")
    links = settle(verified(tried, chosen, order, width), "jaccard-links")
    comp = components(links)

    # Where two documents meet, their one pair has been compared already.
    wider = groups.where("cnt > 2").drop("head", "cnt")
    labelled = wider.join(comp.withColumnRenamed("node", "x"), wider["node"] == F.col("x"), "left").selectExpr("h", "node", "n", "pos", "coalesce(component, node) AS c")
    labelled = settle(labelled, "jaccard-labelled")
    several = labelled.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select(F.col("h").alias("several"))
    several = small(settle(several, "jaccard-several"))
    mixed_groups = settle(labelled.join(several, labelled["h"] == several["several"], "left_semi"), "jaccard-mixed")
    discard(labelled, groups)
    p, q = mixed_groups.alias("p"), mixed_groups.alias("q")
    rest = p.join(q, F.expr("p.h = q.h AND p.node < q.node AND p.c <> q.c AND " + _possible("p.n", "p.pos", "q.n", "q.pos")))
    rest = rest.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()
    done = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    rest = settle(rest.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"), "jaccard-rest")
    more = verified(rest, chosen, order, width)
    comp = settle(components(links.unionByName(more)), "jaccard-components").withColumnsRenamed({"node": "x"})

    owner = member.join(comp, member["rep"] == F.col("x"), "left").select(F.col("id").alias("y"), F.coalesce("component", "rep").alias("component_id"))
    rows = sets.select("id", "n").distinct()
    out = rows.join(owner, rows["id"] == F.col("y"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their component (smallest id), with all their columns, one row for each id.

    Of rows that repeat an id one stays (which of equal texts is open; of different ones the one whose set has the smallest
    digest, as in the join; where no text of the id has words, any). Rows without an id are in no component: all stay.
    """
    found = settle(jaccard_components(docs, id_col, text_col), "jaccard-found")
    gone = small(settle(found.where("doc_id <> component_id").select(F.col("doc_id").alias("\x00gone")).distinct(), "jaccard-gone"))
    left = docs.join(gone, docs[id_col] == gone["\x00gone"], "left_anti")
    # Repeated ids are few beside the documents; only their rows are gathered by a key.
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("\x00k")).where("`\x00k` > 1")
    again = small(settle(again.select(F.col(id_col).alias("\x00again")), "jaccard-again"))
    once = left.join(again, left[id_col] == again["\x00again"], "left_anti")
    repeats = left.join(again, left[id_col] == again["\x00again"], "left_semi")
    return once.unionByName(_first_of_each(repeats, id_col, text_col))


def _first_of_each(docs: DataFrame, id_col: str, text_col: str, width: int = WORDS) -> DataFrame:
    """One row of each id: the one whose shingle set is not empty and has the smallest digest."""
    schema = T.StructType([*docs.schema.fields, T.StructField("\x00rank", T.ArrayType(T.LongType()))])
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, at, AT_ONCE):
                ranks = [[0, *set_digest(s)] if len(s) else [1, 0, 0] for s in shingle_sets(batch.column(at).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.list_(pa.int64()))], names=schema.names)

    ranked = bounded_batches(docs).mapInArrow(trimmed(run), schema)
    best = ranked.groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "\x00rank").alias("\x00row"))
    return best.select([F.col("`\x00row`")[c].alias(c) for c in docs.columns])
