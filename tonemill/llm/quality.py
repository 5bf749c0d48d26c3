"""Operator 3: quality classifier, an interpolated modified Kneser-Ney model over byte 5-grams.

The model is a sharded table and is never gathered anywhere; it grows with what the trusted texts hold.

1. Counts. Workers count the 5-grams of trusted texts, the counts are summed by gram. Joins of each order's counts with
   their contexts' totals and with the order below give the modified Kneser-Ney estimates (three discounts an order; the
   lower orders count the bytes that precede a gram; the last is interpolated with the uniform distribution). The result
   has one row for each gram of 0 to 5 bytes: its probability after its context, and its weight as a context.
2. Perplexity by sharded count joins. Documents are taken in stretches of about STRETCH bytes. A stretch asks for each
   distinct gram that it holds once, whatever the number of its documents: the asked grams meet the model shard by
   shard (a gram's shard is its code modulo a prime number that grows with the model; the stretches of many parts of the
   documents are salted, and each salt meets a copy of the shard, so that what a task answers doesn't grow with the
   corpus), and the answers meet the stretch's texts, which travel compressed. So a frequent gram costs one entry a stretch, and no task holds more than
   one shard or one stretch.
3. Thresholds. One trusted text in HELD_OUT (by its hash) is not counted; the quantiles of those texts' scores, by
   language, bound the scores of what is kept, SLACK beyond them. The score is the mean negative log probability of
   a byte less the language's mean, with PRIOR bytes at that mean added, so very short texts aren't rejected by chance.

Defined cases: null and empty texts have no perplexity and are not kept; a null language is a language; languages with
fewer than LEAST_TRUSTED held-out documents use the quantile of all, those with fewer than LEAST_FOR_MEAN the mean of all
too; without any held-out document all trusted ones give the quantiles; with fewer than LEAST_HELD of either nothing is
rejected but empty texts; labels repeated for an id count as trusted if all of them are; repeated rows score
alike and each row is judged by its own text; other columns are not carried by ``classify`` and all stay in ``keep_good``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, rereadable, settle, sliced, small, trimmed

ORDER = 5
HIGH = 0.998
PRIOR = 100
SLACK = 0.03
HELD_OUT = 5
LEAST_TRUSTED, LEAST_FOR_MEAN = 50, 5
#: Fewer held-out texts than this say nothing of where clean texts end.
LEAST_HELD = 10
#: Parts of the documents whose questions one answering task takes from each shard; more parts are dealt out by a salt.
PARTS_A_SALT = 128
#: What stands before a text.
START = b"\n" * (ORDER - 1)
#: Bytes of text that ask the model together, and that are coded at once.
STRETCH, AT_ONCE = 16 << 20, 1 << 18
#: Rows of the model that one shard holds, about; shards are a prime number, 67 at least.
SHARD_ROWS = 250_000
#: Grams of different orders are told apart above their bytes.
PLACE = 8 * ORDER


def codes(raw: list[bytes]) -> np.ndarray:
    """The code of the ORDER bytes that end at each byte of each text, one text after the other."""
    buf = np.frombuffer(b"".join(x for r in raw for x in (START, r)), dtype=np.uint8).astype(np.int64)
    if len(buf) <= ORDER - 1:
        return np.zeros(0, dtype=np.int64)
    every = buf[: len(buf) - ORDER + 1].copy()
    for k in range(1, ORDER):
        every <<= 8
        every |= buf[k : len(buf) - ORDER + 1 + k]
    # What ends within the bytes before the next text belongs to none.
    ends = np.cumsum([len(r) + len(START) for r in raw])[:-1]
    cross = (ends[:, None] + np.arange(-len(START), 0)[None]).ravel()
    return np.delete(every, cross)


def distinct(codes: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def needed(top: np.ndarray) -> np.ndarray:
    """The sorted keys (order and code) of all that the probabilities of the 5-grams ``top`` depend on."""
    out = []
    for k in range(ORDER):
        mask = (1 << 8 * k) - 1
        out.append(distinct(np.concatenate([top & mask, (top >> 8) & mask])) | (k << PLACE))
    return np.concatenate([*out, top | (ORDER << PLACE)])


def chances(top: np.ndarray, keys: np.ndarray, p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of the 5-grams ``top``; ``p`` and ``g`` answer ``keys`` (not a number: the model has no such gram or context)."""
    out = np.full(len(top), 1 / 256)
    for k in range(1, ORDER + 1):
        gram = (top & ((1 << 8 * k) - 1)) | (k << PLACE)
        context = ((top >> 8) & ((1 << 8 * (k - 1)) - 1)) | ((k - 1) << PLACE)
        seen, weight = p[np.searchsorted(keys, gram)], g[np.searchsorted(keys, context)]
        out = np.where(np.isnan(seen), np.where(np.isnan(weight), 1.0, weight) * out, seen)
    return out


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that all their labels call good and none toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(good.cast("int")).alias("good")).where("good = 1").select(F.col(id_col).alias("\x00id"))


def gram_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): how often each 5-gram occurs."""

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, 0, 4 << 20):
                held = np.sort(codes(_bytes(batch.column(0).to_pylist())))
                if len(held):
                    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(held[first]), pa.array(np.diff(np.append(first, len(held))))], names=["gram", "n"])

    return bounded_batches(texts.select(F.col(f"`{text_col}`"))).mapInArrow(trimmed(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of one order, from the numbers of entries seen once to four times."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(v or 0) for v in row)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(d)]


def fit(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The model of the given texts, by joins of sharded counts: (key, p, g) for every gram of 0 to ORDER bytes."""
    spark = texts.sparkSession
    counts = {ORDER: settle(gram_counts(texts, text_col), "quality-counts")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = settle(counts[k + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")), "quality-counts")
    rows, lower = [], None
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = counts[k].select("gram", "n", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("suffix"))
        weights = own.groupBy("context").agg(F.sum("n").alias("t"), F.sum(F.least(cut, F.col("n"))).alias("left"))
        weights = settle(weights.select("context", "t", (F.col("left") / F.col("t")).alias("g")), "quality-weights")
        shares = own.join(weights, "context")
        if lower is None:
            chance = F.col("g") / 256
        else:
            shares, chance = shares.join(lower, "suffix"), F.col("g") * F.col("q")
        found = shares.select("gram", (F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("t") + chance).alias("p"))
        found = settle(found, "quality-order")
        rows.append(weights.select((F.col("context") + (k - 1 << PLACE)).alias("key"), F.lit(None).cast("float").alias("p"), F.col("g").cast("float").alias("g")))
        rows.append(found.select((F.col("gram") + (k << PLACE)).alias("key"), F.col("p").cast("float").alias("p"), F.lit(None).cast("float").alias("g")))
        lower = found.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
    model = rows[0]
    for more in rows[1:]:
        model = model.union(more)
    return settle(model.groupBy("key").agg(F.max("p").alias("p"), F.max("g").alias("g")), "quality-model") if rows else spark.createDataFrame([], "key long, p float, g float")


def _prime(least: int) -> int:
    while any(least % k == 0 for k in range(2, int(least**0.5) + 1)):
        least += 1
    return least


class _Stretch:
    """Batches of one stretch, cut to pieces, and the name that its texts give it."""

    def __init__(self, number: int):
        self.number, self.size, self.part, self.pieces, self.mark = number, 0, -1, [], hashlib.blake2b(digest_size=8)

    def add(self, piece: pa.RecordBatch, raw: list[bytes]) -> None:
        self.pieces.append(piece)
        for r in raw:
            self.mark.update(len(r).to_bytes(8, "little"))
            self.mark.update(r)
            self.size += len(r)

    @property
    def name(self) -> str:
        return f"{self.part}-{self.number}-{self.mark.hexdigest()}"


def stretches(batches, text: int, limit: int) -> Iterator[_Stretch]:
    """The batches of one partition (its number stands after the texts) in stretches; the same for each reading of the same rows."""
    held = _Stretch(0)
    for whole in batches:
        held.part = whole.column(text + 1)[0].as_py() if whole.num_rows else held.part
        for piece in sliced(whole, text, min(AT_ONCE, limit)):
            held.add(piece, _bytes(piece.column(text).to_pylist()))
            if held.size >= limit:
                yield held
                number, part = held.number + 1, held.part
                held = _Stretch(number)
                held.part = part
    if held.pieces:
        yield held


ASKS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("stretch", T.StringType()), T.StructField("key", T.LongType()), T.StructField("p", T.FloatType()), T.StructField("g", T.FloatType()), T.StructField("keys", T.BinaryType())])
PARTS = T.StructType([T.StructField("stretch", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("one", T.BinaryType()), T.StructField("two", T.BinaryType())])


def perplexities(docs: DataFrame, model: DataFrame, text_col: str = "text", keep: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """``keep`` (all columns), ``n_bytes`` and ``nll``: the summed negative log probability of the text. ``docs`` is read twice, by the same partitions."""
    keep = list(docs.columns) if keep is None else keep
    width = len(keep)
    source = rereadable(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("\x00text")), "quality-texts")
    source = bounded_batches(source.withColumn("\x00part", F.spark_partition_id()))
    shards, salts = _prime(max(67, -(-model.count() // SHARD_ROWS))), -(-max(1, source.rdd.getNumPartitions()) // PARTS_A_SALT)

    def ask(batches):
        for held in stretches(batches, width, stretch):
            top = distinct(np.concatenate([distinct(codes(_bytes(x.column(width).to_pylist()))) for x in held.pieces]))
            keys = needed(top)
            shard, salt = keys % shards, zlib.crc32(held.name.encode()) % salts
            for k in np.unique(shard):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k * salts + salt], pa.int32()), pa.array([held.name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float32()), pa.nulls(1, pa.float32()), pa.array([keys[shard == k].tobytes()], pa.binary())], names=ASKS.names
                )

    def answer(batches):
        """One partition, by shard: the shard's part of the model comes first, then the stretches that ask."""
        now, parts, table = None, [], None
        for batch in batches:
            shard, asks = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_valid())
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])])) if len(shard) else []
            for a, b in zip(edges, [*edges[1:], len(shard)]):
                if shard[a] != now:
                    now, parts, table = shard[a], [], None
                if not asks[a]:
                    parts.append([batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (2, 3, 4)])
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)]
                    parts = []
                    by_key = np.argsort(table[0])
                    table = [np.append(c[by_key], end) for c, end in zip(table, (np.int64(-1), np.float32("nan"), np.float32("nan")))]
                    table[0] = table[0][:-1]
                for row in range(a, b):
                    keys = np.frombuffer(batch.column(5)[row].as_buffer(), dtype=np.int64)
                    at = np.searchsorted(table[0], keys)
                    hit = at < len(table[0])
                    hit[hit] = table[0][at[hit]] == keys[hit]
                    at = np.where(hit, at, len(table[0]))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, 1), pa.array([1 << 30 | int(now) // salts], pa.int32()), pa.array([table[1][at].tobytes()], pa.binary()), pa.array([table[2][at].tobytes()], pa.binary())], names=PARTS.names)

    kept = T.StructType([docs.schema[c] for c in keep])

    def carry(batches):
        """The texts of each stretch, compressed, with their rows' columns."""
        for held in stretches(batches, width, stretch):
            for n, piece in enumerate(held.pieces):
                texts = _bytes(piece.column(width).to_pylist())
                raw = b"".join(texts)
                rows = piece.select(list(range(width))).append_column("\x00n", pa.array([len(t) for t in texts], pa.int64()))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                packed = len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")
                yield pa.RecordBatch.from_arrays([pa.array([held.name]), pa.array([n], pa.int32()), pa.array([packed], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=PARTS.names)

    added = [free_name(docs, c, keep) for c in ("n_bytes", "nll")]
    schema = T.StructType([*kept.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.DoubleType())])

    def rate(batches):
        """One partition, by stretch: its texts come first, then the answers of all shards."""
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        now, texts, answers = None, [], {}

        def unpacked(packed, sizes):
            raw, n = packed[8:], int.from_bytes(packed[:8], "little")
            raw = pa.decompress(raw, decompressed_size=n, codec="zstd", asbytes=True) if n else b""
            ends = np.cumsum(sizes)
            return [raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]

        def rated():
            rows = [pa.ipc.open_stream(two).read_all().combine_chunks() for _, two in texts]
            sizes = [r.column(width).to_numpy() for r in rows]
            top = distinct(np.concatenate([distinct(codes(unpacked(one, s))) for (one, _), s in zip(texts, sizes)]))
            keys = needed(top)
            shard = keys % shards
            p, g = np.empty(len(keys), dtype=np.float32), np.empty(len(keys), dtype=np.float32)
            for k in np.unique(shard):
                if int(k) not in answers:
                    raise RuntimeError(f"stretch {now} has no answer: the documents changed between two readings")
                own = shard == k
                p[own], g[own] = (np.frombuffer(x, dtype=np.float32) for x in answers[int(k)])
            cost = -np.log(chances(top, keys, p.astype(np.float64), g.astype(np.float64)))
            for (one, _), s, r in zip(texts, sizes, rows):
                sums = np.concatenate([[0.0], np.cumsum(cost[np.searchsorted(top, codes(unpacked(one, s)))])])
                ends = np.cumsum(s)
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in r.columns[:width]]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(columns, out_schema)], pa.array(s), pa.array(sums[ends] - sums[ends - s])], schema=out_schema)

        for batch in batches:
            for name, at, one, two in zip(*(batch.column(k) for k in range(4))):
                if (name := name.as_py()) != now:
                    if texts:
                        yield from rated()
                    now, texts, answers = name, [], {}
                if (at := at.as_py()) < 1 << 30:
                    texts.append((one.as_py(), two.as_py()))
                else:
                    answers[at ^ 1 << 30] = (one.as_py(), two.as_py())
        if texts:
            yield from rated()

    shared = model.select(F.explode(F.expr(f"transform(sequence(0, {salts - 1}), salt -> cast(pmod(key, {shards}) AS int) * {salts} + salt)")).alias("shard"), F.lit(None).cast("string").alias("stretch"), "key", "p", "g", F.lit(None).cast("binary").alias("keys"))
    met = shared.union(source.mapInArrow(trimmed(ask), ASKS)).repartition("shard").sortWithinPartitions("shard", "stretch")
    answers = met.mapInArrow(trimmed(answer), PARTS)
    texts = source.mapInArrow(trimmed(carry), PARTS)
    # As many parts as the texts' readings ask for: a part's stretches don't grow with the input.
    return answers.union(texts).repartition(max(1, 2 * source.rdd.getNumPartitions()), "stretch").sortWithinPartitions("stretch", "at").mapInArrow(trimmed(rate), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high: float = HIGH) -> DataFrame:
    """One row per document: doc_id, lang, text_hash, n_bytes, perplexity (of a byte), score, keep."""
    good = small(settle(trusted_ids(labels, id_col), "quality-trusted"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("\x00t"))
    trusted = slim.join(good, F.col("doc_id") == good["\x00id"], "left_semi")
    held_out = F.pmod("text_hash", F.lit(HELD_OUT)) == 0
    model = fit(trusted.where(~held_out), "\x00t")
    scored = settle(perplexities(slim, model, "\x00t", ["doc_id", "lang", "text_hash"]), "quality-scores")
    known = scored.where("n_bytes > 0").join(good, F.col("doc_id") == good["\x00id"], "left_semi")
    some = settle(known.where(held_out), "quality-held-out")
    known = some if some.take(1) else known
    means = known.groupBy("lang").agg(F.count("*").alias("docs"), (F.sum("nll") / F.sum("n_bytes")).alias("mean"))
    means = means.where(F.col("docs") >= LEAST_FOR_MEAN).select(F.col("lang").alias("l"), "mean")
    whole = known.agg((F.sum("nll") / F.sum("n_bytes")).alias("mean")).first()["mean"]

    def with_score(df):
        joined = df.join(small(means, 10_000), df["lang"].eqNullSafe(F.col("l")), "left").drop("l")
        mean = F.coalesce("mean", F.lit(float(whole or 0.0)))
        return joined.withColumn("score", F.when(F.col("n_bytes") > 0, (F.col("nll") - mean * F.col("n_bytes")) / (F.col("n_bytes") + PRIOR))).drop("mean")

    end = F.percentile_approx("score", high, 20_000).alias("high")
    rated = with_score(known)
    bounds = rated.groupBy("lang").agg(F.count("*").alias("docs"), end).where(F.col("docs") >= LEAST_TRUSTED).select(F.col("lang").alias("l"), "high")
    all_of = rated.agg(end, F.count("score").alias("n")).first()
    high_all = all_of["high"] if all_of["n"] >= LEAST_HELD else None
    out = with_score(scored)
    out = out.join(small(bounds, 10_000), out["lang"].eqNullSafe(F.col("l")), "left")
    inside = F.col("score") <= F.coalesce("high", F.lit(high_all)) + SLACK
    keep = F.col("score").isNotNull() & (inside if high_all is not None else F.lit(True))
    return out.select("doc_id", "lang", "text_hash", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes"))).alias("perplexity"), "score", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The kept documents with all their columns; each row is judged by its own id, language and text."""
    found = settle(classify(docs, labels, id_col, text_col, lang_col), "quality-found")
    gone = small(settle(found.where("NOT keep").select(F.col("doc_id").alias("\x00gone"), F.col("lang").alias("\x00lang"), F.col("text_hash").alias("\x00hash")).distinct(), "quality-gone"))
    same = docs[id_col].eqNullSafe(gone["\x00gone"]) & docs[lang_col].eqNullSafe(gone["\x00lang"]) & (F.xxhash64(docs[text_col]) == gone["\x00hash"])
    return docs.join(gone, same, "left_anti")
