"""Operator 1 (native): benchmark decontamination by a prefix-filtered set join.

Words of an item form windows (13 words; a shorter item is one window). A window is a set of word shingles and a
document contains it only if it contains all of them, so the shingles are ordered by rarity in the corpus and one
prefix token, the rarest shingle, is enough to find every occurrence. The steps, all DataFrame operations:

1. one pass over the documents keeps the positions whose shingle occurs in any item: (document, position, shingle) rows
   without their words, semi-joined on the shingle's hash and written once;
2. counts over those rows give each shingle's rarity, and each window its prefix token; windows with a shingle
   that no document holds are gone here;
3. positions join the windows on the prefix token; the window must fit between the document's ends (positional
   and length bound); what is left are candidates, small numbers again;
4. documents that have candidates are read once more, and the words at each candidate's place are compared one by one;
5. hit words are the union of the occurrences, summed with a running maximum; items are counted once a document.

No row that is exchanged holds more words than a window, and no joined key is null, so the plan is the same whether the
benchmark's shingles can be broadcast or not.

Defined cases: a null or empty text has no words, no hits and isn't contaminated; rows that repeat both id and text
give one result row, rows that share an id but not the text one each, a null id is an id; items without words (or a
null text) are passed over; items that share an id are one item, a null item id is listed as the empty string; with
an empty benchmark nothing is hit. Other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, settle, small

WINDOW_WORDS = 13
SHINGLE_WORDS = 4
#: A document is contaminated from one hit word in this many words.
ONE_IN = 20
#: What separates words once A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: array of strings, empty for null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), BREAKS), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def _windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, win): every window of every item, win an array of words."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))))
    return items.select("item", F.slice("w", F.col("at") + 1, size).alias("win")).distinct()


def _shingles(windows: DataFrame, width: int) -> DataFrame:
    """(wid, len, off, w, key): every shingle of each window."""
    spread = windows.withColumn("w", F.least("len", F.lit(width)))
    spread = spread.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("w"))))
    key = reduce(lambda rest, n: F.when(F.col("w") == n, _shingle(F.col("win"), F.col("off"), n)).otherwise(rest), range(1, width + 1), F.lit(None).cast("long"))
    return spread.select("wid", "len", "off", "w", key.alias("key"))


def _positions(source: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, text_hash, n, pos, key): each place of a document and its shingle of each width, without the words."""
    # A filter on n would be pushed below and split the text a second time; what doesn't fit is dropped by place.
    at = source.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("pos"))
    if len(widths) > 1:
        at = at.withColumn("w", F.explode(F.array(*[F.lit(w) for w in widths])))
        key = reduce(lambda rest, n: F.when(F.col("w") == n, _shingle(F.col("words"), F.col("pos"), n)).otherwise(rest), widths, F.lit(None).cast("long"))
        at = at.where(F.col("pos") + F.col("w") <= F.col("n"))
    else:
        key = _shingle(F.col("words"), F.col("pos"), widths[0])
        at = at.where(F.col("pos") + widths[0] <= F.col("n"))
    return at.select("doc_id", "text_hash", "n", "pos", key.alias("key"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items (sorted array of item ids), contaminated."""
    named = settle(_windows(benchmark, item_id, item_text, window_words), "decontaminate-items")
    # Written once, so a window keeps its number.
    windows = settle(named.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("len")), "decontaminate-windows")
    shingles = settle(_shingles(windows, shingle_words), "decontaminate-shingles")
    widths = sorted(r.w for r in shingles.select("w").distinct().collect()) or [shingle_words]  # at most shingle_words values
    known = small(settle(shingles.select(F.col("key").alias("known")).distinct(), "decontaminate-known"))

    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    source = source.withColumn("n", F.size("words"))
    found = _positions(source, widths)
    found = settle(found.join(known, found["key"] == known["known"], "left_semi"), "decontaminate-positions")

    rarity = found.groupBy("key").agg(F.count("*").alias("freq"))
    ordered = shingles.join(rarity, "key", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    prefix = ordered.groupBy("wid").agg(F.min(F.struct("freq", "key", "off", "len")).alias("p")).where("p.freq > 0").select("wid", "p.key", "p.off", "p.len")
    prefix = small(settle(prefix, "decontaminate-prefix"))

    start = F.col("pos") - F.col("off")
    spots = found.join(prefix, "key").where((start >= 0) & (start + F.col("len") <= F.col("n")))
    spots = spots.select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2"), F.struct(start.alias("start"), "len", "wid").alias("spot"))
    # A document's candidates are no more than its words and windows that begin alike: numbers, no text.
    spots = small(settle(spots.groupBy("id2", "hash2").agg(F.collect_set("spot").alias("spots")), "decontaminate-spots"))
    same = source["doc_id"].eqNullSafe(spots["id2"]) & (source["text_hash"] == spots["hash2"])
    read = source.join(spots, same).select("doc_id", "text_hash", "words", F.explode("spots").alias("spot"))
    read = read.select("doc_id", "text_hash", "spot.*", F.expr("slice(words, spot.start + 1, spot.len)").alias("got"))
    want = small(windows.select(F.col("wid").alias("wid2"), "win"))
    hits = read.join(want, (F.col("wid") == F.col("wid2")) & (F.col("got") == F.col("win")))
    hits = settle(hits.select("doc_id", "text_hash", "start", "len", "wid").distinct(), "decontaminate-hits")

    doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("doc_id", "text_hash", "start").agg(F.max("len").alias("len"))
    spans = spans.withColumn("upto", F.coalesce(F.max(F.col("start") + F.col("len")).over(doc), F.lit(0)))
    n_hit = spans.groupBy("doc_id", "text_hash").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "upto"))).cast("long").alias("n_hit"))
    whose = small(settle(named.join(windows, "win").select("wid", "item"), "decontaminate-whose"))
    listed = hits.select("doc_id", "text_hash", "wid").distinct().join(whose, "wid").select("doc_id", "text_hash", "item").distinct()
    items = listed.groupBy("doc_id", "text_hash").agg(F.count("*").cast("long").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    extra = n_hit.withColumnsRenamed({"doc_id": "id2", "text_hash": "hash2"})
    both = items.join(extra, items["doc_id"].eqNullSafe(extra["id2"]) & (items["text_hash"] == extra["hash2"])).select("id2", "hash2", "n_hit", "n_items", "items")
    both = small(settle(both, "decontaminate-documents"))

    out = source.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_words")).distinct()
    out = out.join(both, out["doc_id"].eqNullSafe(both["id2"]) & (out["text_hash"] == both["hash2"]), "left").drop("id2", "hash2")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words")))


def digest_columns(found: DataFrame) -> DataFrame:
    """One row per document with the digest of its items."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = contamination(docs.select(doc_id, text_col), benchmark, doc_id, text_col)
    bad = small(settle(found.where("contaminated").select(F.col("doc_id").alias("\x00id"), F.col("text_hash").alias("\x00hash")), "decontaminate-bad"))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["\x00id"]) & (F.xxhash64(docs[text_col]) == bad["\x00hash"]), "left_anti")
