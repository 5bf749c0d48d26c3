"""Operator 11: quality rules, by how well public tokenisers' vocabularies fit a text.

Of each text one Arrow pass counts the base rules (words, their characters, symbols, repeated lines, words in repeated windows) and
measures its fertility: characters a piece and the share of byte-fallback pieces under a vocabulary of pieces, the entropy (bits) of
the pieces it uses, and characters a token under a byte-level vocabulary. Words are tokenised one by one and remembered.

Texts are banded by language, or by script where the language is null or has too few texts, and within either by the power of two of
their number of pieces, because short texts vary more and have less entropy. A band reaches FENCE quartile ranges beyond the quartiles
of the band's texts, all of them but repeats and texts that fail the base rules; the range taken is at least what a text of that
length varies by chance, so a band of near copies doesn't close. A text with a measure outside its band is rejected.

Quartiles are read from histograms (band, measure, bin), which combine before their shuffle: no texts or documents are sorted or
gathered. Copies count once, as one row of (band, digest of the text, measures) after a distinct whose keys are texts. The bands join
their documents by broadcast where a count shows them small, else by a shuffle.

Defined cases: null and empty texts have no words, fail the base rules and have null measures; where fewer than LEAST texts share a
band in its language, its script and the whole table in turn, nothing is rejected; a null id passes through; repeated rows are judged
alike; a text of any length is read whole; an empty table gives an empty one. Columns named in ``keep`` pass through; on a clash an
added column gets a trailing underscore.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, settle, sliced, small, trimmed

#: Characters that separate words, and those that count as symbols (fixed values).
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Base rules: fewest words, words of a repeated window, and the most per cent of words that stand in repeats.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Measures: name, width of a histogram's bin, and least quartile range (of a text with n pieces: the greater of the first and second / sqrt(n)).
MEASURES = {"chars_per_piece": (0.01, 0.06, 1.1), "fallback_share": (0.001, 0.01, 0.1), "entropy": (0.01, 0.15, 2.5), "chars_per_byte_token": (0.01, 0.06, 1.1)}
#: Quartile ranges that a band reaches beyond its quartiles, and texts that a band needs.
FENCE, LEAST = 3.0, 50
#: Words remembered by a worker, the longest that is, and first letters whose script is remembered.
MEMO_WORDS, MEMO_BYTES, MEMO_LETTERS = 400_000, 64, 10_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    return repeated_numbers(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n), len(number), window)


def repeated_numbers(word: np.ndarray, base: int, window: int = WINDOW) -> int:
    """``repeated_words`` of words as numbers below ``base``, which all occur."""
    n = len(word)
    if n <= window or base == n:
        return 0
    # Windows as numbers: word by word, renumbered from 0 while the next word could overflow, so never two windows under one number.
    key, most = word, base
    for k in range(1, window):
        if most * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = len(key)
        key = key[: n - k] * base + word[k:]
        most *= base
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(n, dtype=bool)
    again = count[at] > 1
    for k in range(window):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def base_counts(raw: bytes, words: list[bytes], repeated: int | None = None) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and words in repeated windows (counted here if not given) of a UTF-8 text."""
    spaces = len(raw) - len(raw.translate(None, SPACES))
    continuing = int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) == 0x80))
    chars = len(raw) - continuing - spaces
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words) if repeated is None else repeated


def script(word: str) -> str:
    """The script of a word's first letter, as the first word of the letter's Unicode name; empty without letters."""
    letter = next((c for c in word if c.isalpha()), "")
    return unicodedata.name(letter, "").split(" ")[0] if letter else ""


class Vocabularies:
    """Both tokenisers, and what they made of the words seen.

    A word is remembered as a number; its pieces, its byte-level tokens' number and its script stand in flat arrays, so a text is measured
    by lookups of its distinct words.
    """

    def __init__(self, pieces_path: str, ranks_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.names = {"": 0}
        self.letters: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        # Numbers of words; where their pieces end, the pieces, numbers of byte-level tokens, scripts.
        self.memo: dict[bytes, int] = {}
        self.ends, self.flat, self.tokens, self.scripts = array("q", [0]), array("i"), array("i"), array("i")
        self.long: list[bytes] = []

    def _script(self, word: str) -> int:
        first = word[:1]
        found = self.letters.get(first)
        if found is None:
            found = self.names.setdefault(script(word), len(self.names))
            if first.isalpha() and len(self.letters) < MEMO_LETTERS:
                self.letters[first] = found
        return found

    def known(self, words: set[bytes]) -> dict[bytes, int]:
        """Numbers of at least these words; a word begins with a space, as in running text."""
        if self.long:  # the last ones
            for word in self.long:
                del self.memo[word]
            n = len(self.memo)
            del self.flat[self.ends[n] :], self.ends[n + 1 :], self.tokens[n:], self.scripts[n:]
            self.long = []
        new = words.difference(self.memo)
        if new:
            if self.memo and len(self.memo) + len(new) > MEMO_WORDS:
                self._forget()
                new = words
            self.long = [w for w in new if len(w) > MEMO_BYTES]
            new = [w for w in new if len(w) <= MEMO_BYTES] + self.long
            texts = [w.decode("utf-8", "replace") for w in new]
            flat, ends, tokens, scripts, encode = self.flat, self.ends, self.tokens, self.scripts, self.bytes.encode_ordinary
            for ids in self.pieces.encode(texts, num_threads=1):
                flat.extend(ids)
                ends.append(len(flat))
            tokens.extend([len(encode(" " + t)) for t in texts])
            scripts.extend(map(self._script, texts))
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        return self.memo

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a text's distinct words; for each word its place among those; how often each occurs."""
        known = self.known(set(words))
        return np.unique(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)), return_inverse=True, return_counts=True)

    def measures(self, words: list[bytes], chars: int, numbered: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple:
        """Number of pieces, the four measures and the commonest script; nulls without words."""
        if not words:
            return 0, None, None, None, None, None
        distinct, _, often = numbered or self.numbered(words)
        ends = np.frombuffer(self.ends, dtype=np.int64)
        start, size = ends[distinct], ends[distinct + 1] - ends[distinct]
        before = np.cumsum(size) - size
        pieces = np.frombuffer(self.flat, dtype=np.int32)[np.repeat(start - before, size) + np.arange(int(size.sum()))]
        found, at = np.unique(pieces, return_inverse=True)
        count = np.bincount(at, np.repeat(often, size), len(found))
        n, tokens = int(count.sum()), int(np.frombuffer(self.tokens, dtype=np.int32)[distinct] @ often)
        scripts = np.bincount(np.frombuffer(self.scripts, dtype=np.int32)[distinct], often, len(self.names))
        scripts[0] = 0
        commonest = min(s for s, k in self.names.items() if scripts[k] == scripts.max()) if scripts.any() else ""
        share = count / max(n, 1)
        entropy = float(-(share * np.log2(share)).sum()) + 0.0
        return n, chars / max(n, 1), int(count[self.fallback[found]].sum()) / max(n, 1), entropy, chars / max(tokens, 1), commonest


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, pieces_path: str, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the base counts, ``n_pieces``, the measures and ``script``."""
    keep = list(df.columns) if keep is None else keep
    kinds = [*[(c, T.LongType()) for c in (*COUNTS, "n_pieces")], *[(m, T.DoubleType()) for m in MEASURES], ("script", T.StringType())]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(free_name(df, c, keep), t) for c, t in kinds]])
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("\x00text"))
    width = len(keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        vocabularies = Vocabularies(pieces_path, ranks_path, pattern)
        for whole in batches:
            for batch in sliced(whole, width):
                rows = []
                for raw in batch.column(width).cast(pa.binary()).to_pylist():
                    words = raw.split()
                    numbered = vocabularies.numbered(words)
                    base = base_counts(raw, words, repeated_numbers(numbered[1], len(numbered[0])))
                    rows.append((*base, *vocabularies.measures(words, base[1], numbered)))
                arrays = [batch.column(i) for i in range(width)]
                arrays += [pa.array([r[k] for r in rows], type=out_schema.field(width + k).type) for k in range(len(kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)

    return bounded_batches(source).mapInArrow(trimmed(run), schema)


def base_failed() -> Column:
    """Whether the base rules reject a measured text."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def size_class() -> Column:
    """The power of two of a text's number of pieces."""
    return F.floor(F.log2(F.greatest(F.col("n_pieces"), F.lit(1)).cast("double")) + 1e-9).cast("int")


def bands(measured: DataFrame, fence: float = FENCE, least: int = LEAST) -> DataFrame:
    """(lang, script, size_class, n_band and low_m, high_m for each measure m) for all that occur together in ``measured``; bounds are null where no
    level has ``least`` texts. ``measured`` has lang, script, size_class, digest, the measures and base_failed."""
    texts = measured.where(~F.col("base_failed")).select("lang", "script", "size_class", "digest", *MEASURES).distinct()
    # One row a measure and level, counted in bins: languages, scripts and the whole table are keys of one aggregation.
    levels = F.array(F.concat(F.lit("lang "), F.col("lang")), F.concat(F.lit("script "), F.col("script")), F.lit("all"))
    binned = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / width).cast("long").alias("bin")) for m, (width, _, _) in MEASURES.items()])
    counted = texts.groupBy("lang", "script", "size_class", binned.alias("bins")).count()
    long = counted.select("size_class", F.explode(levels).alias("level"), "bins", "count").where("level IS NOT NULL").select("size_class", "level", F.explode("bins").alias("b"), "count")
    histogram = long.groupBy("level", "size_class", "b.measure", "b.bin").agg(F.sum("count").alias("n"))
    band = Window.partitionBy("level", "size_class", "measure")
    upto = histogram.withColumn("upto", F.sum("n").over(band.orderBy("bin"))).withColumn("total", F.sum("n").over(band)).where(F.col("total") >= least)
    quartiles = upto.groupBy("level", "size_class", "measure").agg(F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q3"), F.max("total").alias("n"))

    def chosen(values: list[float]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in zip(MEASURES, values, strict=True) for x in pair]), F.col("measure"))

    width, floor_, by_size = (chosen([v[k] for v in MEASURES.values()]) for k in range(3))
    spread = F.greatest((F.col("q3") - F.col("q1")) * width, floor_, by_size / F.sqrt(F.pow(F.lit(2.0), F.col("size_class"))))
    limits = quartiles.select("level", "size_class", "measure", "n", (F.col("q1") * width - fence * spread).alias("low"), ((F.col("q3") + 1) * width + fence * spread).alias("high"))
    at = {m: [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for c in ("low", "high")] for m in MEASURES}
    wide = limits.groupBy("level", "size_class").agg(F.max("n").alias("n_band"), *[c for pair in at.values() for c in pair])
    bounds = ["n_band", *[f"{c}_{m}" for m in MEASURES for c in ("low", "high")]]
    # Each (language, script, class) takes the first of its levels that has a band.
    kinds = measured.select("lang", "script", "size_class").distinct()
    asked = kinds.select("*", F.posexplode(levels).alias("rank", "level")).where("level IS NOT NULL").join(wide, ["level", "size_class"])
    first = asked.groupBy("lang", "script", "size_class").agg(F.min(F.struct("rank", *bounds)).alias("f"))
    return first.select("lang", "script", "size_class", *[F.col(f"f.{b}").alias(b) for b in bounds])


def judge(
    df: DataFrame, pieces_path: str, ranks_path: str, pattern: str, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, fence: float = FENCE, least: int = LEAST
) -> DataFrame:
    """Columns of ``keep`` (all but the text), the base counts and measures, base_failed, rejected_by (measures outside their bands) and kept."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    # Names of its own inside, so that any columns can pass through.
    inner = df.select(*[F.col(f"`{c}`").alias(f"\x00{k}") for k, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"), F.nullif(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.xxhash64(f"`{text_col}`").alias("digest"))
    measured = measure(inner, pieces_path, ranks_path, pattern, keep=[c for c in inner.columns if c != "text"])
    measured = settle(measured.withColumn("base_failed", base_failed()).withColumn("size_class", size_class()).withColumn("script", F.nullif("script", F.lit(""))), "fertility")
    fences = settle(bands(measured, fence, least), "fertility-bands")
    names = {c: f"b_{c}" for c in ("lang", "script", "size_class")}
    right = small(fences).withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(b)) for c, b in names.items()]
    joined = measured.join(right, same[0] & same[1] & same[2], "left")
    outside = [F.when((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(m)) for m in MEASURES]
    rejected = F.array_compact(F.array(*outside))
    added = {**{c: F.col(c) for c in (*COUNTS, "n_pieces", *MEASURES, "script", "base_failed")}, "rejected_by": rejected, "kept": ~F.col("base_failed") & (F.size(rejected) == 0)}
    return joined.select(*[F.col(f"\x00{k}").alias(c) for k, c in enumerate(keep)], *[v.alias(free_name(df, c, keep)) for c, v in added.items()])


def digest_columns(judged: DataFrame) -> DataFrame:
    """The query's columns."""
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "n_pieces", *[F.round(m, 6).alias(m) for m in MEASURES], F.array_join("rejected_by", ",").alias("rejected_by"))
