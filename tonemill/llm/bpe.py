"""Operator 2: byte-level BPE encoding and decoding.

Bytes are mapped one to one to Latin-1 characters so that a string automaton (pyahocorasick) can hold a byte
vocabulary. For each piece of the split pattern the automaton, built over the reversed tokens and run over the
reversed piece, gives in one pass the longest token that starts at each position. The encoder goes left to
right with the longest token, and steps back to shorter ones whenever the token can't stand beside its left
neighbour: two tokens are compatible if undoing their merges never shows a pair that would have been merged
earlier. That answer is memoised for each pair, each position is given up at most once, and the outcome equals
the merge loop's exactly, in time linear in the piece.

Defined cases: null and empty texts encode to no tokens; repeated rows are encoded alike; a very long piece
stays linear; other columns pass through, and on a clash the added column gets a trailing underscore
(``free_name``). Decoding ids outside the vocabulary raises.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_text, trimmed

#: Pieces in one of a worker's two generations of memory, and the longest piece that is remembered.
MEMO_PIECES, MEMO_LENGTH = 150_000, 64


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file with a base64 token and its rank on each line."""
    found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in open(path, "rb") if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


#: Pairs of tokens whose compatibility is remembered.
FITS = 150_000

# Code points that the regex package (newer Unicode tables) counts as letters or digits and
# tiktoken's splitter doesn't; there they are symbols.
NEWER_LETTERS_AND_DIGITS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def newer_class() -> str:
    """The code points above, first and last of each run, as a character class."""
    return "[" + "".join(f"{chr(first)}-{chr(last)}" for first, last in NEWER_LETTERS_AND_DIGITS) + "]"


class ByteBPE:
    """Encoder and decoder of one vocabulary (token bytes by rank)."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        names = [t.decode("latin-1") for t in tokens]
        self.rank = {name: i for i, name in enumerate(names)}
        self.size = [len(t) for t in tokens]
        self.parts: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.shorter = [self._longest_proper_prefix(name) for name in names]
        usable = []
        for i, name in enumerate(names):
            self.parts.append((i, i))
            if len(name) == 1 or self._find_merge(i, name):
                usable.append(i)
        self._fits.clear()
        fine = set(usable)
        for i in range(len(names)):  # a token that no merge makes is never met inside a piece
            while self.shorter[i] >= 0 and self.shorter[i] not in fine:
                self.shorter[i] = self.shorter[self.shorter[i]]
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(names[i][::-1], i)
        self.automaton.make_automaton()

    def _longest_proper_prefix(self, name: str) -> int:
        for end in range(len(name) - 1, 0, -1):
            if (found := self.rank.get(name[:end], -1)) >= 0:
                return found
        return -1

    def _find_merge(self, token: int, name: str) -> bool:
        """Record the two tokens whose merge makes ``token``; False if none does."""
        left = self.shorter[token]
        while left >= 0:
            right = self.rank.get(name[self.size[left]:], -1)
            if 0 <= right < token and left < token and self.fits(left, right):
                self.joined[left, right] = token
                self.parts[token] = (left, right)
                return True
            left = self.shorter[left]
        return False

    def fits(self, left: int, right: int) -> bool:
        """Whether the merge loop can leave these two tokens side by side."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= FITS:
                self._fits.clear()
            known = self._fits[left, right] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # Undo the later of the two merges, step by step; ``bound`` is the merge that has just been undone: a
        # pair that joins before it would have been taken by the merge loop instead.
        bound, joined, parts = len(self.tokens), self.joined, self.parts
        while True:
            both = joined.get((left, right))
            if both is not None and both < bound:
                return False
            if left > right:
                bound, inner = left, parts[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, parts[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, parts[left][1]
                if inner == left:
                    return True
                left = inner

    def encode_piece(self, piece: str) -> list[int]:
        """Ranks of one piece, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or self.size[token] > self.size[longest[at]]:
                longest[at] = token
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        size, shorter, fits = self.size, self.shorter, self.fits
        while at < n:
            while token >= 0:
                if open_at[at + size[token]] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            elif out:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
            else:
                raise ValueError("the vocabulary lacks single bytes of this text")
        return out

    def decode(self, ids) -> bytes:
        """The bytes of a sequence of ranks."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    """The coder of a rank file, built once in each process."""
    return ByteBPE(load_ranks(path))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    import sys

    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class TextCoder:
    """Encodes whole texts: splits by the pattern, encodes each piece, remembers common pieces (bounded)."""

    def __init__(self, bpe: ByteBPE, pattern: str):
        import regex

        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.newer = regex.compile(newer_class())

    def split(self, text: str) -> list[str]:
        """The pattern's matches, with tiktoken's view of which characters are letters and digits."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                plain = self.newer.sub("\ue000", text)  # a private-use character: a symbol for both
                return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        return self.pattern.findall(text)

    def _piece(self, piece: str) -> bytes:
        ids = self.memo.get(piece) or self.older.get(piece)
        if ids is None:
            ids = packed(self.bpe.encode_piece(piece.encode("utf-8").decode("latin-1")))
        if len(piece) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_PIECES:  # what was met since the last turn stays within reach
                self.memo, self.older = {}, self.memo
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text; null counts as empty."""
        pieces = self.split(text or "")
        out = list(map(self.memo.get, pieces))
        if None in out:
            make = self._piece
            out = [make(p) if ids is None else ids for p, ids in zip(pieces, out)]
        return b"".join(out)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids_col`` (binary: ids as little-endian unsigned 32-bit integers) and, if named, ``decoded_col`` (binary: the bytes decoded from those ids)."""
    ids_col = free_name(df, ids_col, keep)
    added = {ids_col: T.BinaryType()}
    if decoded_col:
        added[free_name(df, decoded_col, keep)] = T.BinaryType()

    def make():
        bpe = codec(ranks_path)
        coder = TextCoder(bpe, pattern)

        def work(texts):
            ids = [coder.encode(t) for t in texts]
            return [ids, [bpe.decode(array("I", x)) for x in ids]] if decoded_col else [ids]

        return work

    return map_text(df, text_col, added, make, keep)


def bpe_decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col`` (binary): the bytes of the packed ids in ``ids_col``; null ids decode to null."""
    out_col = free_name(df, out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])
    at, names = df.columns.index(ids_col), [*df.columns, out_col]

    def run(batches):
        bpe = codec(ranks_path)
        for batch in batches:
            decoded = [None if x is None else bpe.decode(array("I", x)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, type=pa.binary())], names=names)

    return df.mapInArrow(trimmed(run), schema)


def digest_columns(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", text_id: str = "doc_id") -> DataFrame:
    """The digests of an encoded table: one row per document."""
    return df.select(
        text_id,
        (F.octet_length(ids_col) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids_col, 256).alias("ids_sha256"),
        F.sha2(decoded_col, 256).alias("decoded_sha256"),
    )
