"""Operator 12: fill-in-the-middle transformation by a table-driven byte automaton.

One table holds the transitions of a deterministic automaton over bytes: where a UTF-8 character begins, where a unit (a line with its
end) begins, and where a sentinel ends. Its states are the products of three small machines: bytes that the present character still
owes, whether the last unit is closed, and the longest sentinel prefix just read; bytes that all states treat alike share a column. A
state depends on the last few bytes only (``reach``: the longest sentinel, or a character's continuation bytes), so all bytes of a
stretch are stepped at once: ``reach`` look-ups bring each byte's state up, one more gives its transition. Transitions are counted by
document (units, characters, sentinels). Once the cuts are drawn, a second pass over the marked transitions finds their bytes.

Cuts, form and order of the parts come from ``sha2`` of the id, as columns, so a lost executor's rows come out the same again.

Defined cases: a null text is an empty one, an empty text and one that holds a sentinel stay plain; a null id counts as an empty
string; repeated rows are transformed alike; a text of any length is read whole (a byte of marks for each of its bytes, in stretches
of STRETCH bytes); an empty table gives an empty one. Other columns pass through; on a clash an added column gets a trailing underscore.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, sliced, trimmed

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What a transition can mark.
CHARACTER, UNIT, SENTINEL = 1, 2, 4
#: Bytes stepped at once.
STRETCH = 1 << 20


class ByteAutomaton:
    """The transition table for a set of sentinels and the byte that ends a unit."""

    def __init__(self, sentinels: tuple[bytes, ...], unit_end: int = 10):
        prefixes = sorted({s[:k] for s in sentinels for k in range(len(s) + 1)}, key=lambda p: (len(p), p))

        def longest(read: bytes) -> bytes:
            """The longest sentinel prefix that ends what was read."""
            return next(read[k:] for k in range(len(read) + 1) if read[k:] in prefixes)

        # A state: bytes owed by the present character, whether the last unit is closed, sentinel prefix read.
        start = (0, True, b"")
        numbers, rows, marks = {start: 0}, [], []
        for owed, closed, read in (queue := [start]):  # grows while it is read
            row, mark = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.uint8)
            for byte in range(256):
                goes_on = 0x80 <= byte < 0xC0
                now = longest(read + bytes([byte]))
                due = max(owed - 1, 0) if goes_on else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                state = (due, byte == unit_end, now)
                if state not in numbers:
                    numbers[state] = len(queue)
                    queue.append(state)
                row[byte] = numbers[state]
                # A continuation byte that nothing owes counts as a character, so broken text still has counts.
                mark[byte] = CHARACTER * (not goes_on or owed == 0) | UNIT * closed | SENTINEL * any(now.endswith(s) for s in sentinels)
            rows.append(row)
            marks.append(mark)
        table, table_marks = np.array(rows), np.array(marks)
        # Bytes with equal columns share one; a document's first byte has a column of its own that starts anew from any state.
        columns, self.column_of = np.unique(np.vstack([table, table_marks]), axis=1, return_inverse=True)
        n = self.columns = columns.shape[1]
        step, mark = columns[: len(rows)], columns[len(rows) :]
        self.step = np.hstack([step, np.broadcast_to(step[0], step.shape)]).astype(np.uint16).ravel()
        self.mark = np.hstack([mark, np.broadcast_to(mark[0], mark.shape)]).astype(np.uint8).ravel()
        self.column_of = self.column_of.ravel().astype(np.uint8 if 2 * n <= 256 else np.uint16)
        self.width = 2 * n
        self.reach = max(3, *(len(s) for s in sentinels))

    def marks(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the transition at each byte marks; ``starts``: where a document's first byte stands (ascending)."""
        out = np.empty(len(data), dtype=np.uint8)
        for at in range(0, len(data), STRETCH):
            lead = max(at - self.reach, 0)
            columns = self.column_of[data[lead : at + STRETCH]].astype(np.int32)
            first = starts[np.searchsorted(starts, lead) : np.searchsorted(starts, at + STRETCH)] - lead
            columns[first] += self.columns
            state = np.zeros(len(columns), dtype=np.int32)
            for back in range(self.reach, 0, -1):
                state[back:] = self.step[state[back:] * self.width + columns[: len(columns) - back]]
            out[at : at + STRETCH] = self.mark[state * self.width + columns][at - lead :]
        return out


def unit_begin(marks: np.ndarray, k: int) -> int:
    """Where unit ``k`` of a text begins (from 0); the text's end if there are no more."""
    for at in range(0, len(marks), STRETCH):
        here = np.flatnonzero(marks[at : at + STRETCH] & UNIT)
        if k < len(here):
            return at + int(here[k])
        k -= len(here)
    return len(marks)


@lru_cache(maxsize=4)
def automaton(sentinels: tuple[str, ...]) -> ByteAutomaton:
    """The automaton of some sentinels, built once in each process."""
    return ByteAutomaton(tuple(s.encode() for s in sentinels))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuse sentinels that could be read in two ways where parts meet: an end of one that begins another."""
    a = [s.encode() for s in sentinels]
    if len(set(a)) != 3 or not all(a):
        raise ValueError("three different sentinels are needed")
    if any(x[-k:] == y[:k] for x in a for y in a for k in range(1, min(len(x), len(y)) + (x != y))) or any(x != y and x in y for x in a for y in a):
        raise ValueError("no sentinel may end as another begins, or stand in another")


def draws(id_col: Column, seed: int | str) -> list[Column]:
    """Four numbers below 2^32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int | str = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None
) -> DataFrame:
    """Add ``fim_text``, ``fim_form`` (plain, psm, spm), ``n_units``, ``prefix_chars`` and ``middle_chars`` (null where plain).

    ``rate``: per cent of texts that are transformed; ``spm_rate``: per cent of those that have the suffix first.
    """
    check_sentinels(sentinels)
    keep = list(df.columns) if keep is None else keep
    added = [("fim_text", T.StringType()), ("fim_form", T.StringType()), ("n_units", T.LongType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(free_name(df, c, keep), t) for c, t in added]])
    h = draws(F.col(f"`{id_col}`"), seed)
    drawn = [h[0], h[1], h[2] % 100 < rate, h[3] % 100 < spm_rate]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("\x00text"), *[c.alias(f"\x00{k}") for k, c in enumerate(drawn)])
    width = len(keep)
    mark_p, mark_s, mark_m = (s.encode() for s in sentinels)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        machine = automaton(sentinels)
        for whole in batches:
            for batch in sliced(whole, width):
                texts = batch.column(width)
                wide = pa.types.is_large_string(texts.type)
                offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                marks = machine.marks(data, np.unique(offsets[:-1][offsets[1:] > offsets[:-1]]))
                raw, rows = data.tobytes(), ([], [], [], [], [])
                for row, (h1, h2, some, spm) in enumerate(zip(*(batch.column(width + 1 + k).to_pylist() for k in range(4)), strict=True)):
                    a, b = int(offsets[row]), int(offsets[row + 1])
                    own = marks[a:b]
                    units = int(np.count_nonzero(own & UNIT))
                    if a == b or not some or (own & SENTINEL).any():
                        made = raw[a:b], "plain", units, None, None
                    else:  # the second pass: bytes of the cuts, and characters between them
                        cut, end = sorted((unit_begin(own, h1 % (units + 1)), unit_begin(own, h2 % (units + 1))))
                        prefix, middle, suffix = raw[a : a + cut], raw[a + cut : a + end], raw[a + end : b]
                        text = b"".join((mark_s, suffix, mark_p, prefix, mark_m, middle) if spm else (mark_p, prefix, mark_s, suffix, mark_m, middle))
                        made = text, "spm" if spm else "psm", units, int(np.count_nonzero(own[:cut] & CHARACTER)), int(np.count_nonzero(own[cut:end] & CHARACTER))
                    for column, value in zip(rows, made, strict=True):
                        column.append(value)
                arrays = [batch.column(i) for i in range(width)]
                arrays.append(pa.array(rows[0], type=pa.binary()).cast(out_schema.field(width).type, safe=False))
                arrays += [pa.array(values, type=out_schema.field(width + 1 + k).type) for k, values in enumerate(rows[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)

    return bounded_batches(source).mapInArrow(trimmed(run), schema)


def restore(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was transformed, from the output and its form alone (a column expression)."""
    check_sentinels(sentinels)
    p, s, m = sentinels
    middle = F.substring_index(text, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        outer = F.substring_index(text, m, 1)
        return F.substring_index(F.substring_index(outer, first, -1), second, 1), F.substring_index(outer, second, -1)

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], middle, psm[1])).when(form == "spm", F.concat(spm[1], middle, spm[0])).otherwise(text)


def digest_columns(done: DataFrame) -> DataFrame:
    """The query's columns, from the transformed texts."""
    back = restore(F.col("fim_text"), F.col("fim_form"))
    return done.select("doc_id", F.col("n_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
