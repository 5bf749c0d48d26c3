"""Tone changes on a stream: each scheduled document's score less that of the scheduled one before it.

The state of a key (a document type, say) is the last scheduled score that was published, the latest date seen, and the documents
that wait. A document waits until the key's watermark, its latest date less ``delay``, has reached its date, so that documents of that
stretch may come in any order; then all that wait up to there are published in order of (date, id). State is therefore bounded by what
a key's documents of one ``delay`` hold, whatever the stream's length. Only ids, dates and scores go through it; documents that are
not scheduled need none and pass at once.

A rule for what comes too late: a document that belongs before one already published, or has no date, is published at once without a
change and marked ``late``; changes already published stand. Nothing is dropped. A row with a null id only moves its key's watermark,
which publishes what still waits when a source ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def publish(state: tuple, rows: list[tuple], delay: int) -> tuple[tuple, list[tuple]]:
    """(new state, published) of one key. State: (latest, last date, last id, last score, waiting dates, ids, scores); ``rows``: (date, id,
    score), dates in microseconds. Published: (id, date, score, change, late)."""
    latest, last_at, last_id, last_score, *waiting = state
    wait, out = list(zip(*waiting, strict=True)), []
    for at, name, score in rows:
        if at is not None:
            latest = at if latest is None else max(latest, at)
        if name is None:
            continue
        if at is None or (last_at is not None and (at, name) <= (last_at, last_id)):
            out.append((name, at, score, None, True))
        else:
            wait.append((at, name, score))
    wait.sort(key=lambda row: row[:2])
    done = 0
    for at, name, score in wait:
        if at > latest - delay:
            break
        first = last_at is None
        change = None if first or score is None or last_score is None else score - last_score
        out.append((name, at, score, change, False))
        last_at, last_id, last_score = at, name, score
        done += 1
    left = wait[done:]
    return (latest, last_at, last_id, last_score, *([row[k] for row in left] for k in range(3))), out


def change_stream(
    scored: DataFrame, part_by: list[str], delay: str = "30 days", id_col: str = "doc_id", date_col: str = "release_date", flag_col: str = "scheduled", score_col: str = "score"
) -> DataFrame:
    """(part_by, id, date, flag, score, tone_change, late) of a stream of scored documents, appended as they are published."""
    kinds = {c: scored.schema[c].dataType for c in (*part_by, id_col, date_col)}
    micros = int(pd.Timedelta(delay).total_seconds() * 1_000_000)
    flag = F.coalesce(F.col(flag_col), F.lit(False))
    asked = scored.where(flag | F.col(id_col).isNull()).select(*part_by, F.col(id_col).alias("id"), F.unix_micros(F.col(date_col).cast("timestamp")).alias("at"), F.col(score_col).cast("double").alias("score"))
    published = T.StructType([*[T.StructField(c, kinds[c]) for c in part_by], T.StructField("id", kinds[id_col]), T.StructField("at", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("tone_change", T.DoubleType()), T.StructField("late", T.BooleanType())])
    kept = T.StructType([
        T.StructField("latest", T.LongType()), T.StructField("last_at", T.LongType()), T.StructField("last_id", kinds[id_col]), T.StructField("last_score", T.DoubleType()),
        T.StructField("ats", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(kinds[id_col])), T.StructField("scores", T.ArrayType(T.DoubleType())),
    ])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plain = lambda column, part: [None if pd.isna(v) else v for v in part[column].astype(object)]
        rows = [(None if at is None else int(at), name, score) for part in parts for at, name, score in zip(plain("at", part), plain("id", part), plain("score", part), strict=True)]
        new, out = publish(state.get if state.exists else (None, None, None, None, [], [], []), rows, micros)
        state.update(new)
        made = pd.DataFrame(out, columns=["id", "at", "score", "tone_change", "late"], dtype=object)
        for place, column in enumerate(part_by):
            made.insert(place, column, pd.Series([key[place]] * len(out), dtype=object))
        yield made

    changes = asked.groupBy(*part_by).applyInPandasWithState(step, published, kept, "append", GroupStateTimeout.NoTimeout)
    date = F.timestamp_micros("at").cast(kinds[date_col])
    changes = changes.select(*part_by, F.col("id").alias(id_col), date.alias(date_col), F.lit(True).alias(flag_col), F.col("score").alias(score_col), "tone_change", "late")
    others = scored.where(~flag & F.col(id_col).isNotNull()).select(*part_by, id_col, date_col, flag_col, F.col(score_col).cast("double").alias(score_col), F.lit(None).cast("double").alias("tone_change"), F.lit(False).alias("late"))
    return changes.unionByName(others)
