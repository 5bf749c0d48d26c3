"""Operator 4 (native): chat formatting in budgeted windows.

A conversation's turns get prefix sums of their tokens. The sums cut it into segments of SEGMENT budgets (a segment holds the turns
whose sum ends within its stretch), and each segment is filled greedily: a window takes whole turns up to the budget. Every
window repeats the leading system turn; one that isn't its segment's first also repeats up to ``history`` turns before its
first new one, within a quarter of the budget and as far as its first new turn leaves room. What is repeated carries no
loss, so each assistant text is a target once. No window is over the budget, but for a turn that doesn't fit beside the
system turn: it stands alone with it.

Sums are made in two levels: rows are dealt by ranges of (conversation, turn), summed within each range, and a conversation
that goes over several ranges gets the sums of the earlier ones added (at most one such row a range). So one conversation may
hold most rows: it is sorted by many tasks, and what one row gathers is a segment, not a conversation.

Template: ``<turn:ROLE>TEXT</turn>`` and a newline. Inside roles and texts ``\\`` is written ``\\b``, ``<`` is ``\\l`` and
``>`` is ``\\g``; no control string can occur in an escaped text, and undoing the three in reverse order restores it.

Defined cases: null texts and roles are empty; turns that tie are ordered by role, then text; repeated rows are turns of
their own; a null conversation id is a conversation; a null turn number comes first; empty tables give no windows; other
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BUDGET, HISTORY = 512, 2
#: Budgets of one segment: what is gathered in one row.
SEGMENT = 32
#: Tokens that a turn's marks count for.
MARK_TOKENS = 4
OPEN, SHUT = "<turn:", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    """The text with control characters written as escapes."""
    for raw, code in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    for raw, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def token_estimate(text: Column) -> Column:
    """Tokens of a text for the budget: one for each four characters begun."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def _summed(rows: DataFrame) -> DataFrame:
    """``rows`` with pos (from 1), upto (the running sum of cost) and the conversation's leading system turn (sys, sys_cost)."""
    dealt = settle(rows.repartitionByRange("conv_id", "turn", "role", "body").withColumn("range", F.spark_partition_id()), "chat-ranges")
    order = Window.partitionBy("range", "conv_id").orderBy("turn", "role", "body")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({"pos": F.row_number().over(order), "upto": F.sum("cost").over(running)})
    lead = F.struct("role", "body", "cost")
    local = local.withColumn("lead", F.first(lead).over(running))
    # Conversations of several ranges: at most one for each range but the last.
    ends = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.min(F.struct("turn", "role", "body", "cost")).alias("least"))
    wide = dealt.groupBy("conv_id").agg(F.countDistinct("range").alias("k")).where("k > 1").select(F.col("conv_id").alias("wide"))
    ends = ends.join(F.broadcast(wide), F.col("conv_id").eqNullSafe(F.col("wide"))).drop("wide")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.select(
        F.col("conv_id").alias("wide"), F.col("range").alias("in_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.first("least").over(whole).alias("lead0")
    )
    joined = local.join(F.broadcast(ends), F.col("conv_id").eqNullSafe(F.col("wide")) & (F.col("range") == F.col("in_range")), "left")
    first = F.when(F.col("lead0").isNotNull(), F.struct(F.col("lead0.role").alias("role"), F.col("lead0.body").alias("body"), F.col("lead0.cost").alias("cost"))).otherwise(F.col("lead"))
    joined = joined.select("conv_id", "role", "body", "cost", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), (F.col("upto") + F.coalesce("c0", F.lit(0))).alias("upto"), first.alias("lead"))
    led = F.col("lead.role") == "system"
    return joined.select("conv_id", "role", "body", "cost", "pos", "upto", F.when(led, F.col("lead.body")).alias("sys"), F.when(led, F.col("lead.cost")).otherwise(0).alias("sys_cost"))


def _filled(costs: Column, room: Column, history: int) -> Column:
    """Windows of a segment, array of (no, first, last, again): whole turns greedily, places from 1; ``again`` turns before the first are repeated."""
    cost = lambda i: F.get(costs, i - 1)

    def repeated(i):
        """How many turns before place i are repeated, and their cost."""
        out = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("cost"))
        total, fits = F.lit(0).cast("long"), F.lit(True)
        for k in range(1, history + 1):
            total = total + F.coalesce(cost(i - k), F.lit(0).cast("long"))
            fits = fits & (i - k >= 1) & (cost(i - k) > 0) & (4 * total <= room) & (total + cost(i) <= room)
            out = F.when(fits, F.struct(F.lit(k).alias("n"), total.alias("cost"))).otherwise(out)
        return out

    def step(acc, i):
        more = (acc["used"] + cost(i) <= room) | (acc["used"] == 0)
        old = F.struct((acc["used"] + cost(i)).alias("used"), acc["starts"].alias("starts"))
        front = repeated(i)
        new = F.struct((front["cost"] + cost(i)).alias("used"), F.array_append(acc["starts"], F.struct(i.alias("first"), front["n"].alias("again"))).alias("starts"))
        return F.when(more, old).otherwise(new)

    none = F.array(F.struct(F.lit(1).alias("first"), F.lit(0).alias("again")))
    starts = F.aggregate(F.sequence(F.lit(1), F.size(costs)), F.struct(F.lit(0).cast("long").alias("used"), none.alias("starts")), step, lambda acc: acc["starts"])
    return F.transform(starts, lambda w, k: F.struct(k.alias("no"), w["first"].alias("first"), (F.coalesce(F.get(starts, k + 1)["first"], F.size(costs) + 1) - 1).alias("last"), w["again"].alias("again")))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant", tokens: str | None = None) -> DataFrame:
    """One row per window: conv_id, window_no (ascending, with gaps between segments), text, n_turns, n_repeated (turns at its front that an
    earlier window has), loss (array of start, end in code points of ``text``), n_tokens. ``tokens``: a column of token counts (an
    estimate from the text's length without it)."""
    count = token_estimate(F.coalesce(F.col(text), F.lit(""))) if tokens is None else F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("body"), (count + MARK_TOKENS).alias("cost"))
    rows = _summed(rows).withColumn("segment", F.floor((F.col("upto") - 1) / (SEGMENT * budget)).cast("long"))
    packed = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "body", "cost"))).alias("parts"), F.first("sys").alias("sys"), F.first("sys_cost").alias("sys_cost"))
    # The system turn at its own place costs nothing here: every window's room is what it leaves.
    packed = packed.withColumn("costs", F.transform("parts", lambda p: F.when((p["pos"] == 1) & F.col("sys").isNotNull(), F.lit(0).cast("long")).otherwise(p["cost"])))
    filled = packed.withColumn("w", F.explode(_filled(F.col("costs"), F.lit(budget) - F.col("sys_cost"), history)))
    taken = F.slice("parts", F.col("w.first") - F.col("w.again"), F.col("w.last") - F.col("w.first") + F.col("w.again") + 1)
    taken = F.transform(taken, lambda p, k: F.struct((k < F.col("w.again")).alias("again"), p["role"].alias("role"), p["body"].alias("body"), p["cost"].alias("cost")))
    lead = F.when((F.get("parts", F.col("w.first") - 1)["pos"] > 1) & F.col("sys").isNotNull(), F.array(F.struct(F.lit(True).alias("again"), F.lit("system").alias("role"), F.col("sys").alias("body"), F.col("sys_cost").alias("cost"))))
    packed = filled.select("conv_id", (F.shiftleft("segment", 20) + F.col("w.no")).alias("window_no"), F.concat(F.coalesce(lead, F.slice(taken, 1, 0)), taken).alias("parts"))
    written = F.transform("parts", lambda p: F.struct(p["again"].alias("again"), (p["role"] == target_role).alias("target"), F.concat(F.lit(OPEN), escaped(p["role"]), F.lit(">")).alias("open"), escaped(p["body"]).alias("body")))
    packed = packed.withColumn("written", written)
    spans = F.aggregate(
        "written",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["open"]) + F.char_length(t["body"]) + len(SHUT)).alias("at"),
            F.when(t["target"] & ~t["again"], F.array_append(acc["loss"], F.struct((acc["at"] + F.char_length(t["open"])).alias("start"), (acc["at"] + F.char_length(t["open"]) + F.char_length(t["body"])).alias("end")))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return packed.select(
        "conv_id",
        "window_no",
        F.array_join(F.transform("written", lambda t: F.concat(t["open"], t["body"], F.lit(SHUT))), "").alias("text"),
        F.size("parts").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["again"])).alias("n_repeated"),
        spans.alias("loss"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["cost"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The turns that formatted windows hold, each once: conv_id, window_no, turns (array of role, text), targets (array of texts under the loss mask)."""
    pieces = F.split("text", SHUT)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    turns = F.transform(new, lambda p: F.struct(unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ">", 1)).alias("role"), unescaped(F.substr(p, F.instr(p, ">") + 1)).alias("text")))
    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window_no", turns.alias("turns"), targets.alias("targets"), F.char_length("text").alias("chars"))


def digest_columns(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    per = read_back(windows).select(
        "conv_id",
        F.size("turns").alias("n"),
        "chars",
        F.struct(
            "window_no",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            F.array_join("targets", "").alias("learnt"),
        ).alias("w"),
    )
    whole = per.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    whole = whole.withColumns({"said": F.array_join(F.transform("ws", lambda w: w["said"]), ""), "learnt": F.array_join(F.transform("ws", lambda w: w["learnt"]), "")})
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
