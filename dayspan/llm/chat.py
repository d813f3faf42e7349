r"""Chat texts in windows of a token budget, with the spans that count for the loss.

Template of a turn: ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts ``\`` is written
``\\`` and ``<|`` is written ``<\p``, so no text holds a control string and every text can be
read back; inside roles a line feed is ``<\n`` besides.

A conversation's turns have token prefix sums. With ``room`` tokens for new turns, the turns
that lie inside one stretch of ``room`` tokens make a window, and a turn that lies across the
end of a stretch is a window of its own, however short it is. Every later window first repeats
a leading system turn if that fits ``budget`` beside the new turns, else leaves it out; then
come the last turns before it that fit ``history`` tokens and what is left of the budget. So a
window is aligned to turns and holds at most ``budget`` tokens, or one longer turn and nothing
else. The loss mask covers assistant texts that are new in their window, so each counts once.

Turns are ordered by turn (nulls first), role and text. Null texts and roles are empty, a null
conv_id is a conversation of its own, an empty table gives no windows, other columns are not
read. Tokens of a turn: its words and four for the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm import shared

START, END = "<|im_start|>", "<|im_end|>"
TURN_TOKENS = 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def windows(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, window, text, n_context, loss) of turns (conv_id, turn, role, text).

    ``window`` counts from 1, ``n_context`` is the number of repeated turns at the start of
    ``text``, ``loss`` lists (start, length) in code points of ``text``.
    """
    role, body = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("body")), F.lit(END + "\n")))
    rows = rows.withColumn("tokens", F.regexp_count("body", F.lit(shared.WORD)) + TURN_TOKENS)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.row_number().over(order).alias("place"), F.sum("tokens").over(so_far).alias("after"))
    leads = (F.col("place") == 1) & (F.col("role") == "system")
    system = F.first(F.when(leads, F.struct("piece", "tokens"))).over(so_far)
    rows = rows.select("*", leads.alias("leads"), (F.col("after") - F.col("tokens")).alias("before"), system.alias("system"))
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(1))
    stretch = F.floor(F.col("before") / room)
    rows = rows.withColumn("key", stretch * 2 + F.when(F.floor((F.col("after") - 1) / room) != stretch, 1).otherwise(0))
    recent = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    rows = rows.withColumn("recent", F.collect_list(F.when(~F.col("leads"), F.struct("before", "piece"))).over(recent))
    span = F.struct(F.length(F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))).alias("skip"), F.length(escaped(F.col("body"))).alias("length"))
    turn = F.struct("place", "piece", (F.col("role") == "assistant").alias("counts"), span.alias("span"))
    head = F.min_by(F.struct("place", "before", "recent", "system"), "place")
    made = rows.groupBy("conv_id", "key").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("tokens").alias("new"), head.alias("head"))
    first, none = F.col("head.place") == 1, F.array().cast("array<string>")
    fits = F.coalesce(F.col("head.system.tokens") + F.col("new") <= budget, F.lit(False))
    left = F.lit(budget) - F.col("new") - F.when(fits, F.col("head.system.tokens")).otherwise(0)
    begin = F.col("head.before") - F.greatest(F.least(F.lit(history), left), F.lit(0))
    last = F.transform(F.filter("head.recent", lambda t: t["before"] >= begin), lambda t: t["piece"])
    context = F.when(first, none).otherwise(F.concat(F.when(fits, F.array("head.system.piece")).otherwise(none), last))
    made = made.withColumn("context", context).withColumn("lead", F.length(F.array_join("context", "")))
    reached = F.aggregate(
        "turns", F.struct(F.col("lead").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found")),
        lambda state, t: F.struct(
            (state["at"] + F.length(t["piece"])).alias("at"),
            F.when(t["counts"], F.concat(state["found"], F.array(F.struct((state["at"] + t["span"]["skip"]).alias("start"), t["span"]["length"].alias("length")))))
            .otherwise(state["found"]).alias("found")))
    text = F.concat(F.array_join("context", ""), F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("key"))
    return made.select("conv_id", number.alias("window"), text.alias("text"), F.size("context").alias("n_context"), reached["found"].alias("loss"))


def read_turns(text: Column, skip: Column) -> Column:
    """Array of (role, text) of a window's text, without the first ``skip`` turns."""
    parts = F.split(text, r"<\|im_start\|>")
    parts = F.slice(parts, skip + 2, F.greatest(F.size(parts) - 1 - skip, F.lit(0)))
    tail = len(END) + 1

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        return F.struct(
            unescaped_role(F.substring(part, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substring(part, at + 1, F.length(part) - at - tail)).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """Array of the texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"])))
