"""Preference formatting: the longest common turn prefix once, as prompt, and two masked completions.

``chosen`` and ``rejected`` are arrays of turns (role, text). The prompt renders the turns that both share from the start;
each completion renders its own remaining turns. A completion's mask lists the spans, in code points of the completion, that are trained on: the
text and end mark of assistant turns. Everything is an expression on one row; conversations are gathered by an
aggregation whose groups are single pairs of conversations.

Defined results: turns are equal when role and text are, nulls included; null renders as empty. Turns of one conversation are
ordered by (turn, role, text). A missing side is an empty conversation and ``paired`` is false. Two equal conversations
have empty completions. ``comparable`` says that both completions begin with an assistant turn. The template's marks inside
a text are defused ("<|" becomes "< |"), so that no text can pose as a turn. Conversation ids of any size and sign are
paired; turns with a null id are left out. Other columns of ``pairs`` pass through, whatever their names; those of the turns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.filters import free_names

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _safe(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit(MIDDLE))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Spans (first, after_last) of the rendered turns that are trained on."""
    lengths = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body"), (t["role"] == TRAINED_ROLE).alias("trained")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,after_last:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        first, end = state["at"] + t["head"], state["at"] + t["head"] + t["body"]
        span = F.array(F.struct(first.alias("first"), end.alias("after_last")))
        return F.struct(end.alias("at"), F.when(t["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(lengths, start, step, lambda state: state["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both share from the start."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    differs = F.zip_with(chosen, rejected, lambda a, b: ~a.eqNullSafe(b))
    return F.least(shorter, F.coalesce(F.array_position(differs, True), F.lit(0)).cast("int") - 1 + F.when(F.array_contains(differs, True), 0).otherwise(shorter + 1)).cast("int")


RESULT = ("n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "paired", "comparable")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """n_common, prompt, chosen, rejected, their masks, paired and comparable beside the other columns of ``pairs``.

    Where ``pairs`` has a column of such a name (``chosen`` and ``rejected`` aside), the new one gets an underscore in front.
    """
    others = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    names = free_names(others, *RESULT)
    left, right, n, own_left, own_right = free_names([*pairs.columns, *names], "left", "right", "n", "own_left", "own_right")
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.withColumn(left, F.coalesce("chosen", none)).withColumn(right, F.coalesce("rejected", none))
    sides = sides.withColumn(n, common_turns(F.col(left), F.col(right)))
    for side, own in ((left, own_left), (right, own_right)):
        sides = sides.withColumn(own, F.slice(F.col(side), F.col(n) + 1, F.greatest(F.lit(0), F.size(side) - F.col(n))))
    one, two = F.col(own_left), F.col(own_right)
    first_is_trained = [F.get(own, F.lit(0))["role"] == TRAINED_ROLE for own in (own_left, own_right)]
    found = (
        F.col(n),
        rendered(F.slice(left, F.lit(1), F.col(n))),
        rendered(one),
        rendered(two),
        mask(one),
        mask(two),
        (F.size(left) > 0) & (F.size(right) > 0),
        F.coalesce(first_is_trained[0] & first_is_trained[1], F.lit(False)),
    )
    return sides.select(*[F.col(f"`{c}`") for c in others], *[value.alias(name) for value, name in zip(found, names, strict=True)])


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: conversations 2 i (chosen) and 2 i + 1 (rejected) of (conv_id, turn, role, text) rows."""
    conv = F.col("conv_id").cast("long")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = turns.where("conv_id IS NOT NULL").select(F.shiftright(conv, 1).alias("pair_id"), F.pmod(conv, F.lit(2)).alias("side"), one.alias("one"))

    def side(n: int) -> Column:
        gathered = F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("one"))))
        return F.transform(gathered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    return own.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))
