"""Preference formatting: one prompt from the common turns, two masked completions.

A pair is two conversations over the same opening. The longest common prefix of turns (equal role
and text) is rendered once as the prompt; what each side adds is its completion, with the character
spans that a trainer takes the loss on (the contents and end marks of assistant turns).

Only column expressions: a pair's turns meet in one row because a training example is one row. All
other work is per turn, and nothing pairs rows with each other.

Defined results: a null turn number sorts first; a null role or text counts as empty text; rows
repeated within one conversation count once; rows of the same turn are ordered by role, then text;
a conversation without partner has an empty other side; a null key is a key of its own. Extra
columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>", "\n"


def _turns(df: DataFrame, key: str, side: str) -> DataFrame:
    """Distinct turns with the side as a flag; the partial aggregation drops repeats before the shuffle."""
    return df.select(
        F.col(key).cast("long").alias("pair_id"), F.lit(side).alias("side"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()


def _side(turns: Column, side: str) -> Column:
    return F.transform(F.filter(turns, lambda t: t["side"] == side),
                       lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BREAK))


def _tail(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE + BREAK))


def rendered(turns: Column) -> Column:
    """Chat text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) character spans of assistant contents within ``rendered(turns)``."""
    step = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(_head(t)) + F.length(_tail(t))).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(_head(t))).alias("first"),
                (acc["at"] + F.length(_head(t)) + F.length(_tail(t)) - len(BREAK)).alias("last"),
            )))).otherwise(acc["spans"]).alias("spans")))
    return step["spans"]


def preference_examples(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per pair: pair_id, n_prefix, prompt, and both completions with their loss spans.

    ``chosen`` and ``rejected`` hold rows (key, turn, role, text); equal keys form a pair.
    """
    both = _turns(chosen, key, "chosen").unionByName(_turns(rejected, key, "rejected"))
    pairs = both.groupBy("pair_id").agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text", "side"))).alias("turns"))
    sides = pairs.select("pair_id", _side(F.col("turns"), "chosen").alias("c"),
                         _side(F.col("turns"), "rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, F.lit(False))
    split = sides.withColumn("n_prefix", F.when(first_other > 0, first_other - 1)
                             .otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))
    rest = {c: F.slice(c, F.col("n_prefix") + 1, F.size(c)) for c in ("c", "r")}
    split = split.select("pair_id", "n_prefix", F.slice("c", 1, F.col("n_prefix")).alias("p"),
                         rest["c"].alias("c"), rest["r"].alias("r"))
    return split.select(
        "pair_id", "n_prefix", rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), loss_spans(F.col("c")).alias("chosen_spans"),
        rendered(F.col("r")).alias("rejected"), loss_spans(F.col("r")).alias("rejected_spans"))


def answers_swapped(conversations: DataFrame) -> DataFrame:
    """Rejected sides for a table of plain conversations: each conversation with its last assistant
    turn answered by the last assistant turn of the conversation numbered one higher, or without that turn
    where there is none. One row per conversation is joined with one row, by key."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = c.filter("role = 'assistant'").groupBy("conv_id").agg(
        F.max(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "text")).alias("l"))
    own = last.select("conv_id", F.col("l.turn").alias("last_turn"), F.col("l.text").alias("last_text"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("l.text").alias("answer"))
    swapped = own.join(other, "conv_id", "left")
    at_last = (F.coalesce("turn", F.lit(-(1 << 62))) == F.col("last_turn")) & (F.col("role") == "assistant") \
        & (F.col("text") == F.col("last_text"))
    return c.join(swapped, "conv_id", "left").withColumn("hit", F.coalesce(at_last, F.lit(False))).filter(
        "not hit or answer is not null").select(
        "conv_id", "turn", "role", F.when(F.col("hit"), F.col("answer")).otherwise(F.col("text")).alias("text"))
