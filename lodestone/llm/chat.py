"""Preference formatting: pairs of conversations as one prompt and two masked completions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(turns: Column) -> Column:
    """Turns (role, text) as text: <|role|>, a new line, the text, <|end|>, a new line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("<|end|>\n"))), "")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def learned(turns: Column) -> Column:
    """start:stop, comma-joined: the code points of the rendered turns that a model learns, which are the assistant's texts and
    their end marks; all else is masked."""
    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        stop = start + F.length(turn["text"]) + 7
        more = F.array_append(state["spans"], F.concat_ws(":", start, stop))
        return F.struct((stop + 1).alias("at"), F.when(turn["role"] == "assistant", more).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, first, add)["spans"], ",")


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per row of pairs (pair_id, chosen_id, rejected_id): n_common, prompt, chosen, chosen_learned, rejected, rejected_learned.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are ordered by number, then role and text; a row that
    repeats counts once, rows without a conv_id are nobody's. A null role is 'user', a null text empty. The prompt is the
    longest run of first turns with the same roles and texts. A conversation that doesn't exist, or that is the prompt and no
    more, has an empty completion.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_distinct(F.array_sort(F.collect_list(turn))).alias("turns"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<role: STRING, text: STRING>>)")
    side = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id")
    for name in ("chosen", "rejected"):
        both = both.join(side.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns")), f"{name}_id", "left").withColumn(f"{name}_turns", F.coalesce(f"{name}_turns", none))
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    both = both.withColumn("n_common", F.when(differs == 0, F.size("chosen_turns")).otherwise(differs - 1).cast("int"))
    rest = {name: F.slice(f"{name}_turns", F.col("n_common") + 1, F.size(f"{name}_turns")) for name in ("chosen", "rejected")}
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_common", render(F.slice("chosen_turns", F.lit(1), F.col("n_common"))).alias("prompt"),
        render(rest["chosen"]).alias("chosen"), learned(rest["chosen"]).alias("chosen_learned"), render(rest["rejected"]).alias("rejected"), learned(rest["rejected"]).alias("rejected_learned"),
    )
