"""Preference pairs as one prompt and two completions with training masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rendered turn is OPENING + role + BREAK + text + CLOSING.
OPENING, BREAK, CLOSING = "<|", "|>\n", "<|end|>\n"
#: The role whose turns are trained on: its text and the end mark, not the header.
TRAINED = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPENING), F.coalesce(turn["role"], F.lit("")), F.lit(BREAK))


def _render(turn: Column) -> Column:
    return F.concat(_header(turn), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSING))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """``array<struct<start, end>>`` of the trained code points of the rendered turns, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, turn: Column) -> Column:
        end = done["at"] + F.length(_render(turn))
        # Up to the end mark; the line break after it belongs to the template.
        span = F.struct((done["at"] + F.length(_header(turn))).alias("start"), (end - 1).alias("end"))
        trained = turn["role"].eqNullSafe(F.lit(TRAINED))
        spans = F.when(trained, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda done: done["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``<pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask>``, one row per pair.

    Both inputs are turns ``<pair_id, turn, role, text>``. The longest run of
    equal first turns (role and text) of a pair is rendered once as ``prompt``;
    what follows on either side are the completions, whose masks are the code
    points to train on.

    * Turns are ordered by ``turn``, then role and text; a null ``turn`` is first.
    * Null texts and roles are empty ones when rendered, and equal to nulls only.
    * A pair with one side, or one side that begins the other, has an empty completion.
    * Repeated rows are repeated turns. Rows without ``pair_id`` belong to no
      pair and are left out. Empty tables give an empty result.
    """
    names = ["pair_id", "turn", "role", "text"]
    rows = chosen.select(*names, F.lit(True).alias("side")).union(rejected.select(*names, F.lit(False).alias("side")))
    turn = F.struct("turn", "role", "text")

    def turns(side: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(side, turn)))

    # One shuffle by pair brings both conversations together.
    pairs = rows.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(turns(F.col("side")).alias("c"), turns(~F.col("side")).alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    # Null where the turns of a place are the same.
    differs = F.zip_with(
        F.slice("c", F.lit(1), both),
        F.slice("r", F.lit(1), both),
        lambda a, b: ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])),
    )
    first = F.array_position(differs, True)
    common = F.when(first > 0, first - 1).otherwise(both).cast("int")
    split = pairs.withColumn("n", common)

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))

    return split.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        _text(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _text(rest("c")).alias("chosen"),
        _text(rest("r")).alias("rejected"),
        _mask(rest("c")).alias("chosen_mask"),
        _mask(rest("r")).alias("rejected_mask"),
    )
