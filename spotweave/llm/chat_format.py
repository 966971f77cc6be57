"""Preference formatting of conversations: one prompt, two masked completions.

``format_preferences`` takes pairs of conversations (arrays of turns), finds their longest common turn prefix, renders it
once as the prompt, and renders what follows on either side as completions. A completion's mask lists the spans that a
loss would cover: the text of each assistant turn with its end mark, as ``first-last`` offsets into the completion
(``last`` is the place after the span).

``preference_pairs`` makes pairs of a table of turns: the chosen side is a conversation up to its last assistant turn, the
rejected side ends with the last assistant turn of the partner conversation (ids 2k and 2k+1 are partners), or with an
empty turn where there is none.

Repeated turns count once. Turns are in the order of their number (null first), then role and text; null roles and
texts are empty, in pairs too, where a null turn has both empty and a null side has no turns. Turns without a conversation id, and conversations without an assistant turn, have nothing to prefer
and give no row. Pairs that are equal have all turns in the prompt and empty completions. A conversation is one row of
the result, so its turns are gathered in one row; conversations are not gathered together. A table without rows gives
none. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a turn.
OPEN, MIDDLE, CLOSE, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``: the array of (role, text) in order."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    all_turns = turns.where(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_set(row)).alias("all"))
    return all_turns.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def preference_pairs(turns: DataFrame, **names: str) -> DataFrame:
    """``conv_id``, ``chosen`` and ``rejected`` (arrays of turns) of each conversation with an assistant turn."""
    convs = conversations(turns, **names)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == ASSISTANT)), True) + 1
    ended = convs.where(F.exists("turns", lambda t: t["role"] == ASSISTANT)).withColumn("last", last.cast("int"))
    ended = ended.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"))
    answers = ended.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("chosen", -1)["text"].alias("answer"))
    other = F.struct(F.lit(ASSISTANT).alias("role"), F.coalesce("answer", F.lit("")).alias("text"))
    rejected = F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(other))
    return ended.join(answers, "conv_id", "left").select("conv_id", "chosen", rejected.alias("rejected"))


def _clean(side: str) -> Column:
    """The turns of a side without nulls: a null role or text is empty, a null turn has both empty, a null side no turns."""
    turns = F.transform(side, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.when(F.col(side).isNotNull(), turns).otherwise(F.array().cast("array<struct<role:string,text:string>>"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE + AFTER))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """The spans of assistant text, each with its end mark."""
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + len(OPEN) + F.length(turn["role"]) + len(MIDDLE)
        after = first + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.concat(first.cast("string"), F.lit("-"), after.cast("string")))
        return F.struct((state["at"] + F.length(_rendered(turn))).cast("int").alias("at"), F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with ``n_prompt_turns``, ``prompt``, ``chosen_text``, ``chosen_mask``, ``rejected_text``, ``rejected_mask``."""
    made = ["n_prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask"]
    own = [c for c in pairs.columns if c.lower() not in made]
    # a turn that one side lacks is null here, and no turn is null after _clean
    same = F.zip_with("_sides.c", "_sides.r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differ = F.array_position(same, False)
    n = F.when(differ == 0, F.size(same)).otherwise(differ - 1).cast("int")
    sides = pairs.select(F.struct(*own).alias("_own"), F.struct(_clean(chosen).alias("c"), _clean(rejected).alias("r")).alias("_sides"))
    marked = sides.withColumn("_n", n)

    def after(side: str) -> Column:
        return F.slice(side, F.col("_n") + 1, F.greatest(F.size(side) - F.col("_n"), F.lit(0)))

    c, r = "_sides.c", "_sides.r"
    return marked.select(
        "_own.*", F.col("_n").cast("long").alias("n_prompt_turns"), _render(F.slice(c, F.lit(1), F.col("_n"))).alias("prompt"),
        _render(after(c)).alias("chosen_text"), _mask(after(c)).alias("chosen_mask"), _render(after(r)).alias("rejected_text"), _mask(after(r)).alias("rejected_mask"),
    )
