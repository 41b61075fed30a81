"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import saved

# The rendered form of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>), in the order of turn, then role and text.

    A conversation's turns are gathered in one row, as its rendered text must be; repeated rows count
    once. Null text is empty, a null role is 'unknown'; rows without a conversation or turn are left out.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))


def _key(turn: Column) -> Column:
    return F.struct(turn["role"], turn["text"])


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    pairs = F.zip_with(F.transform(a, _key), F.transform(b, _key), lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(pairs, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    """Turns as text: '<|role|>' and a line break, the text, '<|end|>' and a line break."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """[start, end) character spans of a rendered completion that are trained on: assistant texts with their end mark."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_head(t)).alias("head"), (F.length(t["text"]) + len(CLOSE) - 1).alias("body"), F.lit(1).alias("tail"), (t["role"] == TRAINED_ROLE).alias("on")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        a = acc["at"] + s["head"]
        b = a + s["body"]
        span = F.struct(a.alias("start"), b.alias("end"))
        return F.struct((b + s["tail"]).alias("at"), F.when(s["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Rendered rows of (pair_id, chosen, rejected): prompt, both completions and their masks.

    The prompt is the longest common turn prefix, rendered once. Where one conversation is the other's
    beginning, or both are equal, its completion is empty with an empty mask. Null conversations are empty.
    """
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    rows = pairs.select("*", F.coalesce("chosen", F.array().cast(kind)).alias("c"), F.coalesce("rejected", F.array().cast(kind)).alias("r"))
    rows = rows.withColumn("n_prompt_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("n_prompt_turns") + 1, F.greatest(F.size(x), F.lit(1)))
    rows = rows.withColumns({"prompt": render(F.slice("c", 1, F.col("n_prompt_turns"))), "c": rest(F.col("c")), "r": rest(F.col("r"))})
    rows = rows.withColumns({"chosen_completion": render(F.col("c")), "rejected_completion": render(F.col("r")), "chosen_mask": mask(F.col("c")), "rejected_mask": mask(F.col("r"))})
    return rows.drop("c", "r", "chosen", "rejected")


def pair_up(talks: DataFrame) -> DataFrame:
    """(pair_id, rejected_id, chosen, rejected): each conversation against the next one that opens alike.

    Conversations with equal first turns are put in order of their trained text's length, longest first,
    then id; each is chosen over its successor, so a group of n gives n - 1 pairs. A conversation that no
    other opens like, and the last of a group, is chosen over its own beginning without the last turn.
    Pairs are thus made up from the table itself, which names no preference. Order within a group comes from
    range-sorted rows and their neighbours, not from a task per group. talks: of conversations(), whose
    conversations are neither null nor empty; an empty table gives no pairs.
    """
    first = F.sha2(F.to_json(_key(F.element_at("turns", 1))).cast("binary"), 256)
    worth = F.aggregate("turns", F.lit(0), lambda acc, t: acc + F.when(t["role"] == TRAINED_ROLE, F.length(t["text"])).otherwise(0))
    rows = talks.select("conv_id", "turns", first.alias("opening"), (-worth).alias("rank"))
    # hot openings are split into ordered slices; a slice's last row meets the next slice's first
    slim = saved(rows.select("opening", "rank", "conv_id").repartitionByRange("opening", "rank", "conv_id").withColumn("slice", F.spark_partition_id()), "openings")
    by = Window.partitionBy("slice", "opening").orderBy("rank", "conv_id")
    inner = slim.select("*", F.lead("conv_id").over(by).alias("next"))
    heads = slim.groupBy("opening", "slice").agg(F.min_by("conv_id", F.struct("rank", "conv_id")).alias("head"))
    after = heads.select("opening", "slice", F.lead("head").over(Window.partitionBy("opening").orderBy("slice")).alias("later"))
    linked = inner.join(after, ["opening", "slice"]).select("conv_id", F.coalesce("next", "later").alias("rejected_id"))
    other = talks.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    out = talks.join(linked, "conv_id")
    own = F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0)))
    # those without a successor need no join, in which their null keys would all meet in one task
    met = out.where("rejected_id IS NOT NULL").join(other, "rejected_id")
    lone = out.where("rejected_id IS NULL").withColumn("rejected", own)
    columns = [F.col("conv_id").alias("pair_id"), "rejected_id", F.col("turns").alias("chosen"), "rejected"]
    return met.select(columns).unionByName(lone.select(columns))
