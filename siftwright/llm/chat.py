"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Rolling turn-prefix hashes (each turn's hash covers all
turns up to it) identify those that are prefixes of longer ones; an anti-join keeps the maximal conversations, which
are rendered by a template. Exact copies collapse to the smallest id before the anti-join, so neither a common first
turn nor a common conversation makes a hot task: both are partial aggregates.

Defined results: turns are ordered by turn (null first), role and text; a null role or text is an empty one; rows
repeated exactly are turns of their own; a row without a conversation id is a conversation of one turn, and equal ones are
copies; the template's marks inside a role or text are broken by a space, so that what is rendered can be read back; an
empty table gives no row; extra columns change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MARKS = {"<|im_start|>": "<| im_start|>", "<|im_end|>": "<| im_end|>"}


def _turn_text(turn: Column) -> Column:
    said = F.concat(turn["role"], F.lit("\n"), turn["text"])
    for mark, broken in MARKS.items():
        said = F.replace(said, F.lit(mark), F.lit(broken))
    return said


def _rolling(turns: Column) -> Column:
    """sha256 of each prefix: of the hash before it and the turn's digest."""
    def step(seen: Column, turn: Column) -> Column:
        before = F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(""))
        parts = F.concat(before, F.lit("|"), F.sha2(turn["role"], 256), F.sha2(turn["text"], 256))
        return F.concat(seen, F.array(F.sha2(parts, 256)))

    return F.aggregate(turns, F.array().cast("array<string>"), step)


def conversations_of(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row for each conversation: conv_id, how often it is there, its ordered turns and its rolling prefix hashes."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    named = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id")
    named = named.agg(F.lit(1).cast("long").alias("weight"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    alone = rows.filter(F.col("conv_id").isNull()).groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn"), F.count("*").alias("weight"))
    whole = named.unionByName(alone.select("conv_id", "weight", F.array(F.struct("turn", "role", "text")).alias("turns")))
    return whole.withColumn("prefixes", _rolling(F.col("turns")))


def maximal(conversations: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another; of exact copies the smallest id, with their number."""
    keyed = conversations.withColumn("whole", F.element_at("prefixes", -1))
    first = keyed.groupBy("whole").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("last"), F.col("conv_id"))).alias("kept"), F.sum("weight").alias("n_copies")
    )
    shorter = (
        conversations.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("whole")).distinct()
    )
    kept = first.join(shorter, "whole", "left_anti").select(F.col("kept.conv_id").alias("kept_id"), "n_copies", F.col("whole").alias("kept_whole"))
    # an id is unique among conversations, and the turns are among those without one
    same = keyed["conv_id"].eqNullSafe(kept["kept_id"]) & (keyed["whole"] == kept["kept_whole"])
    return keyed.join(kept, same, "inner").select("conv_id", "turns", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text."""
    line = lambda t: F.concat(F.lit(OPEN), _turn_text(t), F.lit(CLOSE))
    return conversations.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "n_copies",
        F.array_join(F.transform("turns", line), "").alias("rendered"),
    )


def format_chats(turns: DataFrame, **columns: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return render(maximal(conversations_of(turns, **columns)))
