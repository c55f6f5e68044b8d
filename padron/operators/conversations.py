"""Session logs: ordered messages and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def ordered_messages(df: DataFrame) -> DataFrame:
    """(conv_id, position, role, text), sorted within range partitions.

    A session of any length is a stretch of rows in one or more partitions.
    """
    rows = df.select("conv_id", F.col("turn").alias("position"), "role", "text")
    return rows.repartitionByRange("conv_id", "position").sortWithinPartitions("conv_id", "position")


def assemble(df: DataFrame, block: int | None = None) -> DataFrame:
    """Ordered message arrays, one row per session.

    ``block``: rows of at most so many turns instead, for sessions that one
    row can't hold; they add a ``block`` number, by which they are in order.
    """
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    if block is None:
        return df.groupBy("conv_id").agg(messages)
    part = F.floor(F.col("turn") / F.lit(block)).cast("long").alias("block")
    return df.groupBy("conv_id", part).agg(messages)


def exchanges(df: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    asked = df.filter("role = 'user'").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("next"), F.col("text").alias("question")
    )
    replied = df.filter("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("answer")
    )
    return asked.join(replied, ["conv_id", "next"], "inner").drop("next")
