"""Conversations put together from a stream of messages: a pause closes a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = "30 minutes"


def _timed(messages: DataFrame) -> DataFrame:
    """Times as timestamps; left alone if they are, since a cast would lose a watermark."""
    if messages.schema["ts"].dataType == T.TimestampType():
        return messages
    return messages.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(messages: DataFrame, gap: str = GAP) -> DataFrame:
    """(conv_id, started, closed, messages): one row per session, its messages in order of turns.

    ``messages``: conv_id, ts, turn, role, text; a table or, with a watermark, a stream. Messages
    of one conversation that are less than ``gap`` apart are one session, whatever the order or
    the micro-batch in which they come. Rows without a time are left out; those without a
    conversation id are one conversation.
    """
    return (
        _timed(messages)
        .groupBy("conv_id", F.session_window("ts", gap))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
        .select(
            "conv_id",
            F.col("session_window.start").alias("started"),
            F.col("session_window.end").alias("closed"),
            "messages",
        )
    )


def session_stream(messages: DataFrame, late: str = "10 minutes", gap: str = GAP) -> DataFrame:
    """Sessions of a stream; one is final when the watermark has passed its last message by ``gap``.

    State is the messages of open sessions; a message later than ``late`` is dropped by Spark.
    """
    return sessions(_timed(messages).withWatermark("ts", late), gap)


def write_sessions(closed: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Start the job; a session is appended once. A restart goes on from ``checkpoint``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return (
        closed.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(out)
    )


def with_open(
    written: DataFrame, messages: DataFrame, late: str = "10 minutes", gap: str = GAP
) -> DataFrame:
    """Written sessions, and those of a finished input that the watermark never closed.

    Only conversations with a message near the end are looked at again.
    """
    ts = F.col("ts").cast("timestamp")
    # A watermark counts in whole milliseconds.
    mark = F.date_trunc("millisecond", F.max(ts) - F.expr(f"INTERVAL {late}"))
    mark = messages.agg(mark.alias("mark")).scalar()
    recent = messages.where(ts + F.expr(f"INTERVAL {gap}") > mark).select(
        F.col("conv_id").alias("_recent")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_recent"))
    rest = sessions(messages.join(recent.distinct(), same, "left_semi"), gap)
    return written.unionByName(rest.where(F.col("closed") > mark))
