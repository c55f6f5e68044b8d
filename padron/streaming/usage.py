"""Usage panel: active users, queries, failures, load per minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.numbers import fixed_text

FAILED = "error"


def _since(events: DataFrame, span: str, now: Column | None = None) -> Column:
    """``span`` before now or else the latest event, as a value that filters reach the scan with."""
    if now is not None:
        return now - F.expr(f"interval {span}")
    return events.agg((F.max("ts") - F.expr(f"interval {span}")).alias("since")).scalar()


def usage_24h(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Active users and failures of the last 24 hours, the change on the day before, all queries.

    "Now" is the latest event unless given, which saves a look at all times. Only two days of events are read in full; the
    count of all queries needs no column. Users are reduced to one row each
    before they are counted, so no task holds a set of users.
    """
    recent = F.col("ts") > _since(events, "24 hours", now)
    failed = F.col("event_type") == FAILED
    per_user = (
        events.filter(F.col("ts") > _since(events, "48 hours", now))
        .withColumn("recent", recent)
        .groupBy("user_id")
        .agg(
            F.max("recent").alias("active"),
            F.count_if(F.col("recent") & failed).alias("failed"),
            F.count_if(~F.col("recent") & failed).alias("failed_before"),
        )
    )
    change = F.try_divide(
        (F.col("failed_24h") - F.col("failed_prev_24h")) * F.lit(100.0), F.col("failed_prev_24h")
    )
    return per_user.agg(
        F.count_if(F.col("active") & F.col("user_id").isNotNull()).alias("active_users_24h"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_24h"),
        F.coalesce(F.sum("failed_before"), F.lit(0)).alias("failed_prev_24h"),
    ).withColumns(
        {
            "total_queries": events.agg(F.count(F.lit(1))).scalar(),
            "failed_change_pct": fixed_text(change, 1),
        }
    )


def load_per_minute(events: DataFrame, minutes: int | None = 20) -> DataFrame:
    """Events per minute over the last ``minutes`` (``None``: over all of them)."""
    if minutes is not None:
        events = events.filter(F.col("ts") > _since(events, f"{minutes} minutes"))
    return events.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("load"),
        F.count_if(F.col("event_type") == FAILED).alias("failed"),
    )


def load_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Load and active users per minute of a stream, within a watermark.

    Users are counted approximately: the state per minute stays a fixed size.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 minute"))
        .agg(
            F.count(F.lit(1)).alias("load"),
            F.count_if(F.col("event_type") == FAILED).alias("failed"),
            F.approx_count_distinct("user_id").alias("active_users"),
        )
        .select(F.col("window.start").alias("minute"), "load", "failed", "active_users")
    )


def with_tail(written: DataFrame, events: DataFrame) -> DataFrame:
    """Written minutes, and those of a finished input that the watermark never closed."""
    closed = written.agg(F.max("minute").alias("closed")).scalar()
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    rest = events.filter((minute > closed) | closed.isNull())
    tail = load_per_minute(rest, None)
    return written.select("minute", "load", "failed").unionByName(tail)


def dropped_rows(query) -> int:
    """Rows of a streaming query that came too late for the watermark, so far as it reports."""
    return sum(
        int(state["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def write_load(load: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Start the job; a minute is written once, when the watermark has passed it."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        load.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(out)
    )
