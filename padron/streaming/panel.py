"""The usage panel of the last 24 hours, kept up to date by a stream.

Two chained windows: each step of time (an hour) is reduced to its counts and a sketch of its
users; a day that slides by steps adds the counts and unites the sketches. An event so touches
one step, and a step touches the days that hold it (24 for an hour). State is a sketch per open
step and day, whatever the number of users. Late rows change their step until the watermark
closes it; a day is written once, when it is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from padron.functions.numbers import fixed_text
from padron.streaming.usage import FAILED

DAY = "24 hours"
#: Binary logarithm of a sketch's buckets: a relative standard error of 0.8 %.
SKETCH_SIZE = 14


def panel_stream(events: DataFrame, late: str = "10 minutes", step: str = "1 hour") -> DataFrame:
    """(until, load, failed, users) for each day that ends with a step; ``users`` is a sketch.

    ``events``: ts, user_id, event_type. Works for a finished table, too. Null users are counted
    in the load only; rows without a time count nowhere.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    steps = timed.groupBy(F.window("ts", step)).agg(
        F.count(F.lit(1)).alias("load"),
        F.count_if(F.col("event_type") == FAILED).alias("failed"),
        F.hll_sketch_agg("user_id", SKETCH_SIZE).alias("users"),
    )
    days = steps.groupBy(F.window(F.window_time("window"), DAY, step)).agg(
        F.sum("load").alias("load"),
        F.sum("failed").alias("failed"),
        F.hll_union_agg("users").alias("users"),
    )
    return days.select(F.col("window.end").alias("until"), "load", "failed", "users")


def write_panel(panel: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Start the job; a day is appended once. A restart goes on from ``checkpoint``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (
        panel.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start(out)
    )


def panel_cards(written: DataFrame) -> DataFrame:
    """The panel's figures for each written day: those of ``usage_24h`` as of its end.

    The day before is the row that ends 24 hours earlier. All queries so far are the sum over
    days that do not overlap, which are those of equal time of day.
    """
    before = written.select(
        (F.col("until") + F.expr(f"INTERVAL {DAY}")).alias("until"), F.col("failed").alias("failed_before")
    )
    same_time = F.pmod(F.unix_seconds("until"), F.lit(86_400))
    so_far = Window.partitionBy(same_time).orderBy("until")
    rows = (
        written.withColumn("total_queries", F.sum("load").over(so_far))
        .join(before, "until", "left")
        .withColumn("failed_before", F.coalesce("failed_before", F.lit(0)))
    )
    change = F.try_divide(
        (F.col("failed") - F.col("failed_before")) * F.lit(100.0), F.col("failed_before")
    )
    return rows.select(
        "until",
        F.hll_sketch_estimate("users").alias("active_users_24h"),
        "total_queries",
        F.col("failed").alias("failed_24h"),
        F.col("failed_before").alias("failed_prev_24h"),
        fixed_text(change, 1).alias("failed_change_pct"),
    )
