"""Streams with state: the usage panel of a sliding day, and sessions of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from padron.plans.registry import register, table
from padron.session import scratch_dir
from padron.streaming.panel import panel_cards, panel_stream, write_panel
from padron.streaming.sessions import session_stream, with_open, write_sessions

MINUTE = "yyyy-MM-dd HH:mm"


@register(
    "stream_usage_24h",
    """WITH span AS (SELECT min(ts) AS first, max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
ends AS (SELECT unnest(generate_series(date_trunc('hour', first) + INTERVAL 1 HOUR, mark,
  INTERVAL 1 HOUR)) AS until FROM span),
days AS (SELECT until, count(*) AS load, count(DISTINCT user_id) AS active_users_24h,
    count(*) FILTER (event_type = 'error') AS failed_24h
  FROM ends JOIN events ON ts >= until - INTERVAL 24 HOUR AND ts < until GROUP BY until),
whole AS (SELECT until, count(*) AS total_queries FROM ends JOIN events ON ts < until GROUP BY until)
SELECT strftime(d.until, '%Y-%m-%d %H:%M') AS until, d.active_users_24h, total_queries,
  d.failed_24h, coalesce(b.failed_24h, 0) AS failed_prev_24h,
  CASE WHEN b.failed_24h > 0 THEN printf('%.1f', (d.failed_24h - b.failed_24h) * 100.0
    / b.failed_24h) END AS failed_change_pct
FROM days d JOIN whole USING (until) LEFT JOIN days b ON b.until = d.until - INTERVAL 24 HOUR""",
)
def stream_usage_24h(spark, sf):
    """The panel of every hour that the watermark has closed, as a stream wrote it."""
    root = scratch_dir(spark, "panel")
    events = table(spark, sf, "events")
    events.select("ts", "user_id", "event_type").write.parquet(f"{root}/in")
    arriving = spark.readStream.schema("ts timestamp_ntz, user_id long, event_type string")
    days = panel_stream(arriving.parquet(f"{root}/in"))
    write_panel(days, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    cards = panel_cards(spark.read.parquet(f"{root}/out"))
    return cards.withColumn("until", F.date_format("until", MINUTE))


#: Message times: conversations start 7 minutes apart, turns are 11 minutes apart, every third
#: one 61.
_MINUTES = "conv_id * 7 + turn * 11 + turn {} 3 * 50"


@register(
    "stream_sessions",
    f"""WITH timed AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes({_MINUTES.format('//')}) AS ts
  FROM conversations),
marked AS (SELECT *, ts - lag(ts) OVER w < INTERVAL 30 MINUTE AS same FROM timed
  WINDOW w AS (PARTITION BY conv_id ORDER BY ts, turn)),
numbered AS (SELECT *, count(*) FILTER (same IS NOT TRUE)
  OVER (PARTITION BY conv_id ORDER BY ts, turn) AS session FROM marked)
SELECT conv_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS started,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS closed, count(*) AS n,
  string_agg(turn || ':' || role || ':' || text, chr(30) ORDER BY turn) AS messages
FROM numbered GROUP BY conv_id, session""",
)
def stream_sessions(spark, sf):
    """Sessions as a stream closes them, and those that are open at its end."""
    root = scratch_dir(spark, "sessions")
    minutes = F.expr(_MINUTES.format("div"))
    timed = table(spark, sf, "conversations").withColumn(
        "ts", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + minutes * 60)
    )
    timed.write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(timed.schema).parquet(f"{root}/in")
    write_sessions(
        session_stream(arriving), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    whole = with_open(spark.read.parquet(f"{root}/out"), spark.read.parquet(f"{root}/in"))
    line = lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], m["text"])
    return whole.select(
        "conv_id",
        F.date_format("started", MINUTE).alias("started"),
        F.date_format("closed", MINUTE).alias("closed"),
        F.size("messages").cast("long").alias("n"),
        F.array_join(F.transform("messages", line), "\x1e").alias("messages"),
    )
