"""Streams with state: restarts, late rows, sessions across micro-batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from padron.streaming.panel import panel_cards, panel_stream, write_panel
from padron.streaming.sessions import session_stream, sessions, with_open, write_sessions
from padron.streaming.usage import usage_24h

START = datetime(2024, 3, 1)
EVENTS = "ts timestamp_ntz, user_id long, event_type string"


def made_events(n, users, days=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        at = START + timedelta(seconds=rng.uniform(0, days * 86400))
        user = None if rng.random() < 0.02 else rng.randrange(users)
        rows.append((at, user, "error" if rng.random() < 0.1 else "view"))
    return sorted(rows, key=lambda r: r[0])


def run_panel(spark, root, late="10 minutes", files_per_batch=1):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{root}/in")
    job = write_panel(panel_stream(stream, late), f"{root}/out", f"{root}/checkpoint")
    job.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_panel_equals_batch_at_every_hour(spark, tmp_path):
    """Failures and totals exactly, users within the sketch's error; restarted between files."""
    rows = made_events(6000, 900)
    for part in range(4):
        own = rows[part * 1500 : (part + 1) * 1500]
        spark.createDataFrame(own, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        written = run_panel(spark, str(tmp_path))  # each call is a new job on the same checkpoint
    cards = {r["until"]: r for r in panel_cards(written).collect()}
    mark = rows[-1][0] - timedelta(minutes=10)
    hours = [START + timedelta(hours=h) for h in range(1, 200)]
    assert set(cards) == {h for h in hours if h <= mark}
    everything = spark.createDataFrame(rows, EVENTS)
    for until in [hours[0], hours[30], hours[60], max(cards)]:
        batch = usage_24h(everything.where(F.col("ts") < until), F.lit(until).cast("timestamp_ntz")).first()
        card = cards[until]
        for name in ("total_queries", "failed_24h", "failed_prev_24h", "failed_change_pct"):
            assert card[name] == batch[name], (until, name)
        assert abs(card["active_users_24h"] - batch["active_users_24h"]) <= 0.03 * batch["active_users_24h"]


def test_many_users_stay_within_the_sketch_error(spark):
    """A table without a stream: 60,000 users of one day."""
    rows = spark.range(60_000).select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 80_000)).alias("ts"),
        F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"),
    )
    top = panel_cards(panel_stream(rows.union(rows))).agg(F.max("active_users_24h")).first()[0]
    assert abs(top - 60_000) < 0.03 * 60_000


def test_late_events_count_until_the_watermark(spark, tmp_path):
    def send(*rows):
        spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return run_panel(spark, str(tmp_path), late="2 hours")

    at = lambda **k: START + timedelta(**k)
    send((at(hours=1), 1, "view"), (at(hours=5), 2, "error"))
    send((at(hours=4, minutes=10), 3, "error"))  # late, but the step is open
    send((at(minutes=30), 4, "error"))  # its step is closed
    written = send((at(days=3), 5, "view"), (at(days=3, hours=2), None, "view"))
    cards = {r["until"]: r for r in panel_cards(written).collect()}
    day = cards[at(hours=24)]
    assert (day["failed_24h"], day["active_users_24h"], day["total_queries"]) == (2, 3, 3)
    assert cards[at(hours=28)]["failed_24h"] == 2 and cards[at(hours=29)]["failed_24h"] == 1
    assert cards[at(hours=29)]["failed_prev_24h"] == 1


MESSAGES = "conv_id long, ts timestamp, turn long, role string, text string"


def key(rows):
    return sorted(
        (
            (r["conv_id"] is None, r["conv_id"] or 0, r["started"], r["closed"], [tuple(m) for m in r["messages"]])
            for r in rows
        ),
    )


def run_sessions(spark, root, late="1 hour"):
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    write_sessions(session_stream(stream, late), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_split_and_late_sessions_equal_batch(spark, tmp_path):
    """Messages come up to an hour late, in ten files, each a run of the job."""
    rng = random.Random(7)
    rows = []
    for conv in [*range(30), None]:
        at = START + timedelta(minutes=rng.uniform(0, 600))
        for turn in range(rng.randrange(1, 25)):
            at += timedelta(minutes=rng.choice([1, 5, 12, 20, 45, 90]))
            rows.append((conv, at, turn, "user" if turn % 2 == 0 else "assistant", f"m{conv}-{turn}"))
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 55)))
    size = -(-len(arrival) // 10)
    for at in range(0, len(arrival), size):
        part = spark.createDataFrame(arrival[at : at + size], MESSAGES)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        written = run_sessions(spark, str(tmp_path))
    whole = spark.createDataFrame(rows, MESSAGES)
    expected = key(sessions(whole).collect())
    got = key(with_open(written, whole, "1 hour").collect())
    assert got == expected and len(got) > 60
    closed = key(written.collect())
    assert 0 < len(closed) < len(got) and all(row in expected for row in closed)


def test_sessions_of_odd_rows(spark):
    rows = [
        (1, START, 0, "user", "a"), (1, START, 0, "user", "a"), (1, START + timedelta(minutes=29), 1, None, None),
        (1, START + timedelta(minutes=60), 2, "user", ""), (None, START, None, "user", "x"), (2, None, 0, "user", "y"),
    ]
    found = key(sessions(spark.createDataFrame(rows, MESSAGES)).collect())
    assert [(none, conv, len(m)) for none, conv, _, _, m in found] == [(False, 1, 3), (False, 1, 1), (True, 0, 1)]
    assert sessions(spark.createDataFrame([], MESSAGES)).count() == 0
