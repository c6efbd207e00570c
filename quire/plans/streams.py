"""The streaming operators over the events table, drained into a table, with the batch SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.shared import new_folder
from quire.streaming import reading, timers

from .registry import query


def drained(spark, stream, name: str, mode: str, *keys: str):
    return reading.drained(stream, new_folder(spark, name), new_folder(spark, f"{name}-state"), mode, keys)


@query("SELECT user_id, event_type, round(sum(value), 2) AS seconds, count(*) AS touches FROM events GROUP BY ALL")
def stream_attention(spark, d):
    out = drained(spark, reading.attention(reading.event_stream(spark, d)), "attention", "complete")
    return out.select("user_id", "event_type", F.round("seconds", 2).alias("seconds"), "touches")


@query("SELECT count(DISTINCT event_id) AS events FROM events")
def stream_dedupe(spark, d):
    twice = reading.event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = drained(spark, reading.first_in_time(twice, ["event_id"]).select("event_id"), "dedupe", "append")
    return out.agg(F.count("*").alias("events"))


@query("""WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, TRUE) AS INT) AS new FROM events))
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events, round(sum(value), 2) AS seconds FROM s GROUP BY user_id, n""")
def stream_session_windows(spark, d):
    out = drained(spark, reading.sessions(reading.event_stream(spark, d)), "sessions", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "events", F.round("seconds", 2).alias("seconds"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_hour_windows(spark, d):
    out = drained(spark, reading.windows(reading.event_stream(spark, d)), "hours", "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "events")


@query("SELECT user_id, event_type, count(*) AS touches, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS division, count(*) >= 3 AS read FROM events GROUP BY ALL")
def stream_progress(spark, d):
    stream = reading.progress(reading.event_stream(spark, d))
    return drained(spark, stream, "progress", "update", "user_id", "event_type").select("user_id", "event_type", "touches", "division", "read")


@query("SELECT event_id, event_type AS mode, CAST(json_extract_string(props, '$.k') AS BIGINT) AS lim, user_id % 2 = 0 AS known FROM events")
def stream_events_json(spark, d):
    """Search events as JSON, with the fields that are null left out, written by a stream and read again."""
    from quire.sources.sinks import events

    stream = reading.event_stream(spark, d)
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))
    line = events(F.lit("search"), user, F.col("ts"), "catalogue", mode=F.col("event_type"), query=F.concat(F.lit("q"), "event_id"), limit=F.get_json_object("props", "$.k").cast("int"), results=F.lit(None).cast("int"))
    out = drained(spark, stream.select(line.alias("value")), "json", "append")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    fine = out.where((field("type") == "search") & ~F.contains("value", F.lit("results")))
    return fine.select(F.substring(field("query"), 2, 20).cast("long").alias("event_id"), field("mode").alias("mode"), field("limit").cast("long").alias("lim"), F.contains("value", F.lit('"user"')).alias("known"))


GATED = """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
UNION ALL SELECT g.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = g.user_id AND e.ts >= g.ts + INTERVAL {0} MINUTE) FROM g WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = g.user_id AND e.ts >= g.ts + INTERVAL {0} MINUTE)) SELECT user_id, epoch_us(ts) AS us FROM g"""


@query(GATED.format(30))
def stream_request_gate(spark, d):
    """Requests for enrichment: one of a user in 30 minutes, by kept state that a timer ends."""
    out = drained(spark, timers.let_through(reading.event_stream(spark, d), "user_id", "ts", 30), "gate", "append")
    return out.select(F.col("key").cast("long").alias("user_id"), "us")


@query(GATED.format(360))
def stream_probe_gate(spark, d):
    """Probes of a cover: one of a user in six hours."""
    out = drained(spark, timers.let_through(reading.event_stream(spark, d), "user_id", "ts", 360), "probe", "append")
    return out.select(F.col("key").cast("long").alias("user_id"), "us")


@query("""WITH f AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type <> 'view'), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM f),
r AS (SELECT user_id, n, min(ts) AS low, max(ts) AS high FROM s GROUP BY ALL), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events WHERE event_type <> 'view')
SELECT user_id AS service, FALSE AS up, epoch_us(low) AS us FROM r UNION ALL
SELECT user_id, TRUE, epoch_us(high + INTERVAL 2 HOUR) FROM r, w WHERE high + INTERVAL 2 HOUR <= w OR EXISTS (SELECT 1 FROM r x WHERE x.user_id = r.user_id AND x.n > r.n)""")
def stream_availability(spark, d):
    """Services (here users) that fail (here all events but views): down at a failure, up again two hours after the last. Timers wake those that no event does."""
    failures = reading.event_stream(spark, d).where("event_type != 'view'")
    out = drained(spark, timers.availability(failures, "user_id", "ts", 7200), "health", "append")
    return out.select(F.col("key").cast("long").alias("service"), "up", "us")
