"""Streaming operators run to their end, held against the batch answer where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import progress as st
from .registry import query


@query("stream_progress_latest", "SELECT user_id AS job_id, arg_max(event_type, (ts, value, event_type)) AS stage, count(*) AS events FROM events GROUP BY 1")
def stream_progress_latest(spark, d):
    return st.drained(st.latest_progress(st.progress_events(st.read_events(spark, d))), "complete").select("job_id", "stage", "events")


@query("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type AS stage, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events) GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """Windows are final, and their state dropped, once the watermark (ten minutes) has passed them."""
    out = st.drained(st.tumbling_counts(st.progress_events(st.read_events(spark, d))), "append")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "stage", "n")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS job_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 40 MINUTE <= (SELECT max(ts) FROM events)""")
def stream_sessions(spark, d):
    out = st.drained(st.sessions(st.progress_events(st.read_events(spark, d))), "append")
    return out.select("job_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("stream_job_feed")
def stream_job_feed(spark, d):
    return st.drained(st.job_feed(st.progress_events(st.read_events(spark, d)), silence_ms=None), "append")


@query("stream_status", "SELECT user_id AS job_id, arg_max(status, (ts, status)) AS status FROM (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'approved' WHEN event_type = 'signup' THEN 'queued' ELSE 'processing' END AS status FROM events) GROUP BY 1")
def stream_status(spark, d):
    return st.drained(st.status_stream(st.progress_events(st.read_events(spark, d))), "complete").select("job_id", "status")
