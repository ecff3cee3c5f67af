"""Queries on logs, sessions and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import views
from lodestrata.streaming import sessions

from .inputs import events, plain
from .registry import query


@query("""WITH x AS (SELECT user_id, ts, event_id, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 15 MINUTES)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM x) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM y GROUP BY user_id, g""")
def user_sessions(s, d):
    return plain(sessions.sessions(events(s, d)), "first_ts", "last_ts")


@query("""WITH x AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id)
SELECT user_id, last_ts FROM x WHERE (SELECT max(last_ts) FROM x) - last_ts >= INTERVAL 15 MINUTES""")
def idle_users(s, d):
    return plain(sessions.idle(events(s, d)), "last_ts")


_MERGED = """SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, arg_max(value, {'a': ts, 'b': event_id}) FILTER (event_id % 3 <> 0) AS value FROM events GROUP BY user_id"""


def _merged(s, d):
    log = events(s, d).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return views.merged_status(log, "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(_MERGED)
def status_merge(s, d):
    return _merged(s, d)


@query(f"WITH m AS ({_MERGED}) SELECT c_custkey AS user_id, coalesce(event_type, 'unknown') AS event_type FROM customer LEFT JOIN m ON user_id = c_custkey")
def job_status(s, d):
    asked = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return views.job_status(asked, _merged(s, d), "user_id", "event_type").select("user_id", "event_type")


@query("""SELECT user_id, event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS DISTINCT FROM event_type""")
def run_state(s, d):
    return views.transitions(events(s, d), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "before", "event_type")
