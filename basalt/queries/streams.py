"""Event-time streams, run over the events that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import events as S
from .registry import query


def _stream(t):
    return S.event_stream(t.spark, t.sf_dir, t.events)


@query("SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    out = S.drain(S.tumbling(_stream(t)), f"s{uuid.uuid4().hex}")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_session(t):
    out = S.drain(S.sessions(_stream(t), "6 hours"), f"s{uuid.uuid4().hex}")
    return out.select("user_id", F.unix_seconds("session_start").alias("session_start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    stream = _stream(t).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return S.drain(stream, f"s{uuid.uuid4().hex}", "append")
