"""The streaming forms over the events table, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquill import streaming
from sparkquill.session import table


def x1_window_bytes(spark, d):
    return streaming.window_bytes(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def x2_sliding_windows(spark, d):
    return streaming.window_bytes(table(spark, d, "events"), "2 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "n_bytes")


def x3_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "n")


SQL = {
    "x1_window_bytes": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(strlen(props))::BIGINT AS n_bytes, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "x2_sliding_windows": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(strlen(props))::BIGINT AS n_bytes FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL",
    "x3_sessions": "WITH e AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INTEGER AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM s GROUP BY user_id, k",
}

QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] == "x"}
