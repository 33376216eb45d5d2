"""Queries of the streaming extension, on the batch table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources.tables import table
from tessera.streaming.sessions import density, sessions


def x1_sessions(spark, sf_dir):
    s = sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "n", "total")


X1 = """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, g"""


def x2_density(spark, sf_dir):
    return density(table(spark, sf_dir, "events")).select("event_type", F.unix_micros("start_at").alias("start_us"), "n")


X2 = """WITH e AS (SELECT event_type, epoch_us(ts) AS t FROM events), w AS (SELECT event_type, (t // 86400000000 - k) * 86400000000 AS start_us FROM e, (SELECT unnest([0, 1]) AS k))
SELECT event_type, start_us, count(*) AS n FROM w GROUP BY ALL"""

QUERIES = {"x1_session_windows": (x1_sessions, X1), "x2_hopping_windows": (x2_density, X2)}
