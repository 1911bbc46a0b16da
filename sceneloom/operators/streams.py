"""Streaming programs in their batch form: the same plans that streaming/ runs on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming.scores import sessions, windowed


@query("windowed_counts", "P16", ("aggregation",), "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event-time windows."""
    w = windowed(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "session_counts",
    "P17",
    ("aggregation", "counting"),
    "WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS events FROM g GROUP BY user_id",
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user."""
    return sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("deduplicated_events", "P03", ("counting",), "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice count once."""
    e = table(spark, sf_dir, "events")
    return e.union(e).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))
