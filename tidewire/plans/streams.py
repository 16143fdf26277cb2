"""Queries that run as streams; their results equal the batch queries of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import jobs


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stream, each id once."""
    return jobs.run_to_table(jobs.deduplicated(jobs.event_stream(spark, sf_dir).select("event_id", "event_type", "at"), ["event_id"])).select("event_id", "event_type")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type of the days that the watermark has closed."""
    out = jobs.run_to_table(jobs.windowed_counts(jobs.event_stream(spark, sf_dir), "event_type"))
    return out.select(F.col("window_start").cast("date").alias("day"), "event_type", "n", "total")


def session_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by gaps of 30 minutes, in batch."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return e.groupBy(F.session_window("at", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {"stream_dedup": stream_dedup, "stream_windows": stream_windows, "session_lengths": session_lengths}
SQL = {
    "stream_dedup": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_windows": "WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM e, m WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= w GROUP BY day, event_type",
    "session_lengths": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id",
}
