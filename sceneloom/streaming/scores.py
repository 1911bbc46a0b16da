"""Structured Streaming over response logs: windows, sessions, exactly-once scoring, stateful counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of events."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and means by event-time window and type; works on streams and tables alike."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users by gaps."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it was delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def curriculum(events: DataFrame) -> DataFrame:
    """Running attempts and successes by type, kept as state: a row for each type and batch in which it came."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tries, wins = state.get if state.exists else (0, 0)
        for pdf in frames:
            tries, wins = tries + len(pdf), wins + int((pdf["value"] > 20).sum())
        state.update((tries, wins))
        yield pd.DataFrame({"event_type": [key[0]], "tries": [tries], "wins": [wins]})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, tries bigint, wins bigint", "tries bigint, wins bigint", "update", "NoTimeout")


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a table in memory; for tests and small looks only."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
