"""Transcripts and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.raster import assign


def _watched(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which takes timestamps with a zone: those without one count in the session's. A batch as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding window; on a stream, rows later than the watermark are dropped."""
    e = _watched(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap."""
    e = _watched(events, late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row an event_id; on a stream, repeats within the watermark are dropped."""
    if events.isStreaming:
        return _watched(events, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def transcript_counts(transcripts: DataFrame, pixels: DataFrame, height: int, width: int, pixel_size: float = 1.0) -> DataFrame:
    """(label, gene, n) of a stream of transcripts over a fixed mask, for update or complete mode."""
    return assign(transcripts, pixels, height, width, pixel_size).where("label > 0").groupBy("label", "gene").agg(F.count("*").alias("n"))
