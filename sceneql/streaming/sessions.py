"""Streams, an extension without a counterpart: utterances as sessions of words and sound events on sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utterance_sessions(words: DataFrame, at: str = "ts", late: str = "1 minute") -> DataFrame:
    """Words of a video with silences under 2.75 s between them: (video_id, start, end, n). Works on batches, too."""
    w = words.withWatermark(at, late) if words.isStreaming else words
    return w.groupBy("video_id", F.session_window(at, "2750 milliseconds").alias("s")).agg(F.count("*").alias("n")).select("video_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def sliding_counts(events: DataFrame, kind: str, at: str = "ts", size: str = "2 hours", hop: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each kind in sliding windows: (kind, start, n)."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, size, hop).alias("w"), kind).agg(F.count("*").alias("n")).select(kind, F.col("w.start").alias("start"), "n")
