"""Segments of shots: expansion by context, and edges that cut into no turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneql.operators import intervals as I
from sceneql.operators.joins import overlap_join
from sceneql.operators.selection import fill_rows

#: Shortest, target and longest segment, seconds of context before and after, gap to merge, by category.
CATEGORIES = {"action": (4.0, 7.0, 12.0, 1.5, 2.0, 2.5), "dialogue": (6.0, 10.0, 18.0, 2.0, 2.5, 3.0), "importance": (7.0, 11.0, 30.0, 5.0, 3.0, 3.0), "custom": (4.0, 7.0, 15.0, 1.5, 2.0, 2.5)}


def expand(shots: DataFrame, pre: float, post: float, shortest: float, event: str, event_floor: float) -> DataFrame:
    """shots with expanded_start and expanded_end: context before and after, up to two following shots while their event
    score stays at the floor or above, then an even pad up to the shortest length, all within the video."""
    w = Window.partitionBy("video_id").orderBy("scene_id")
    first, second = F.lead(event, 1).over(w) >= event_floor, F.lead(event, 2).over(w) >= event_floor
    end = F.least("video_duration", F.col("end_seconds") + post)
    d = shots.withColumn("_a", F.greatest(F.lit(0.0), F.col("start_seconds") - pre)).withColumn("_z", end)
    d = d.withColumn("_z", F.greatest("_z", F.coalesce(F.when(first, F.lead("end_seconds", 1).over(w)), F.col("_z")), F.coalesce(F.when(first & second, F.lead("end_seconds", 2).over(w)), F.col("_z"))))
    d = d.withColumn("_pad", F.greatest(F.lit(0.0), shortest - (F.col("_z") - F.col("_a"))) / 2)
    return d.withColumn("expanded_start", F.greatest(F.lit(0.0), F.col("_a") - F.col("_pad"))).withColumn("expanded_end", F.least("video_duration", F.col("_z") + F.col("_pad"))).drop("_a", "_z", "_pad")


def speech_safe(segs: DataFrame, turns: DataFrame, target_sec: float | None = None, pad: float = 0.22) -> DataFrame:
    """(video_id, start_seconds, end_seconds, segment_score, speech, mandatory): segments that cut into no turn, the last step of a summary.

    Edges leave the turns they lie in, segments within .08 s of each other become one with the best score, and edges leave
    turns again; over the target the fullest choice stays, and a single silent segment is trimmed. A video where none fits
    has no row, nor one whose mandatory segments exceed the target. segs: video_id, start_seconds, end_seconds, segment_score,
    video_duration and, if any must stay, mandatory; turns: video_id, start_seconds,
    end_seconds. Turns of other videos are ignored, and a video without turns keeps its edges.
    """
    key, ends = ["video_id"], ("start_seconds", "end_seconds")

    def bounded(d: DataFrame) -> DataFrame:
        return I.safe_bounds(d, turns, key, *ends, *ends, pad, "video_duration").where("end_seconds > start_seconds")

    must = F.col("mandatory") if "mandatory" in segs.columns else F.lit(False)
    d = bounded(segs.select("video_id", *[F.col(c).cast("double").alias(c) for c in ends], "segment_score", "video_duration", must.alias("mandatory")))
    d = I.merge(d, key, *ends, 0.08, ["segment_score"], [F.max(c).alias(c) for c in ("segment_score", "video_duration", "mandatory")]).drop("n")
    d = bounded(d)
    said = overlap_join(d.select("video_id", *ends), turns.select("video_id", F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e")), key, *ends, "_s", "_e", 30.0)
    told = said.select("video_id", *ends).distinct().withColumn("speech", F.lit(True))
    d = d.join(told, ["video_id", *ends], "left").select("video_id", *ends, "segment_score", F.coalesce("speech", F.lit(False)).alias("speech"), "mandatory")
    return d if target_sec is None or not 0 < target_sec < 9999 else fill_rows(d, target_sec)
