"""Ordered functions: smoothing, stable percentiles, neighbourhoods, sustained runs and running metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_scene(keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("scene_id",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def smooth(df: DataFrame, score: str, out: str, keys: Sequence[str] = ("video_id",), order: Sequence[str] = ("scene_id",)) -> DataFrame:
    """A fifth of each neighbour and three fifths of the row itself, which stands in for a missing neighbour; four places of the
    shortest decimal that names the double, halves up."""
    w = by_scene(keys, order)
    x = F.col(score)
    return df.withColumn(out, F.round(0.20 * F.coalesce(F.lag(score).over(w), x) + 0.60 * x + 0.20 * F.coalesce(F.lead(score).over(w), x), 4))


def stable_percentile(df: DataFrame, value: str, out: str, keys: Sequence[str] = ("video_id",), tie: str = "scene_id") -> DataFrame:
    """Rank by (value, tie) over the number of rows less one; ties differ, unlike percent_rank; 0 for a single row."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie))
    return df.withColumn(out, F.when(n > 1, (rank - 1) / (n - 1)).otherwise(0.0))


def eligible(df: DataFrame, score: str, keys: Sequence[str] = ("video_id",), required: Column | None = None) -> DataFrame:
    """Rows that aren't both under two fifths of their key's greatest score and under its mean; required rows stay."""
    w = Window.partitionBy(*keys)
    keep = ~((F.col(score) < 0.40 * F.max(score).over(w)) & (F.col(score) < F.avg(score).over(w)))
    return df.withColumn("_keep", keep if required is None else keep | required).where("_keep").drop("_keep")


def emotion_peak(df: DataFrame, intensity: str, confidence: str, decision: str, out: str = "emotion_peak", reach: int = 2) -> DataFrame:
    """emotion_change: half the distance to the mean of the neighbours; the peak weighs intensity, change and decision."""
    w = by_scene().rowsBetween(-reach, reach)
    n = F.count(intensity).over(w)
    around = F.when(n > 1, (F.sum(intensity).over(w) - F.col(intensity)) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    d = df.withColumn("emotion_change", F.abs(F.col(intensity) - around) / 2)
    return d.withColumn(out, F.least(F.lit(1.0), 0.45 * F.col(intensity) + 0.35 * F.col("emotion_change") + 0.20 * F.col(decision)) * F.col(confidence))


def neighbours(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], separator: str, out: str) -> DataFrame:
    """The previous and the next row's text, joined."""
    w = by_scene(keys, order)
    return df.withColumn(out, F.concat_ws(separator, F.lag(value).over(w), F.lead(value).over(w)))


def sustained(df: DataFrame, start: str, seconds: float, least: int, out: str, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Whether at least `least` rows start within the next `seconds`, the row itself included."""
    # whole milliseconds: a range frame needs an integer order
    w = Window.partitionBy(*keys).orderBy(F.round(F.col(start) * 1000).cast("long")).rangeBetween(0, round(seconds * 1000))
    return df.withColumn(out, F.count("*").over(w) >= least)


def average_precision(df: DataFrame, hit: Column, order: Sequence[Column | str], keys: Sequence[str], out: str = "average_precision") -> DataFrame:
    """Mean of the precision at each hit, in descending order of score."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_hit", hit.cast("int")).withColumn("_r", F.row_number().over(w))
    d = d.withColumn("_p", F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_r"))
    return d.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_p"))) / F.sum("_hit"), F.lit(0.0)).alias(out))


def boundaries(shots: DataFrame, vec: str, weights: DataFrame, longest_gap: float = 2.0) -> DataFrame:
    """(video_id, left_id, right_id, gap, visual, text, speech, temporal, continuity) of neighbouring shots.

    visual and text are cosines from 0 to 1, speech falls with the difference of the speech ratios, temporal with the gap, to
    0 at longest_gap; continuity weighs them .52, .28, .12 and .08. weights: video_id, scene_id, token, weight, of unit
    length for each shot (retrieval.tfidf).
    """
    from sceneql.functions.vectors import cosine

    w = by_scene(order=("start_seconds", "scene_id"))
    d = shots.select("video_id", "scene_id", F.lead("scene_id").over(w).alias("_next"), vec, F.lead(vec).over(w).alias("_vec"), "speech_ratio", F.lead("speech_ratio").over(w).alias("_speech"), F.greatest(F.lit(0.0), F.lead("start_seconds").over(w) - F.col("end_seconds")).alias("gap")).where("_next is not null")
    left = weights.join(d.select("video_id", "scene_id", "_next"), ["video_id", "scene_id"])
    right = weights.select("video_id", F.col("scene_id").alias("_next"), "token", F.col("weight").alias("_other"))
    text = left.join(right, ["video_id", "_next", "token"]).groupBy("video_id", "scene_id").agg(F.sum(F.col("weight") * F.col("_other")).alias("_text"))
    d = d.join(text, ["video_id", "scene_id"], "left")
    visual, said = cosine(vec, "_vec", 0.0), F.least(F.greatest(F.coalesce("_text", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    spoken, near = 1.0 - F.least(F.abs(F.col("speech_ratio") - F.col("_speech")), F.lit(1.0)), F.greatest(F.lit(0.0), 1.0 - F.col("gap") / longest_gap)
    d = d.select("video_id", F.col("scene_id").alias("left_id"), F.col("_next").alias("right_id"), "gap", visual.alias("visual"), said.alias("text"), spoken.alias("speech"), near.alias("temporal"))
    return d.withColumn("continuity", 0.52 * F.col("visual") + 0.28 * F.col("text") + 0.12 * F.col("speech") + 0.08 * F.col("temporal"))
