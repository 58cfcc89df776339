"""Ranks, pools, unions by priority and small aggregates over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each key. The filter on the rank lets Spark cut each partition before the shuffle."""
    return ranked(df, keys, order, out).where(F.col(out) <= n)


def pool(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], budget: float, shortest: float) -> DataFrame:
    """80 to 400 rows of each key, four for each slot of the budget."""
    slots = -int(-budget // max(shortest, 0.5))
    return top(df, keys, order, min(400, max(80, 4 * slots)))


def fill(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cost: str, target: float) -> DataFrame:
    """Rows in order while what came before is under the target."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("_before") < target).drop("_before")


def priority_union(lanes: Sequence[tuple[str, DataFrame]], ids: Sequence[str]) -> DataFrame:
    """Each id once, with the name of the first lane that has it."""
    both = None
    for k, (name, df) in enumerate(lanes):
        d = df.select(*ids, F.lit(k).alias("_p"), F.lit(name).alias("source"))
        both = d if both is None else both.unionByName(d)
    return both.groupBy(*ids).agg(F.min_by("source", "_p").alias("source"))


#: The lanes of a candidate pool in order, and the share of the limit that a lane ends at.
LANES = (("required", None), ("local", 0.35), ("time", None), ("event", 0.15), ("neighbour", 0.10), ("story", 0.20), ("score", None))


def candidate_pool(shots: DataFrame, local: DataFrame, required: DataFrame, score: str, event: str, story: str, limit: int) -> DataFrame:
    """(video_id, scene_id, source, place): at most `limit` candidates of each video, lane by lane.

    Lanes in order: required rows; the locally chosen (local: video_id, scene_id, n in order); each time bin's best, 8, 12 or
    16 bins by the midpoint; each bin's greatest event; the neighbours of all locally chosen ones; each story's best; all by
    score. A lane with a share offers that many rows, two at least, but no more than the pool has room for when it begins;
    rows that the pool has already count, too. A fold over the lanes' arrays, which are bounded by the limit or the bins.
    shots: video_id, scene_id, start_seconds, end_seconds.
    """
    limit = min(max(limit, 1), 72)
    bins = 8 if limit <= 32 else 12 if limit <= 48 else 16
    key, best = ["video_id"], [F.desc(score), "scene_id"]
    w, whole = Window.partitionBy(*key).orderBy("start_seconds", "scene_id"), Window.partitionBy(*key)
    begin = F.min("start_seconds").over(whole)
    at = ((F.col("start_seconds") + F.col("end_seconds")) / 2 - begin) / F.greatest(F.max("end_seconds").over(whole) - begin, F.lit(0.001))
    d = shots.select("video_id", "scene_id", score, event, story, F.least(F.floor(bins * at), F.lit(bins - 1)).alias("_bin"), F.lag("scene_id").over(w).alias("_prev"), F.lead("scene_id").over(w).alias("_next"))
    chosen = d.join(local.select("video_id", "scene_id", F.col("n").alias("_n")), ["video_id", "scene_id"])
    side = chosen.select("video_id", "_n", F.posexplode(F.array("_prev", "_next")).alias("_side", "scene_id")).where("scene_id is not null")
    rows = {
        "required": top(required.select("video_id", "scene_id"), key, ["scene_id"], limit, "n"),
        "local": top(chosen, key, ["_n"], limit, "n"),
        "time": top(d, ["video_id", "_bin"], best, 1, "_r").withColumn("n", F.col("_bin")),
        "event": top(d, ["video_id", "_bin"], [F.desc(event), *best], 1, "_r").withColumn("n", F.col("_bin")),
        "neighbour": top(side, key, ["_n", "_side"], limit, "n"),
        "story": top(top(d, ["video_id", story], best, 1, "_r"), key, best, limit, "n"),
        "score": top(d, key, best, 2 * limit, "n"),
    }
    both = None
    for name, lane in rows.items():
        x = lane.select("video_id", F.lit(name).alias("lane"), F.col("n").cast("long").alias("n"), "scene_id")
        both = x if both is None else both.unionByName(x)
    g = both.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("lane", "n", "scene_id"))).alias("_all")).withColumn("_0", F.array().cast(f"array<{shots.schema['scene_id'].dataType.simpleString()}>"))

    def of(name: str) -> Column:
        return F.transform(F.filter("_all", lambda x: x["lane"] == name), lambda x: x["scene_id"])

    for k, (name, share) in enumerate(LANES):
        own = of(name)
        if share is not None:
            most = F.lit(max(2, round(share * limit)))
            own = F.slice(own, F.lit(1), most if name == "local" else F.least(most, F.lit(limit) - F.size(f"_{k}")))
        g = g.withColumn(f"_{k + 1}", F.slice(F.array_union(F.col(f"_{k}"), own), 1, limit))
    source = F.lit(None)
    for k in reversed(range(len(LANES))):
        source = F.when(F.col("place") <= F.size(f"_{k + 1}"), LANES[k][0]).otherwise(source)
    placed = g.select("*", F.posexplode(f"_{len(LANES)}").alias("_at", "scene_id")).withColumn("place", F.col("_at") + 1)
    return placed.select("video_id", "scene_id", source.alias("source"), "place")


def min_max(df: DataFrame, value: str, out: str, flat: float, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """value within its key's range as 0 to 1; `flat` where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(flat))


def distinct_text(df: DataFrame, keys: Sequence[str], text: str, order: str, separator: str, out: str) -> DataFrame:
    """Each group's texts once, whatever their case, in order of first appearance."""
    first = top(df, [*keys, "_low"], [order], 1, "_r") if "_low" in df.columns else top(df.withColumn("_low", F.lower(text)), [*keys, "_low"], [order], 1, "_r")
    g = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_all"))
    return g.select(*keys, F.array_join(F.transform("_all", lambda x: x[text]), separator).alias(out))


def cues(tokens: Column, prefixes: Sequence[str]) -> Column:
    """How many of the prefixes begin a token."""
    return F.size(F.filter(F.array(*map(F.lit, prefixes)), lambda c: F.exists(tokens, lambda t: F.startswith(t, c))))


def majority(df: DataFrame, keys: Sequence[str], choice: str, least: int, share: float, once: bool = False) -> DataFrame:
    """Each key's most frequent choice, where it is frequent enough; ties to the smallest choice.

    once: a choice is one key's alone, within all keys but the last: the one with the greatest share, then count, then key.
    Every key has one candidate, so this is what a greedy assignment by (share, count, key) gives.
    """
    c = df.groupBy(*keys, choice).agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    best = top(c, keys, [F.desc("n"), choice], 1, "_r").where((F.col("n") >= least) & (F.col("share") >= share))
    if once:
        best = top(best.drop("_r"), [*keys[:-1], choice], [F.desc("share"), F.desc("n"), F.desc(keys[-1])], 1, "_r")
    return best.drop("_r")


def screen_time(seen: DataFrame, scenes: DataFrame, share: float = 0.005, most: int = 24, leads: int = 3) -> DataFrame:
    """(video_id, actor, seconds, n, rank, role): the cast by screen time, a scene's seconds weighted by the share of its samples
    that show the actor.

    seen: video_id, scene_id, sample, actor; scenes: video_id, scene_id, duration_seconds, samples. An actor appears in two
    scenes at least, and in half a percent of them; the first `most` count. Where no one does, the first three do.
    """
    hits = seen.groupBy("video_id", "scene_id", "actor").agg(F.count_distinct("sample").alias("_hits"))
    t = hits.join(scenes, ["video_id", "scene_id"]).groupBy("video_id", "actor").agg(F.sum(F.col("duration_seconds") * F.col("_hits") / F.greatest("samples", F.lit(1))).alias("seconds"), F.count("*").alias("n"))
    floor = scenes.groupBy("video_id").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * share)).alias("_floor"))
    t = t.join(floor, "video_id").withColumn("_fits", F.col("n") >= F.col("_floor")).withColumn("_any", F.max("_fits").over(Window.partitionBy("video_id")))
    cast = ranked(t.where("_fits or not _any"), ["video_id"], [F.desc("seconds"), "actor"], "rank").where(F.col("rank") <= F.when(F.col("_any"), most).otherwise(3))
    return cast.select("video_id", "actor", "seconds", "n", "rank", F.when(F.col("rank") <= leads, "lead").otherwise("support").alias("role"))


def story_cap(df: DataFrame, keys: Sequence[str], story: str, order: Sequence[Column | str], per_story: int, most: int, required: Column | None = None) -> DataFrame:
    """The first per_story rows of each story, required ones beyond that, and the first `most` of these in all."""
    r = ranked(df, [*keys, story], order, "_r")
    kept = r.where((F.col("_r") <= per_story) | (F.lit(False) if required is None else required))
    return top(kept.drop("_r"), keys, order, most, "rank")


def distribution(df: DataFrame, keys: Sequence[str], kinds: dict[str, Column]) -> DataFrame:
    """(keys, kind, name, n): how many rows each name of each kind has: regions, acts, tenths of the time."""
    both = None
    for kind, name in kinds.items():
        x = df.groupBy(*keys, name.cast("string").alias("name")).agg(F.count("*").alias("n")).select(*keys, F.lit(kind).alias("kind"), "name", "n")
        both = x if both is None else both.unionByName(x)
    return both


def same_sets(a: DataFrame, b: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(keys, same): whether both sides have the same ids."""
    both = a.select(*keys, *ids, F.lit(1).alias("_s")).unionByName(b.select(*keys, *ids, F.lit(2).alias("_s")))
    return both.groupBy(*keys, *ids).agg(F.count_distinct("_s").alias("_n")).groupBy(*keys).agg(F.bool_and(F.col("_n") == 2).alias("same"))
