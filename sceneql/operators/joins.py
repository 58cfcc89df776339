"""Interval joins that keep an equality key: overlap, point in interval, nearest, largest overlap, smallest container."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, start: str, end: str, width: float, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ls: str, le: str, rs: str, re: str, width: float, least: float = 0.0) -> DataFrame:
    """Pairs of rows with one key whose intervals overlap by more than `least`.

    Both sides are spread over buckets of `width` and joined on (keys, bucket), which is a shuffle join with a plain
    equality; a pair counts only in the later of its two first buckets, so it comes out once. Column names must differ
    but for the keys.
    """
    a = _buckets(left, ls, le, width, "_k").withColumn("_a", F.floor(F.col(ls) / width))
    b = _buckets(right, rs, re, width, "_k").withColumn("_b", F.floor(F.col(rs) / width))
    both = a.join(b, [*keys, "_k"]).where(F.col("_k") == F.greatest("_a", "_b"))
    return both.where(F.least(le, re) - F.greatest(ls, rs) > least).drop("_k", "_a", "_b")


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the intervals [start, end) that hold them."""
    a = points.withColumn("_k", F.floor(F.col(at) / width))
    b = _buckets(spans, start, end, width, "_k")
    return a.join(b, [*keys, "_k"], how).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_k")


def _shapes(left: DataFrame, keys: Sequence[str], row: str, ls: str, le: str) -> tuple[DataFrame, DataFrame]:
    """((keys, row, _shape), (keys, _shape, ls, le)): each row's intervals, and once each the ones that differ. What rows meet depends on
    these alone, so that many rows at equal times are joined as one."""
    rows = left.groupBy(*keys, row).agg(F.array_sort(F.collect_list(F.struct(ls, le))).alias("_shape"))
    once = rows.select(*keys, "_shape").distinct().select(*keys, "_shape", F.explode("_shape").alias("_at"))
    return rows, once.select(*keys, "_shape", F.col(f"_at.{ls}").alias(ls), F.col(f"_at.{le}").alias(le))


def largest_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, ls: str, le: str, rs: str, re: str, who: str, width: float) -> DataFrame:
    """(keys, row, who, seconds): for each left row the `who` with the greatest sum of overlaps; on ties the one that starts first.

    Equal intervals are joined once, with their number.
    """
    rows, once = _shapes(left, keys, row, ls, le)
    pairs = overlap_join(once, right.groupBy(*keys, who, rs, re).agg(F.count("*").alias("_n")), keys, ls, le, rs, re, width)
    sums = pairs.groupBy(*keys, "_shape", who).agg(F.sum(F.col("_n") * (F.least(le, re) - F.greatest(ls, rs))).alias("seconds"), F.min(F.struct(rs, re)).alias("_first"))
    w = Window.partitionBy(*keys, "_shape").orderBy(F.desc("seconds"), "_first", who)
    best = sums.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return rows.join(best, [*keys, "_shape"]).select(*keys, row, who, "seconds")


def met(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, ls: str, le: str, rs: str, re: str, who: str, width: float, out: str) -> DataFrame:
    """(keys, row, out): for each left row the distinct `who` of the intervals that it overlaps, in order. Equal intervals are joined once."""
    rows, once = _shapes(left, keys, row, ls, le)
    pairs = overlap_join(once, right.select(*keys, who, rs, re).distinct(), keys, ls, le, rs, re, width)
    return rows.join(pairs.groupBy(*keys, "_shape").agg(F.array_sort(F.collect_set(who)).alias(out)), [*keys, "_shape"]).select(*keys, row, out)


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, at: str, start: str, end: str, who: str) -> DataFrame:
    """(keys, row, who, distance): for each point the interval with the nearest edge, 0 inside; on ties the one that starts before
    the point, of several of these the one that ends last.

    As-of in both directions: a key's intervals and points are ordered together, and the candidates are the farthest end
    so far and the next start, two window functions instead of a product.
    """
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(row).alias("_row"), F.lit(None).cast(right.schema[who].dataType).alias("_who"), F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_e"))
    b = right.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema[row].dataType).alias("_row"), F.col(who).alias("_who"), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"))
    both = a.unionByName(b)
    past = Window.partitionBy(*keys).orderBy("_at", "_side", "_e").rowsBetween(Window.unboundedPreceding, 0)
    # what lies ahead is what comes before in the opposite order: a frame that grows row by row, not one that is summed anew
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_side"), F.desc("_e")).rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("_p", F.max(F.when(F.col("_side") == 0, F.struct(F.col("_e").alias("e"), (-F.col("_s")).alias("s"), F.col("_who").alias("w")))).over(past))
    d = d.withColumn("_n", F.min(F.when(F.col("_side") == 0, F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("_who").alias("w")))).over(ahead)).where("_side = 1")
    before = F.when(F.col("_p").isNotNull(), F.greatest(F.lit(0.0), F.col("_at") - F.col("_p.e")))
    after = F.col("_n.s") - F.col("_at")
    first = F.col("_n").isNull() | (F.col("_p").isNotNull() & (before <= after))
    return d.select(*keys, F.col("_row").alias(row), F.when(first, F.col("_p.w")).otherwise(F.col("_n.w")).alias(who), F.when(first, before).otherwise(after).alias("distance"))


def smallest_container(points: DataFrame, spans: DataFrame, keys: Sequence[str], row: str, at: str, start: str, end: str, who: str, width: float) -> DataFrame:
    """(keys, row, who): for each point the `who` of the narrowest closed interval that holds it. Equal points and intervals meet once."""
    a = points.select(*keys, at).distinct().withColumn("_k", F.floor(F.col(at) / width))
    b = _buckets(spans.groupBy(*keys, start, end).agg(F.min(F.struct(who)).alias("_who")), start, end, width, "_k")
    held = a.join(b, [*keys, "_k"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    best = held.groupBy(*keys, at).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("_long"), F.col(start), F.col("_who"))).alias("_best"))
    return points.select(*keys, row, at).join(best, [*keys, at]).groupBy(*keys, row).agg(F.min("_best").alias("_best")).select(*keys, row, F.col(f"_best._who.{who}").alias(who))


def outside(left: DataFrame, taken: DataFrame, keys: Sequence[str], ls: str, le: str, rs: str, re: str, gap: float, width: float) -> DataFrame:
    """Left rows that keep more than `gap` away from every taken interval of their key: an anti-join on (keys, bucket)."""
    a = left.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in left.columns else left
    wide = taken.select(*keys, (F.col(rs) - gap).alias("_rs"), (F.col(re) + gap).alias("_re"))
    near = _buckets(a.select(*keys, *[F.col(c) for c in dict.fromkeys((ls, le))], "_row"), ls, le, width, "_k").join(_buckets(wide, "_rs", "_re", width, "_k"), [*keys, "_k"])
    near = near.where((F.col(ls) <= F.col("_re")) & (F.col(le) >= F.col("_rs"))).select("_row").distinct()
    return a.join(near, "_row", "left_anti").drop("_row")


def catalog_match(catalog: DataFrame, files: DataFrame, slack: float = 8.0, share: float = 0.03) -> DataFrame:
    """(video_id, stem, duration): the file of each catalog row, by its id or else by its alias.

    A file of another length than the catalog's, by more than 8 s and 3 %, isn't it. catalog: video_id, alias, length; files:
    stem, duration.
    """
    names = catalog.select("video_id", "length", F.posexplode(F.array(F.col("video_id").cast("string"), F.col("alias").cast("string"))).alias("_rank", "stem")).where("stem is not null")
    fit = names.join(files.select("stem", "duration"), "stem").where(F.abs(F.col("duration") - F.col("length")) <= F.greatest(F.lit(slack), share * F.col("length")))
    return fit.groupBy("video_id").agg(F.min_by(F.struct("stem", "duration"), F.struct("_rank", "duration")).alias("f")).select("video_id", "f.stem", "f.duration")
