"""Mixing sources to target weights, by hash-random order and distributed prefix sums of word counts.

Every document gets a random key, the MD5 of its id. The keys' leading bits cut each source into ranges of about RANGE
documents, so a hot source is many ranges. Prefix sums run within ranges, then over the ranges' totals, and each source
is cut at its exact budget, after whole repeats. Texts are read once, for their sizes, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneql.llm.common import prepared, table

WEIGHTS, SHARE, MOST, RANGE = (3, 1, 2), 1.5, 2, 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(named, source, source_size, target) of sources with sizes: shares by weight, none above `most` times its size.

    What a source can't take goes to the others by weight until none is above: the level is found from sources in the
    order in which they fill up.
    """
    order = Window.orderBy(F.desc("named"), "source")
    s = sizes.groupBy("named", "source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("w"))
    fill = Window.orderBy("fills", F.desc("named"), "source")
    everything = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
    s = s.withColumn("line", F.max(F.when(F.col("fills") >= F.col("level"), F.col("level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("line") * F.col("w"), F.col("cap").cast("double")))
    return s.select("named", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, range_rows: int = RANGE, row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes.

    A null source is a source of its own, after the others; a null or empty text has size 0 and takes 0; a null id has
    the key of an empty one. Rows with one id are taken one after the other. row_col: a column that tells them apart and is
    kept. Other columns are ignored. An empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    source = F.col(source_col).cast("string")
    own = [row_col] if row_col else []
    d = docs.select(*own, F.col(id_col).alias("doc_id"), source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("source"), n_words(text_col).alias("size")).checkpoint()
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bits = max(0, (d.count() // range_rows).bit_length())
    d = d.withColumn("key", key).withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - min(bits, 32)))
    inside = Window.partitionBy("named", "source", "range").orderBy("key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    rows = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ahead = Window.partitionBy("named", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("named", "source", "range").agg(F.sum("size").alias("all")).withColumn("offset", F.coalesce(F.sum("all").over(ahead), F.lit(0))).drop("all")
    goal = targets(d, weights, share, most).withColumn("budget", F.floor("target").cast("long")).withColumn("epochs", F.expr("case when source_size > 0 then budget div source_size else 0L end"))
    offsets = offsets.join(goal, ["named", "source"])
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.join(offsets, ["named", "source", "range"]).select(*own, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(prepared(spark), sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS source,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
g AS (SELECT named, source, sum(size)::BIGINT AS source_size FROM d GROUP BY named, source),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY named DESC, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM g),
f AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS fills FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fills, named DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (ORDER BY fills, named DESC, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
t AS (SELECT named, source, source_size, least(cap::DOUBLE, coalesce((max(CASE WHEN fills >= level THEN level END) OVER ()) * w, cap::DOUBLE)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.named, d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.named = t.named AND d.source = t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
  + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken FROM r
"""
