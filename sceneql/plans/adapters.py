"""The engine's logical tables built from the star-schema test tables, for Spark and, as CTEs, for the SQL oracle.

Signals are small integer remainders over constants, and times whole milliseconds, so both engines get equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (name, SQL) in order of use; {diff} and {words} are written for each engine. One hour of events counts as a second.
_SHOTS = """
SELECT video_id, scene_id, start_ms / 1e3 AS start_seconds, end_ms / 1e3 AS end_seconds, (end_ms - start_ms) / 1e3 AS duration_seconds, event_type, cents,
  (cents % 101) / 100e0 AS action_score, (cents % 89) / 88e0 AS dialogue_score, (cents % 97) / 96e0 AS narrative_score, (cents % 61) / 60e0 AS speech_ratio,
  (cents % 53) / 52e0 AS energy, (cents % 47) / 46e0 AS onset, (cents % 43) / 42e0 AS emotion, (cents % 37) / 36e0 AS credit_probability, (cents % 29) / 5e0 AS density,
  (cents % 101) / 300e0 + 0.1e0 AS clip_action, (cents % 89) / 300e0 + 0.1e0 AS clip_dialogue,
  CAST(floor((scene_id - 1) / 4e0) AS BIGINT) AS story_id, max(end_ms) OVER (PARTITION BY video_id) / 1e3 AS video_duration, count(*) OVER (PARTITION BY video_id) AS n_shots
FROM (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY scene_id), start_ms + 5000) AS end_ms FROM (
  SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS scene_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
    CAST(floor({diff} / 3600000e0) AS BIGINT) AS start_ms FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events) e0) e1) e2
"""
_TURNS = """
SELECT conv_id AS video_id, turn, role AS speaker, text, ws, 400 * before + 1000 * rank AS start_ms, 400 * (before + n) + 1000 * rank AS end_ms,
  (400 * before + 1000 * rank) / 1e3 AS start_seconds, (400 * (before + n) + 1000 * rank) / 1e3 AS end_seconds
FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS rank
  FROM (SELECT conv_id, turn, role, text, {words} AS ws, CAST({size}({words}) AS BIGINT) AS n FROM conversations) c0) c1
"""
_ITEMS = """
SELECT l_orderkey AS video_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS ord,
  l_quantity AS duration, l_extendedprice AS value, l_discount AS discount, l_returnflag AS flag FROM lineitem
"""
_SPANS = """
SELECT o_custkey % 50 AS video_id, o_orderkey AS span_id, o_custkey % 7 AS speaker, CAST({days} AS BIGINT) AS start_day, CAST({days} AS BIGINT) + 1 + o_orderkey % 5 AS end_day, o_totalprice AS price, o_orderstatus AS status FROM orders
"""


def _spark_diff() -> str:
    return "timestampdiff(MICROSECOND, t0, ts)"


_SPARK = {"diff": _spark_diff(), "words": "split(trim(regexp_replace(text, '[ \\\\t\\\\n\\\\r]+', ' ')), ' ')", "size": "size", "days": "datediff(to_date(o_orderdate), date'1992-01-01')"}
_DUCK = {"diff": "date_diff('microsecond', t0, ts)", "words": "string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')", "size": "len", "days": "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"}
_TABLES = {"shots": (_SHOTS, "events"), "turns": (_TURNS, "conversations"), "items": (_ITEMS, "lineitem"), "spans": (_SPANS, "orders")}

#: Characters of conversations in a partition whose words are listed.
TEXT = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    sql, source = _TABLES[name]
    return spark.sql(sql.format(**_SPARK).replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: table(spark, sf_dir, source) if rows is None else rows})


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "shots")


def films(spark: SparkSession, sf_dir: str, videos: int = 37) -> DataFrame:
    """shots with `videos` of them one after the other as one film: some 2 500 shots each."""
    s = shots(spark, sf_dir)
    ends = s.select("video_id", "video_duration").distinct().withColumn("film", F.expr(f"video_id div {videos}"))
    ahead = Window.partitionBy("film").orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("video_duration").over(ahead), F.lit(0.0))).withColumn("_all", F.sum("video_duration").over(Window.partitionBy("film"))).drop("video_duration")
    d = s.join(ends, "video_id").withColumn("start_seconds", F.round(F.col("start_seconds") + F.col("_before"), 3)).withColumn("end_seconds", F.round(F.col("end_seconds") + F.col("_before"), 3))
    order = Window.partitionBy("film").orderBy("start_seconds", "video_id", "scene_id")
    d = d.withColumn("story_id", F.col("video_id") * 100_000 + F.col("story_id")).withColumn("scene_id", F.row_number().over(order).cast("long"))
    return d.withColumn("video_duration", F.col("_all")).drop("video_id", "_before", "_all").withColumnRenamed("film", "video_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "turns").drop("ws")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, turn, speaker, i, word, start_seconds, end_seconds): four tenths of a second a word.

    Words are many times the size of their texts in a task's memory, so that the texts' partitions are as many as they are long.
    """
    told = table(spark, sf_dir, "conversations")
    parts = (told.agg(F.sum(F.length("text"))).first()[0] or 0) // TEXT
    d = _made(spark, sf_dir, "turns", told.repartition(parts, "conv_id") if parts > 1 else told).select("video_id", "turn", "speaker", "start_ms", F.posexplode("ws").alias("i", "word"))
    ms = F.col("start_ms") + 400 * F.col("i")
    return d.select("video_id", "turn", "speaker", F.col("i").cast("long").alias("i"), "word", (ms / F.lit(1e3)).alias("start_seconds"), ((ms + 350) / F.lit(1e3)).alias("end_seconds"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "items")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "spans")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kf_id, scene_id, video_id, label, vec): three keyframes a scene, thirty scenes a video."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("kf_id"), F.expr("vec_id div 3").alias("scene_id"), F.expr("vec_id div 90").alias("video_id"), "label", F.col("embedding").alias("vec"))


_WORDS = """
SELECT video_id, turn, speaker, i, word, (start_ms + 400 * i) / 1e3 AS start_seconds, (start_ms + 400 * i + 350) / 1e3 AS end_seconds
FROM (SELECT video_id, turn, speaker, start_ms, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS BIGINT) AS i FROM turns) w0
"""
_VECTORS = "SELECT vec_id AS kf_id, vec_id // 3 AS scene_id, vec_id // 90 AS video_id, label, embedding::DOUBLE[] AS vec FROM embeddings"


def sql(text: str, *names: str) -> str:
    """DuckDB SQL that begins with the CTEs of the named tables."""
    made = {k: v[0].format(**_DUCK) for k, v in _TABLES.items()} | {"words": _WORDS, "vectors": _VECTORS}
    if "words" in names and "turns" not in names:
        names = ("turns", *names)
    text = text.strip()
    head = ", ".join(f"{n} AS ({made[n].strip()})" for n in names)
    if not head:
        return text
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {text[15:]}"
    return f"WITH {head}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {head} {text}"
