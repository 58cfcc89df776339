"""Queries of joins (JOIN): equality, overlap, point, nearest, largest overlap, containers and exclusions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import vectors as V
from sceneql.operators import joins as J
from sceneql.operators import windows as W
from sceneql.plans import adapters as A
from sceneql.plans.registry import query


def _turn_spans(spark, sf_dir):
    """Order spans as speaker turns beside other order spans as scenes."""
    s = A.spans(spark, sf_dir)
    a = s.where("status <> 'F'").select("video_id", "span_id", "start_day", "end_day")
    b = s.where("status = 'F'").select("video_id", F.col("span_id").alias("turn_id"), "speaker", F.col("start_day").alias("ts"), F.col("end_day").alias("te"))
    return a, b


_AB = "WITH a AS (SELECT video_id, span_id, start_day, end_day FROM spans WHERE status <> 'F'), b AS (SELECT video_id, span_id AS turn_id, speaker, start_day AS ts, end_day AS te FROM spans WHERE status = 'F') "


@query("join_1_shots_features", A.sql("SELECT s.video_id, s.scene_id, coalesce(f.energy, 0e0) AS energy, coalesce(f.speech_ratio, 0e0) AS speech_ratio FROM shots s LEFT JOIN (SELECT * FROM shots WHERE event_type <> 'click') f ON s.video_id = f.video_id AND s.scene_id = f.scene_id", "shots"))
def shots_features(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    f = s.where("event_type <> 'click'").select("video_id", "scene_id", "energy", "speech_ratio")
    return s.select("video_id", "scene_id").join(f, ["video_id", "scene_id"], "left").fillna(0.0, ["energy", "speech_ratio"])


@query("join_2_keyframe_vectors", A.sql("SELECT k.kf_id, k.scene_id, round(list_sum(k.vec), 6) AS total FROM vectors k JOIN (SELECT vec_id FROM embeddings WHERE label < 5) m ON k.kf_id = m.vec_id", "vectors"))
def keyframe_vectors(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    return v.join(A.table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("kf_id")), "kf_id").select("kf_id", "scene_id", F.round(V.total("vec"), 6).alias("total"))


@query("join_3_prompt_similarity", A.sql("SELECT k.kf_id, p.kf_id AS prompt_id, round(list_dot_product(k.vec, p.vec), 6) AS similarity FROM vectors k, (SELECT * FROM vectors WHERE kf_id < 9) p WHERE k.kf_id >= 9", "vectors"))
def prompt_similarity(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id < 9").select(F.col("kf_id").alias("prompt_id"), F.col("vec").alias("pv"))
    # nine prompts: a fixed bank
    return v.where("kf_id >= 9").join(F.broadcast(p)).select("kf_id", "prompt_id", F.round(V.dot("vec", "pv"), 6).alias("similarity"))


@query("join_4_story_modes", A.sql("""
WITH m AS (SELECT video_id, story_id, CASE WHEN sum(speech_ratio * duration_seconds) / greatest(sum(duration_seconds), 0.001e0) >= 0.55e0 THEN 'dialogue' ELSE 'mixed' END AS mode FROM shots WHERE event_type <> 'error' GROUP BY ALL)
SELECT s.video_id, s.scene_id, coalesce(m.story_id, s.scene_id) AS story, coalesce(mode, 'unknown') AS mode FROM shots s LEFT JOIN m ON m.video_id = s.video_id AND m.story_id = s.story_id""", "shots"))
def story_modes(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    speech = F.sum(F.col("speech_ratio") * F.col("duration_seconds")) / F.greatest(F.sum("duration_seconds"), F.lit(0.001))
    m = s.where("event_type <> 'error'").groupBy("video_id", "story_id").agg(F.when(speech >= 0.55, "dialogue").otherwise("mixed").alias("mode")).withColumn("known", F.col("story_id"))
    return s.join(m, ["video_id", "story_id"], "left").select("video_id", "scene_id", F.coalesce("known", "scene_id").alias("story"), F.coalesce("mode", F.lit("unknown")).alias("mode"))


@query("join_5_interval_overlap", A.sql(_AB + "SELECT a.video_id, span_id, turn_id FROM a JOIN b ON a.video_id = b.video_id AND te > start_day AND ts < end_day", "spans"))
def interval_overlap(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    return J.overlap_join(a, b, ["video_id"], "start_day", "end_day", "ts", "te", 8.0).select("video_id", "span_id", "turn_id")


@query("join_6_clipped_overlap", A.sql(_AB + "SELECT a.video_id, span_id, turn_id, greatest(start_day, ts) AS lo, least(end_day, te) AS hi FROM a JOIN b ON a.video_id = b.video_id AND te > start_day AND ts < end_day", "spans"))
def clipped_overlap(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    return J.overlap_join(a, b, ["video_id"], "start_day", "end_day", "ts", "te", 8.0).select("video_id", "span_id", "turn_id", F.greatest("start_day", "ts").alias("lo"), F.least("end_day", "te").alias("hi"))


@query("join_7_minimum_overlap", A.sql(_AB + "SELECT a.video_id, span_id, turn_id FROM a JOIN b ON a.video_id = b.video_id AND least(end_day, te) - greatest(start_day, ts) > 2", "spans"))
def minimum_overlap(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    return J.overlap_join(a, b, ["video_id"], "start_day", "end_day", "ts", "te", 8.0, 2.0).select("video_id", "span_id", "turn_id")


@query("join_8_point_in_interval", A.sql("SELECT p.video_id, p.point_id, s.scene_id FROM (SELECT video_id, scene_id AS point_id, (start_seconds + end_seconds) / 2e0 + 1e0 AS at_ FROM shots) p JOIN shots s ON p.video_id = s.video_id AND at_ >= s.start_seconds AND at_ < s.end_seconds", "shots"))
def point_in_interval(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    p = s.select("video_id", F.col("scene_id").alias("point_id"), ((F.col("start_seconds") + F.col("end_seconds")) / 2 + 1.0).alias("at_"))
    return J.point_join(p, s.select("video_id", "scene_id", "start_seconds", "end_seconds"), ["video_id"], "at_", "start_seconds", "end_seconds", 30.0).select("video_id", "point_id", "scene_id")


@query("join_9_nearest", A.sql("""
WITH a AS (SELECT video_id, span_id, start_day + 0.5e0 AS at_ FROM spans WHERE status = 'F'), b AS (SELECT video_id, speaker, start_day, end_day FROM spans WHERE status <> 'F'),
r AS (SELECT a.video_id, span_id, speaker, greatest(0e0, start_day - at_, at_ - end_day) AS distance, start_day > at_ AS later, start_day, end_day FROM a JOIN b ON a.video_id = b.video_id),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id, span_id ORDER BY distance, later, CASE WHEN later THEN start_day ELSE -end_day END, CASE WHEN later THEN end_day ELSE start_day END, CASE WHEN later THEN speaker ELSE -speaker END) AS k FROM r)
SELECT video_id, span_id, speaker, distance FROM o WHERE k = 1""", "spans"))
def nearest(spark, sf_dir):
    s = A.spans(spark, sf_dir)
    a = s.where("status = 'F'").select("video_id", "span_id", (F.col("start_day") + F.lit(0.5)).alias("at_"))
    return J.nearest(a, s.where("status <> 'F'"), ["video_id"], "span_id", "at_", "start_day", "end_day", "speaker").where("distance is not null")


@query("join_10_nearest_start", A.sql("""
WITH r AS (SELECT a.video_id, a.span_id, b.span_id AS near_id, row_number() OVER (PARTITION BY a.video_id, a.span_id ORDER BY abs(b.start_day - a.start_day), b.start_day, b.span_id) AS k FROM (SELECT * FROM spans WHERE status = 'F') a JOIN (SELECT * FROM spans WHERE status <> 'F') b ON a.video_id = b.video_id)
SELECT r.video_id, r.span_id, s.start_day AS near FROM r JOIN spans s ON s.span_id = near_id WHERE k = 1""", "spans"))
def nearest_start(spark, sf_dir):
    from sceneql.operators import intervals as I

    s = A.spans(spark, sf_dir)
    q = I.snap(s.where("status = 'F'").select("video_id", "span_id", "start_day"), s.where("status <> 'F'"), ["video_id"], "start_day", "start_day", "near")
    return q.where("near is not null").select("video_id", "span_id", F.col("near").cast("long").alias("near"))


@query("join_11_largest_overlap", A.sql(_AB + ", s AS (SELECT a.video_id, span_id, speaker, sum(least(end_day, te) - greatest(start_day, ts)) AS d, min((ts, te)) AS f FROM a JOIN b ON a.video_id = b.video_id AND te > start_day AND ts < end_day GROUP BY ALL) SELECT video_id, span_id, speaker, d::BIGINT AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY video_id, span_id ORDER BY d DESC, f, speaker) AS r FROM s) WHERE r = 1", "spans"))
def largest_overlap(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    return J.largest_overlap(a, b, ["video_id"], "span_id", "start_day", "end_day", "ts", "te", "speaker", 8.0)


@query("join_12_smallest_container", A.sql(_AB + ", m AS (SELECT video_id, span_id, (start_day + end_day) / 2e0 AS at_ FROM a) SELECT video_id, span_id, speaker FROM (SELECT m.video_id, span_id, speaker, row_number() OVER (PARTITION BY m.video_id, span_id ORDER BY te - ts, ts, speaker) AS r FROM m JOIN b ON m.video_id = b.video_id AND at_ >= ts AND at_ <= te) WHERE r = 1", "spans"))
def smallest_container(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    p = a.select("video_id", "span_id", ((F.col("start_day") + F.col("end_day")) / 2).alias("at_"))
    return J.smallest_container(p, b, ["video_id"], "span_id", "at_", "ts", "te", "speaker", 8.0)


@query("join_13_segment_speakers", A.sql(_AB + "SELECT a.video_id, span_id, string_agg(DISTINCT speaker::VARCHAR, ',' ORDER BY speaker::VARCHAR) AS speakers FROM a JOIN b ON a.video_id = b.video_id AND te > start_day AND ts < end_day GROUP BY ALL", "spans"))
def segment_speakers(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    b = b.withColumn("speaker", F.col("speaker").cast("string"))
    return J.met(a, b, ["video_id"], "span_id", "start_day", "end_day", "ts", "te", "speaker", 8.0, "speakers").withColumn("speakers", F.concat_ws(",", "speakers"))


@query("join_14_recommendation_floor", A.sql("SELECT s.video_id, s.scene_id, coalesce(r.p, 0.15e0) AS priority FROM shots s LEFT JOIN (SELECT video_id, scene_id, emotion AS p FROM shots WHERE event_type = 'purchase') r USING (video_id, scene_id)", "shots"))
def recommendation_floor(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    r = s.where("event_type = 'purchase'").select("video_id", "scene_id", F.col("emotion").alias("priority"))
    return s.select("video_id", "scene_id").join(r, ["video_id", "scene_id"], "left").fillna(0.15, ["priority"])


@query("join_15_zip_rows", A.sql("SELECT a.video_id, a.scene_id, a.energy, b.emotion FROM shots a JOIN shots b USING (video_id, scene_id)", "shots"))
def zip_rows(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    return s.select("video_id", "scene_id", "energy").join(s.select("video_id", "scene_id", "emotion"), ["video_id", "scene_id"])


@query("join_16_semi_anti", A.sql("SELECT video_id, scene_id FROM shots s WHERE EXISTS (SELECT 1 FROM shots r WHERE r.video_id = s.video_id AND r.scene_id = s.scene_id AND r.action_score >= 0.5e0) AND NOT EXISTS (SELECT 1 FROM shots x WHERE x.video_id = s.video_id AND x.scene_id = s.scene_id AND x.credit_probability >= 0.65e0)", "shots"))
def semi_anti(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    required, excluded = s.where("action_score >= 0.5").select("video_id", "scene_id"), s.where("credit_probability >= 0.65").select("video_id", "scene_id")
    return s.select("video_id", "scene_id").join(required, ["video_id", "scene_id"], "left_semi").join(excluded, ["video_id", "scene_id"], "left_anti")


@query("join_17_outside_occupied", A.sql(_AB + "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.video_id = a.video_id AND a.start_day <= te + 2 AND a.end_day >= ts - 2)", "spans"))
def outside_occupied(spark, sf_dir):
    a, b = _turn_spans(spark, sf_dir)
    return J.outside(a.withColumn("_row", F.col("span_id")), b, ["video_id"], "start_day", "end_day", "ts", "te", 2.0, 16.0)


@query("join_18_catalog_match", A.sql("""
WITH c AS (SELECT video_id, 'film' || video_id AS alias, max(end_seconds) AS length FROM shots GROUP BY video_id), s AS (SELECT user_id AS video_id, count(*) AS n FROM events GROUP BY user_id),
f AS (SELECT video_id::VARCHAR AS stem, max(end_seconds) * (1e0 + (video_id % 5) / 100e0) AS duration FROM shots GROUP BY video_id UNION ALL SELECT 'film' || user_id, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 FROM events GROUP BY user_id),
m AS (SELECT video_id, stem, duration, k FROM (SELECT video_id, length, unnest([1, 2]) AS k, unnest([video_id::VARCHAR, alias]) AS stem FROM c) JOIN f USING (stem) WHERE abs(duration - length) <= greatest(8e0, 0.03e0 * length))
SELECT video_id, stem, round(duration, 6) AS duration FROM m QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k, duration) = 1""", "shots"))
def catalog_match(spark, sf_dir):
    # files named by id are up to 4 % longer than the catalog says; those named by alias are as long as the events span
    c = A.shots(spark, sf_dir).groupBy("video_id").agg(F.max("end_seconds").alias("length")).withColumn("alias", F.concat(F.lit("film"), "video_id"))
    by_id = c.select(F.col("video_id").cast("string").alias("stem"), (F.col("length") * (1.0 + (F.col("video_id") % 5) / 100.0)).alias("duration"))
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(3.6e9)
    by_alias = A.table(spark, sf_dir, "events").groupBy("user_id").agg(span.alias("duration")).select(F.concat(F.lit("film"), "user_id").alias("stem"), "duration")
    return J.catalog_match(c, by_id.unionByName(by_alias)).withColumn("duration", F.round("duration", 6))


@query("join_19_neighbours", A.sql("WITH n AS (SELECT video_id, scene_id, lag(scene_id) OVER w AS p, lead(scene_id) OVER w AS q, event_type FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)) SELECT DISTINCT video_id, unnest([p, q]) AS scene_id FROM n WHERE event_type = 'signup'", "shots"))
def neighbours(spark, sf_dir):
    w = W.by_scene()
    n = A.shots(spark, sf_dir).select("video_id", "event_type", F.lag("scene_id").over(w).alias("p"), F.lead("scene_id").over(w).alias("q"))
    return n.where("event_type = 'signup'").select("video_id", F.explode(F.array("p", "q")).alias("scene_id")).distinct()


@query("join_20_all_pairs", A.sql("SELECT a.kf_id, count(*) AS n, round(max(list_dot_product(a.vec, b.vec)), 6) AS best FROM vectors a JOIN vectors b ON a.video_id = b.video_id AND a.kf_id <> b.kf_id GROUP BY ALL", "vectors"))
def all_pairs(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    a, b = v.select("video_id", "kf_id", "vec"), v.select("video_id", F.col("kf_id").alias("other"), F.col("vec").alias("ov"))
    return a.join(b, "video_id").where("kf_id <> other").groupBy("kf_id").agg(F.count("*").alias("n"), F.round(F.max(V.dot("vec", "ov")), 6).alias("best"))


@query("join_21_speaker_pairs", A.sql("""
WITH s AS (SELECT DISTINCT video_id, speaker FROM spans), o AS (SELECT a.video_id, a.speaker AS l, b.speaker AS r, count(*) AS n FROM spans a JOIN spans b ON a.video_id = b.video_id AND a.speaker < b.speaker AND a.end_day > b.start_day AND a.start_day < b.end_day GROUP BY ALL)
SELECT x.video_id, x.speaker AS l, y.speaker AS r, coalesce(o.n, 0)::BIGINT AS overlaps FROM s x JOIN s y ON x.video_id = y.video_id AND x.speaker < y.speaker LEFT JOIN o ON o.video_id = x.video_id AND o.l = x.speaker AND o.r = y.speaker""", "spans"))
def speaker_pairs(spark, sf_dir):
    """Every pair of a video's speakers and how often they speak at the same time; pairs without are free to be one person."""
    s = A.spans(spark, sf_dir)
    who = s.select("video_id", F.col("speaker").alias("l")).distinct()
    pairs = who.join(who.withColumnRenamed("l", "r"), "video_id").where("l < r")  # seven speakers a video
    a = s.select("video_id", F.col("speaker").alias("l"), F.col("start_day").alias("ls"), F.col("end_day").alias("le"))
    b = s.select("video_id", F.col("speaker").alias("r"), F.col("start_day").alias("rs"), F.col("end_day").alias("re"))
    met = J.overlap_join(a, b, ["video_id"], "ls", "le", "rs", "re", 8.0).where("l < r").groupBy("video_id", "l", "r").agg(F.count("*").alias("n"))
    return pairs.join(met, ["video_id", "l", "r"], "left").select("video_id", "l", "r", F.coalesce("n", F.lit(0)).alias("overlaps"))


@query("join_22_overlay_captions", A.sql("SELECT s.video_id, s.scene_id, coalesce(c.event_type, 'none') AS caption FROM shots s LEFT JOIN (SELECT video_id, scene_id, event_type FROM shots WHERE event_type = 'view') c USING (video_id, scene_id)", "shots"))
def overlay_captions(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    c = s.where("event_type = 'view'").select("video_id", "scene_id", F.col("event_type").alias("caption"))
    return s.select("video_id", "scene_id").join(c, ["video_id", "scene_id"], "left").fillna("none", ["caption"])


@query("join_23_mask_intersection", A.sql("WITH a AS (SELECT video_id, unnest(range(start_day, end_day)) AS f FROM spans WHERE speaker = 0), b AS (SELECT video_id, unnest(range(start_day, end_day)) AS f FROM spans WHERE speaker = 1) SELECT video_id, count(*) AS n FROM (SELECT DISTINCT * FROM a) JOIN (SELECT DISTINCT * FROM b) USING (video_id, f) GROUP BY video_id", "spans"))
def mask_intersection(spark, sf_dir):
    s = A.spans(spark, sf_dir)

    def mask(k):
        return s.where(f"speaker = {k}").select("video_id", F.explode(F.sequence("start_day", F.col("end_day") - 1)).alias("f")).distinct()

    return mask(0).join(mask(1), ["video_id", "f"]).groupBy("video_id").agg(F.count("*").alias("n"))
