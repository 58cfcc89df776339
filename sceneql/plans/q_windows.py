"""Queries of ordered functions (WIN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import vectors as V
from sceneql.operators import joins as J
from sceneql.operators import windows as W
from sceneql.plans import adapters as A
from sceneql.plans.registry import query

_W = "WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)"


@query("win_1_temporal_smoothing", A.sql(f"SELECT video_id, scene_id, round(0.20e0 * coalesce(lag(action_score) OVER w, action_score) + 0.60e0 * action_score + 0.20e0 * coalesce(lead(action_score) OVER w, action_score), 4) AS smoothed FROM shots {_W}", "shots"))
def temporal_smoothing(spark, sf_dir):
    return W.smooth(A.shots(spark, sf_dir), "action_score", "smoothed").select("video_id", "scene_id", "smoothed")


@query("win_2_stable_percentile", A.sql("SELECT video_id, scene_id, CASE WHEN n_shots > 1 THEN (row_number() OVER (PARTITION BY video_id ORDER BY energy, scene_id) - 1)::DOUBLE / (n_shots - 1) ELSE 0e0 END AS p FROM shots", "shots"))
def stable_percentile(spark, sf_dir):
    return W.stable_percentile(A.shots(spark, sf_dir), "energy", "p").select("video_id", "scene_id", "p")


@query("win_3_emotion_peak", A.sql("WITH n AS (SELECT *, count(*) OVER w AS k, sum(emotion) OVER w AS s FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), c AS (SELECT *, abs(emotion - CASE WHEN k > 1 THEN (s - emotion) / (k - 1) ELSE 0e0 END) / 2e0 AS chg FROM n) SELECT video_id, scene_id, round(chg, 7) AS emotion_change, round(least(1e0, 0.45e0 * emotion + 0.35e0 * chg + 0.20e0 * onset) * energy, 7) AS emotion_peak FROM c", "shots"))
def emotion_peak(spark, sf_dir):
    return W.emotion_peak(A.shots(spark, sf_dir), "emotion", "energy", "onset").select("video_id", "scene_id", F.round("emotion_change", 7).alias("emotion_change"), F.round("emotion_peak", 7).alias("emotion_peak"))


@query("win_4_boundary_features", A.sql(r"""
WITH s AS (SELECT *, [energy, onset, emotion, clip_action] AS vec FROM shots),
d AS (SELECT s.video_id, s.scene_id, unnest(regexp_extract_all(lower(t.text), '[\p{L}\p{N}_]+')) AS token FROM s JOIN turns t ON t.video_id = s.video_id AND t.start_seconds >= s.start_seconds AND t.start_seconds < s.end_seconds),
tf AS (SELECT video_id, scene_id, token, 1 + ln(count(*)) AS tf FROM d GROUP BY ALL), df AS (SELECT video_id, token, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT video_id, count(*) AS n FROM s GROUP BY video_id),
w AS (SELECT video_id, scene_id, token, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (video_id, token) JOIN n USING (video_id)),
v AS (SELECT video_id, scene_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY video_id, scene_id)) AS w FROM w),
p AS (SELECT *, lead(scene_id) OVER o AS nxt, lead(vec) OVER o AS nv, lead(speech_ratio) OVER o AS ns, greatest(0e0, lead(start_seconds) OVER o - end_seconds) AS gap FROM s WINDOW o AS (PARTITION BY video_id ORDER BY start_seconds, scene_id)),
c AS (SELECT p.video_id, p.scene_id, sum(a.w * b.w) AS c FROM p JOIN v a ON a.video_id = p.video_id AND a.scene_id = p.scene_id JOIN v b ON b.video_id = p.video_id AND b.scene_id = nxt AND b.token = a.token GROUP BY ALL),
q AS (SELECT p.video_id, p.scene_id, nxt, gap, greatest(0e0, least(1e0, CASE WHEN list_sum(list_transform(vec, lambda x: x * x)) > 0e0 AND list_sum(list_transform(nv, lambda x: x * x)) > 0e0 THEN list_cosine_similarity(vec, nv) ELSE 0e0 END)) AS visual, least(1e0, coalesce(c, 0e0)) AS txt, 1e0 - least(abs(speech_ratio - ns), 1e0) AS speech, greatest(0e0, 1e0 - gap / 2e0) AS temporal FROM p LEFT JOIN c ON c.video_id = p.video_id AND c.scene_id = p.scene_id WHERE nxt IS NOT NULL)
SELECT video_id, scene_id AS left_id, nxt AS right_id, round(gap, 6) AS gap, round(visual, 6) AS visual, round(txt, 6) AS text, round(speech, 6) AS speech, round(temporal, 6) AS temporal, round(0.52e0 * visual + 0.28e0 * txt + 0.12e0 * speech + 0.08e0 * temporal, 6) AS continuity FROM q""", "shots", "turns"))
def boundary_features(spark, sf_dir):
    from sceneql.functions import text as T
    from sceneql.operators import joins as J
    from sceneql.operators import retrieval as R

    s = A.shots(spark, sf_dir).withColumn("vec", F.array("energy", "onset", "emotion", "clip_action"))
    said = J.point_join(A.turns(spark, sf_dir).select("video_id", "text", F.col("start_seconds").alias("_at")), s.select("video_id", "scene_id", "start_seconds", "end_seconds"), ["video_id"], "_at", "start_seconds", "end_seconds", 30.0)
    texts = s.select("video_id", "scene_id").join(said.groupBy("video_id", "scene_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")), ["video_id", "scene_id"], "left")
    weights = R.tfidf(texts, "scene_id", T.tokens("text"), ["video_id"])
    got = W.boundaries(s, "vec", weights)
    return got.select("video_id", "left_id", "right_id", *[F.round(c, 6).alias(c) for c in ("gap", "visual", "text", "speech", "temporal", "continuity")])


@query("win_5_position_ratio", A.sql("SELECT video_id, scene_id, scene_id::DOUBLE / n_shots AS position FROM shots", "shots"))
def position_ratio(spark, sf_dir):
    w = Window.partitionBy("video_id")
    return A.shots(spark, sf_dir).select("video_id", "scene_id", (F.row_number().over(w.orderBy("scene_id")) / F.count("*").over(w)).alias("position"))


@query("win_6_glitch_fix", A.sql(f"SELECT video_id, scene_id, CASE WHEN lag(event_type) OVER w = lead(event_type) OVER w AND event_type <> lag(event_type) OVER w AND duration_seconds <= 2e0 THEN lag(event_type) OVER w ELSE event_type END AS fixed FROM shots {_W}", "shots"))
def glitch_fix(spark, sf_dir):
    w = W.by_scene()
    before, after = F.lag("event_type").over(w), F.lead("event_type").over(w)
    fixed = F.when((before == after) & (F.col("event_type") != before) & (F.col("duration_seconds") <= 2), before).otherwise(F.col("event_type"))
    return A.shots(spark, sf_dir).select("video_id", "scene_id", fixed.alias("fixed"))


@query("win_7_context_text", A.sql(f"SELECT video_id, scene_id, concat_ws(' ', lag(event_type) OVER w, lead(event_type) OVER w) AS context FROM shots {_W}", "shots"))
def context_text(spark, sf_dir):
    return W.neighbours(A.shots(spark, sf_dir), "event_type", ["video_id"], ["scene_id"], " ", "context").select("video_id", "scene_id", "context")


@query("win_8_event_structure", A.sql("WITH c AS (SELECT *, lag(action_score) OVER w AS p, lead(action_score) OVER w AS q, lag(story_id) OVER w AS ps, lead(story_id) OVER w AS qs FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)) SELECT video_id, scene_id, round(CASE WHEN p IS NULL AND q IS NULL THEN 0.35e0 ELSE least(1e0, 0.20e0 + 0.58e0 * greatest(coalesce(abs(action_score - p), 0e0), coalesce(abs(action_score - q), 0e0)) + 0.22e0 * CASE WHEN coalesce(ps, -1) <> story_id OR coalesce(qs, -1) <> story_id THEN 1e0 ELSE 0e0 END) END, 6) AS structure FROM c", "shots"))
def event_structure(spark, sf_dir):
    w = W.by_scene()
    p, q = F.lag("action_score").over(w), F.lead("action_score").over(w)
    ps, qs = F.coalesce(F.lag("story_id").over(w), F.lit(-1)), F.coalesce(F.lead("story_id").over(w), F.lit(-1))
    change = F.greatest(F.coalesce(F.abs(F.col("action_score") - p), F.lit(0.0)), F.coalesce(F.abs(F.col("action_score") - q), F.lit(0.0)))
    edge = F.when((ps != F.col("story_id")) | (qs != F.col("story_id")), 1.0).otherwise(0.0)
    s = F.when(p.isNull() & q.isNull(), 0.35).otherwise(F.least(F.lit(1.0), 0.20 + 0.58 * change + 0.22 * edge))
    return A.shots(spark, sf_dir).select("video_id", "scene_id", F.round(s, 6).alias("structure"))


@query("win_9_context_frames", A.sql("SELECT video_id, scene_id, array_to_string(list(scene_id) OVER (PARTITION BY video_id ORDER BY scene_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ',') AS frames FROM shots", "shots"))
def context_frames(spark, sf_dir):
    w = W.by_scene().rowsBetween(-1, 1)
    return A.shots(spark, sf_dir).select("video_id", "scene_id", F.concat_ws(",", F.collect_list(F.col("scene_id").cast("string")).over(w)).alias("frames"))


@query("win_10_sustained_cluster", A.sql("SELECT video_id, scene_id, count(*) OVER (PARTITION BY video_id ORDER BY round(start_seconds * 1e3)::BIGINT RANGE BETWEEN CURRENT ROW AND 30000 FOLLOWING) >= 3 AS sustained FROM shots WHERE action_score >= 0.45e0", "shots"))
def sustained_cluster(spark, sf_dir):
    return W.sustained(A.shots(spark, sf_dir).where("action_score >= 0.45"), "start_seconds", 30.0, 3, "sustained").select("video_id", "scene_id", "sustained")


@query("win_11_forward_payoff", A.sql("SELECT a.video_id, a.scene_id, arg_max(b.scene_id, (b.emotion, -b.scene_id)) AS payoff FROM shots a JOIN shots b ON a.video_id = b.video_id AND b.scene_id > a.scene_id AND b.start_seconds <= a.end_seconds + 26e0 GROUP BY ALL", "shots"))
def forward_payoff(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    a = s.select("video_id", "scene_id", F.col("start_seconds").alias("lo"), (F.col("end_seconds") + 26.0).alias("hi"))
    b = s.select("video_id", F.col("scene_id").alias("other"), "emotion", F.col("start_seconds").alias("t"), F.col("start_seconds").alias("t2"))
    hits = J.overlap_join(a, b, ["video_id"], "lo", "hi", "t", "t2", 60.0, -1e-9).where("other > scene_id and t <= hi")
    return hits.groupBy("video_id", "scene_id").agg(F.max_by("other", F.struct(F.col("emotion"), -F.col("other"))).alias("payoff"))


@query("win_12_sliding_grid", A.sql("WITH g AS (SELECT video_id, unnest(range(0, (video_duration * 2)::BIGINT, 1)) / 2e0 AS a FROM (SELECT DISTINCT video_id, floor(video_duration) AS video_duration FROM shots)) SELECT g.video_id, a AS window_start, count(*) AS n FROM g JOIN shots s ON s.video_id = g.video_id AND s.start_seconds >= a AND s.start_seconds < a + 2e0 GROUP BY ALL", "shots"))
def sliding_grid(spark, sf_dir):
    # a point lies in the windows that begin within the two seconds up to it
    s = A.shots(spark, sf_dir).withColumn("most", F.floor("video_duration") * 2 - 1)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_seconds") - 2.0) * 2) + 1)
    last = F.least(F.floor(F.col("start_seconds") * 2), F.col("most"))
    e = s.where(first <= last).select("video_id", F.explode(F.sequence(first, last)).alias("k")).select("video_id", (F.col("k") / F.lit(2.0)).alias("window_start"))
    return e.groupBy("video_id", "window_start").agg(F.count("*").alias("n"))


@query("win_13_stride_sample", A.sql("SELECT video_id, scene_id FROM (SELECT *, greatest(1, ceil(n_shots / 10e0)::BIGINT) AS step FROM shots) WHERE (scene_id - 1) % step = 0", "shots"))
def stride_sample(spark, sf_dir):
    step = F.greatest(F.lit(1), F.ceil(F.col("n_shots") / 10))
    return A.shots(spark, sf_dir).where((F.col("scene_id") - 1) % step == 0).select("video_id", "scene_id")


@query("win_14_pseudo_cuts", A.sql(f"SELECT video_id, scene_id FROM (SELECT *, abs(action_score - lag(action_score) OVER w) AS d FROM shots {_W}) WHERE d >= 0.4e0", "shots"))
def pseudo_cuts(spark, sf_dir):
    return A.shots(spark, sf_dir).withColumn("d", F.abs(F.col("action_score") - F.lag("action_score").over(W.by_scene()))).where("d >= 0.4").select("video_id", "scene_id")


@query("win_15_average_precision", A.sql("WITH r AS (SELECT video_id, (emotion >= 0.7e0)::INT AS hit, row_number() OVER w AS k, sum((emotion >= 0.7e0)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id)) SELECT video_id, round(coalesce(sum(s::DOUBLE / k) FILTER (hit = 1) / nullif(sum(hit), 0), 0e0), 6) AS average_precision FROM r GROUP BY video_id", "shots"))
def average_precision(spark, sf_dir):
    d = W.average_precision(A.shots(spark, sf_dir), F.col("emotion") >= 0.7, [F.desc("narrative_score"), "scene_id"], ["video_id"])
    return d.select("video_id", F.round("average_precision", 6).alias("average_precision"))
