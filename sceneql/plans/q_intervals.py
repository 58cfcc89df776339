"""Queries of interval and sequence algebra (IVL) over shots, turns and order spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneql.operators import intervals as I
from sceneql.plans import adapters as A
from sceneql.plans.registry import query

_ISLANDS = """
WITH f AS (SELECT *, max(end_day) OVER (PARTITION BY video_id ORDER BY start_day, end_day, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start_day - far > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_day, end_day, span_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
"""


@query("ivl_1_merge_overlapping", A.sql(_ISLANDS.format(gap=0) + " SELECT video_id, min(start_day) AS start_day, max(end_day) AS end_day, count(*) AS n FROM g GROUP BY video_id, island", "spans"))
def merge_overlapping(spark, sf_dir):
    return I.merge(A.spans(spark, sf_dir), ["video_id"], "start_day", "end_day", 0.0, ["span_id"])


@query("ivl_2_merge_with_gap", A.sql(_ISLANDS.format(gap=3) + " SELECT video_id, min(start_day) AS start_day, max(end_day) AS end_day, count(*) AS n, max(price) AS best, string_agg(DISTINCT speaker::VARCHAR, ',' ORDER BY speaker::VARCHAR) AS speakers FROM g GROUP BY video_id, island", "spans"))
def merge_with_gap(spark, sf_dir):
    more = [F.max("price").alias("best"), F.concat_ws(",", F.array_sort(F.collect_set(F.col("speaker").cast("string")))).alias("speakers")]
    return I.merge(A.spans(spark, sf_dir), ["video_id"], "start_day", "end_day", 3.0, ["span_id"], more)


@query("ivl_3_merged_duration", A.sql(_ISLANDS.format(gap=2) + ", m AS (SELECT video_id, max(end_day) - min(start_day) AS d FROM g GROUP BY video_id, island) SELECT video_id, round(sum(d)::DOUBLE, 6) AS seconds FROM m GROUP BY video_id", "spans"))
def merged_duration(spark, sf_dir):
    return I.merged_duration(A.spans(spark, sf_dir), ["video_id"], "start_day", "end_day", 2.0).withColumn("seconds", F.col("seconds").cast("double"))


_SAME = """
WITH f AS (SELECT *, lag({label}) OVER w AS pl, lag({e}) OVER w AS pe FROM {t} WINDOW w AS (PARTITION BY video_id ORDER BY {s}, {e}, {id})),
g AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> {label} OR {s} - pe > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY {s}, {e}, {id} ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT video_id, {label}, min({s}) AS {s}, max({e}) AS {e}, count(*) AS n FROM g GROUP BY video_id, {label}, run
"""


@query("ivl_4_merge_same_speaker", A.sql(_SAME.format(label="event_type", t="shots", s="start_seconds", e="end_seconds", id="scene_id", gap="0.08e0"), "shots"))
def merge_same_speaker(spark, sf_dir):
    return I.merge_same(A.shots(spark, sf_dir), ["video_id"], "event_type", "start_seconds", "end_seconds", 0.08, ["scene_id"])


@query("ivl_5_merge_same_event", A.sql("""
WITH f AS (SELECT *, max(end_day) OVER (PARTITION BY video_id, speaker ORDER BY start_day, end_day, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start_day - far > 0.1e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, speaker ORDER BY start_day, end_day, span_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT video_id, speaker, min(start_day) AS start_day, max(end_day) AS end_day, count(*) AS n, max(price) AS score FROM g GROUP BY video_id, speaker, island""", "spans"))
def merge_same_event(spark, sf_dir):
    return I.merge(A.spans(spark, sf_dir), ["video_id", "speaker"], "start_day", "end_day", 0.1, ["span_id"], [F.max("price").alias("score")])


@query("ivl_17_overlap_regions", A.sql("""
WITH p AS (SELECT video_id, start_day AS lo FROM spans UNION SELECT video_id, end_day FROM spans),
c AS (SELECT * FROM (SELECT video_id, lo, lead(lo) OVER (PARTITION BY video_id ORDER BY lo) AS hi FROM p) WHERE hi IS NOT NULL),
a AS (SELECT c.video_id, lo, hi, string_agg(DISTINCT speaker::VARCHAR, '|' ORDER BY speaker::VARCHAR) AS sp, count(DISTINCT speaker) AS k FROM c JOIN spans b ON b.video_id = c.video_id AND b.start_day < hi AND b.end_day > lo GROUP BY ALL),
m AS (SELECT *, lag(sp) OVER w AS ps, lag(hi) OVER w AS ph FROM a WHERE k >= 2 WINDOW w AS (PARTITION BY video_id ORDER BY lo)),
r AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> sp OR lo > ph THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT video_id, min(lo) AS start, max(hi) AS "end", sp AS speakers FROM r GROUP BY video_id, sp, run""", "spans"))
def overlap_regions(spark, sf_dir):
    return I.overlap_regions(A.spans(spark, sf_dir), ["video_id"], "start_day", "end_day", "speaker")


@query("ivl_13_thin_cuts", A.sql("""
WITH RECURSIVE o AS (SELECT video_id, start_seconds, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, scene_id) AS rn FROM shots),
t AS (SELECT video_id, rn, start_seconds, scene_id, start_seconds AS last, true AS keep FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, o.start_seconds, o.scene_id, CASE WHEN o.start_seconds - t.last >= 15e0 THEN o.start_seconds ELSE t.last END, o.start_seconds - t.last >= 15e0 FROM t JOIN o ON o.video_id = t.video_id AND o.rn = t.rn + 1)
SELECT video_id, start_seconds, scene_id FROM t WHERE keep""", "shots"))
def thin_cuts(spark, sf_dir):
    return I.thin(A.shots(spark, sf_dir), ["video_id"], "start_seconds", 15.0, "scene_id")


@query("ivl_14_adaptive_cuts", A.sql("""
WITH RECURSIVE m AS (SELECT video_id, median(action_score) AS med FROM shots GROUP BY video_id),
d AS (SELECT s.video_id, median(abs(action_score - med)) AS mad, any_value(med) AS med FROM shots s JOIN m USING (video_id) GROUP BY s.video_id),
o AS (SELECT s.video_id, start_seconds, scene_id, row_number() OVER (PARTITION BY s.video_id ORDER BY start_seconds, scene_id) AS rn FROM shots s JOIN d USING (video_id) WHERE action_score > least(0.72e0, greatest(0.20e0, med + greatest(0.08e0, 5.5e0 * mad)))),
t AS (SELECT video_id, rn, start_seconds, scene_id, start_seconds AS last, true AS keep FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, o.start_seconds, o.scene_id, CASE WHEN o.start_seconds - t.last >= 1.25e0 THEN o.start_seconds ELSE t.last END, o.start_seconds - t.last >= 1.25e0 FROM t JOIN o ON o.video_id = t.video_id AND o.rn = t.rn + 1)
SELECT video_id, start_seconds, scene_id FROM t WHERE keep""", "shots"))
def adaptive_cuts(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    med = s.groupBy("video_id").agg(F.median("action_score").alias("med"))
    mad = s.join(med, "video_id").groupBy("video_id").agg(F.median(F.abs(F.col("action_score") - F.col("med"))).alias("mad"), F.max("med").alias("med"))
    threshold = F.least(F.lit(0.72), F.greatest(F.lit(0.20), F.col("med") + F.greatest(F.lit(0.08), 5.5 * F.col("mad"))))
    cuts = s.join(mad, "video_id").where(F.col("action_score") > threshold)
    return I.thin(cuts, ["video_id"], "start_seconds", 1.25, "scene_id")


@query("ivl_15_story_groups", A.sql("""
WITH RECURSIVE o AS (SELECT video_id, scene_id, start_seconds, end_seconds, coalesce(start_seconds - lag(end_seconds) OVER w <= 2e0 AND abs(action_score - lag(action_score) OVER w) <= 0.5e0, false) AS j, row_number() OVER w AS rn FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)),
t AS (SELECT video_id, rn, scene_id, start_seconds, end_seconds, 1::BIGINT AS group_id, start_seconds AS f, 1 AS n FROM o WHERE rn = 1
  UNION ALL SELECT o.video_id, o.rn, o.scene_id, o.start_seconds, o.end_seconds,
   CASE WHEN j AND o.end_seconds - f <= 45e0 AND n < 12 THEN group_id ELSE group_id + 1 END, CASE WHEN j AND o.end_seconds - f <= 45e0 AND n < 12 THEN f ELSE o.start_seconds END, CASE WHEN j AND o.end_seconds - f <= 45e0 AND n < 12 THEN n + 1 ELSE 1 END
  FROM t JOIN o ON o.video_id = t.video_id AND o.rn = t.rn + 1)
SELECT video_id, scene_id, start_seconds, end_seconds, group_id FROM t""", "shots"))
def story_groups(spark, sf_dir):
    from pyspark.sql import Window

    s = A.shots(spark, sf_dir)
    w = Window.partitionBy("video_id").orderBy("scene_id")
    s = s.withColumn("gap", F.col("start_seconds") - F.lag("end_seconds").over(w)).withColumn("change", F.abs(F.col("action_score") - F.lag("action_score").over(w)))
    return I.group_while(s, ["video_id"], ["scene_id"], "start_seconds", "end_seconds", (F.col("gap") <= 2) & (F.col("change") <= 0.5), 45.0, 12)


@query("ivl_12_snap_to_shots", A.sql("""
WITH g AS (SELECT *, row_number() OVER (PARTITION BY video_id, span_id ORDER BY abs(p - asked), p) AS r FROM (SELECT video_id, span_id, start_day + 0.4e0 AS asked FROM spans WHERE status <> 'F') q JOIN (SELECT video_id, start_day::DOUBLE AS p FROM spans WHERE status = 'F') USING (video_id))
SELECT video_id, span_id, asked, p AS near FROM g WHERE r = 1""", "spans"))
def snap_to_shots(spark, sf_dir):
    s = A.spans(spark, sf_dir)
    q = s.where("status <> 'F'").select("video_id", "span_id", (F.col("start_day") + F.lit(0.4)).alias("asked"))
    return I.snap(q, s.where("status = 'F'"), ["video_id"], "asked", "start_day", "near")


@query("ivl_30_frame_masks", A.sql("""
SELECT video_id, scene_id, least(greatest(round_even(start_seconds * 1000 / video_duration, 0)::BIGINT, 0), 1000) AS first_frame, least(greatest(round_even(end_seconds * 1000 / video_duration, 0)::BIGINT, 0), 1000) AS end_frame FROM shots""", "shots"))
def frame_masks(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("n_frames", F.lit(1000))
    return I.frames(d, "start_seconds", "end_seconds", "video_duration", "n_frames").select("video_id", "scene_id", "first_frame", "end_frame")


@query("ivl_28_context_expansion", A.sql("""
WITH e AS (SELECT video_id, scene_id, greatest(0e0, start_seconds - 1.5e0) AS a, least(video_duration, end_seconds + 2e0) AS z, video_duration AS d,
  CASE WHEN lead(emotion) OVER w >= 0.9e0 THEN lead(end_seconds) OVER w END AS n1, CASE WHEN lead(emotion) OVER w >= 0.9e0 AND lead(emotion, 2) OVER w >= 0.9e0 THEN lead(end_seconds, 2) OVER w END AS n2 FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)),
x AS (SELECT video_id, scene_id, d, a, greatest(z, coalesce(n1, z), coalesce(n2, z)) AS z FROM e),
p AS (SELECT *, greatest(0e0, 4e0 - (z - a)) / 2e0 AS pad FROM x)
SELECT video_id, scene_id, round(greatest(0e0, a - pad), 6) AS start_seconds, round(least(d, z + pad), 6) AS end_seconds FROM p""", "shots"))
def context_expansion(spark, sf_dir):
    from sceneql.operators import segments as S

    return S.expand(A.shots(spark, sf_dir), 1.5, 2.0, 4.0, "emotion", 0.9).select("video_id", "scene_id", F.round("expanded_start", 6).alias("start_seconds"), F.round("expanded_end", 6).alias("end_seconds"))


@query("ivl_8_speech_safe_bounds")
def speech_safe_bounds(spark, sf_dir):
    t = A.turns(spark, sf_dir)
    s = t.select("video_id", "turn", (F.col("start_seconds") + 0.7).alias("start_seconds"), (F.col("start_seconds") + 4.3).alias("end_seconds"))
    return I.safe_bounds(s, t.select("video_id", F.col("start_seconds").alias("ts"), F.col("end_seconds").alias("te")), ["video_id"], "start_seconds", "end_seconds", "ts", "te")


@query("ivl_29_highlight_intervals")
def highlight_intervals(spark, sf_dir):
    from pyspark.sql import Window

    t = A.turns(spark, sf_dir)
    # videos end with their last turn, which the last intervals reach beyond
    s = t.select("video_id", (F.col("start_seconds") + 0.7).alias("start_seconds"), (F.col("start_seconds") + 4.3).alias("end_seconds"), F.max("end_seconds").over(Window.partitionBy("video_id")).alias("ends"))
    edges = t.select("video_id", F.col("start_seconds").alias("ts"), F.col("end_seconds").alias("te"))
    safe = I.safe_bounds(s, edges, ["video_id"], "start_seconds", "end_seconds", "ts", "te", duration="ends").where("end_seconds > start_seconds")
    merged = I.merge(safe, ["video_id"], "start_seconds", "end_seconds", 0.08, aggregates=[F.max("ends").alias("ends")])
    return I.safe_bounds(merged, edges, ["video_id"], "start_seconds", "end_seconds", "ts", "te", duration="ends").drop("ends")


@query("ivl_19_overlap_suppression", A.sql("""
WITH a AS (SELECT video_id, span_id, start_day, end_day FROM spans WHERE status <> 'O'), b AS (SELECT video_id, start_day AS bs, end_day AS be FROM spans WHERE status = 'O' AND price >= 200000)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.video_id = a.video_id AND (least(a.end_day, be) - greatest(a.start_day, bs)) >= 0.4e0 * (a.end_day - a.start_day))""", "spans"))
def overlap_suppression(spark, sf_dir):
    from sceneql.operators import joins as J

    s = A.spans(spark, sf_dir)
    a = s.where("status <> 'O'").select("video_id", "span_id", "start_day", "end_day")
    b = s.where("status = 'O' and price >= 200000").select("video_id", F.col("start_day").alias("bs"), F.col("end_day").alias("be"))
    covered = J.overlap_join(a, b, ["video_id"], "start_day", "end_day", "bs", "be", 8.0).where(F.least("end_day", "be") - F.greatest("start_day", "bs") >= F.lit(0.4) * (F.col("end_day") - F.col("start_day")))
    return a.join(covered.select("span_id").distinct(), "span_id", "left_anti")


@query("ivl_26_conflict_bridges", A.sql("""
WITH c AS (SELECT *, start_seconds / video_duration AS spot, lag(end_seconds) OVER w AS f, lag(start_seconds / video_duration) OVER w AS before FROM shots WHERE onset >= 0.8e0 WINDOW w AS (PARTITION BY video_id ORDER BY start_seconds, scene_id)),
g AS (SELECT video_id, scene_id AS gap, f + 5e0 AS lo, least(start_seconds - 5e0, f + least(0.45e0 * (start_seconds - f), 180e0)) AS hi FROM c WHERE start_seconds - f >= 20e0 AND before >= 0.72e0 AND spot BETWEEN 0.80e0 AND 0.94e0),
h AS (SELECT g.video_id, gap, s.scene_id, s.start_seconds FROM g JOIN shots s ON s.video_id = g.video_id AND s.start_seconds BETWEEN lo AND hi WHERE action_score >= 0.2e0 AND emotion >= 0.2e0 AND speech_ratio <= 0.8e0 AND onset < 0.8e0),
k AS (SELECT a.video_id, a.gap, a.scene_id, a.start_seconds FROM h a JOIN h b ON a.video_id = b.video_id AND a.gap = b.gap AND b.start_seconds BETWEEN a.start_seconds AND a.start_seconds + 30e0 GROUP BY ALL HAVING count(*) >= 3),
x AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY video_id, gap ORDER BY start_seconds, scene_id) = 1)
SELECT video_id, scene_id FROM x QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, scene_id) <= 2""", "shots"))
def conflict_bridges(spark, sf_dir):
    from sceneql.operators import summary as M

    d = M.prepared(A.shots(spark, sf_dir).drop("credit_probability"), "narrative_score", {"event": "emotion"})
    chosen = d.join(A.shots(spark, sf_dir).where("onset >= 0.8").select("video_id", "scene_id"), ["video_id", "scene_id"])
    # the table's videos are short and its scores independent: gaps of 20 s and low floors
    return M.conflict_bridges(chosen, d, 20.0, floors=(0.2, 0.2), quiet=0.8)


@query("ivl_27_event_chains", A.sql("""
WITH d AS (SELECT *, row_number() OVER w AS n, lag(start_seconds) OVER w AS ps, lag(end_seconds) OVER w AS pe, 0.40e0 * emotion + 0.30e0 * 0e0 + 0.20e0 * energy + 0.10e0 * narrative_score AS v, (start_seconds + end_seconds) / 2e0 / video_duration AS mid FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY start_seconds, scene_id)),
q AS (SELECT *, CASE WHEN mid < 0.25e0 THEN 1 WHEN mid < 0.75e0 THEN 2 ELSE 3 END AS act FROM d WHERE dialogue_score >= 0.3e0 AND (emotion >= 0.94e0 OR energy >= 0.94e0)),
a AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY video_id, act ORDER BY v DESC, scene_id) <= CASE act WHEN 1 THEN 1 ELSE 2 END),
b AS (SELECT *, emotion >= 0.90e0 AND start_seconds / video_duration BETWEEN 0.80e0 AND 0.94e0 AS late, CASE WHEN start_seconds - pe <= 4e0 THEN ps ELSE start_seconds END AS setup FROM a QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY v DESC, scene_id) <= 4),
p AS (SELECT b.video_id, b.scene_id, x.end_seconds AS e FROM b JOIN d x ON x.video_id = b.video_id AND x.n > b.n AND x.start_seconds <= b.end_seconds + 26e0 QUALIFY row_number() OVER (PARTITION BY b.video_id, b.scene_id ORDER BY 0.50e0 * x.emotion + 0.25e0 * x.action_score + 0.25e0 * x.narrative_score DESC, x.end_seconds DESC) = 1),
l AS (SELECT b.video_id, b.scene_id, x.end_seconds AS e FROM b JOIN d x ON x.video_id = b.video_id AND x.n > b.n AND x.end_seconds <= b.end_seconds + 50e0 AND x.emotion >= 0.90e0 WHERE late QUALIFY row_number() OVER (PARTITION BY b.video_id, b.scene_id ORDER BY x.n DESC) = 1),
z AS (SELECT b.*, greatest(b.end_seconds, coalesce(p.e, 0e0), coalesce(l.e, 0e0)) AS ce FROM b LEFT JOIN p USING (video_id, scene_id) LEFT JOIN l USING (video_id, scene_id))
SELECT video_id, scene_id, round(greatest(setup, ce - CASE WHEN late THEN 50e0 ELSE 30e0 END), 3) AS chain_start, round(ce, 3) AS chain_end, late, round(v, 4) AS anchor_value FROM z""", "shots"))
def event_chains(spark, sf_dir):
    from sceneql.operators import summary as M

    d = M.prepared(A.shots(spark, sf_dir).drop("credit_probability"), "narrative_score", {"event": "emotion", "hybrid": "energy", "importance_score": "narrative_score"})
    return M.event_chains(d.where("dialogue_score >= 0.3"), d, 180.0)


@query("ivl_16_continuity_groups", A.sql("""
WITH RECURSIVE o AS (SELECT video_id, scene_id, start_seconds, end_seconds, (credit_probability >= 0.8e0) AS cr, 0.52e0 * (1e0 - abs(dialogue_score - lag(dialogue_score) OVER w)) + 0.25e0 * (1e0 - abs(action_score - lag(action_score) OVER w)) + 0.23e0 * 0.35e0 AS c, row_number() OVER w AS rn FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)),
t AS (SELECT video_id, rn, scene_id, cr, 1::BIGINT AS group_id, start_seconds AS f FROM o WHERE rn = 1
 UNION ALL SELECT o.video_id, o.rn, o.scene_id, o.cr, CASE WHEN o.cr <> t.cr OR (o.start_seconds - f >= 8e0 AND o.c < 0.40e0) OR o.end_seconds - f >= 72e0 THEN group_id + 1 ELSE group_id END, CASE WHEN o.cr <> t.cr OR (o.start_seconds - f >= 8e0 AND o.c < 0.40e0) OR o.end_seconds - f >= 72e0 THEN o.start_seconds ELSE f END
 FROM t JOIN o ON o.video_id = t.video_id AND o.rn = t.rn + 1)
SELECT video_id, scene_id, group_id FROM t""", "shots"))
def continuity_groups(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("scene_id")
    near = lambda c: 1.0 - F.abs(F.col(c) - F.lag(c).over(w))
    d = A.shots(spark, sf_dir).withColumn("continuity", 0.52 * near("dialogue_score") + 0.25 * near("action_score") + F.lit(0.23) * 0.35)
    return I.group_by_continuity(d, ["video_id"], "scene_id", "start_seconds", "end_seconds", F.col("credit_probability") >= 0.8, "continuity")
