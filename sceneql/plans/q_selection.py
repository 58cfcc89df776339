"""Queries of constrained selection (SEL), the injected-function slots (UDF) and the main calls (API)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.operators import scoring as P
from sceneql.operators import joins as J
from sceneql.operators import selection as S
from sceneql.operators import speech as P2
from sceneql.operators import summary as M
from sceneql.operators import topk as K
from sceneql.operators import windows as W
from sceneql.operators.groups import by_group
from sceneql.plans import adapters as A
from sceneql.plans.registry import query

#: The rows of a video's best subset within the capacity, by listing all subsets of its items (at most 13). What decides
#: comes first in {order}; then the cheaper subset, and of equal ones the one of earlier items.
SUBSETS = """
WITH t AS (SELECT video_id, ord, value, duration, {cost} AS c, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM items),
m AS (SELECT DISTINCT video_id, unnest(range(0, 1::BIGINT << n)) AS m FROM t),
s AS (SELECT video_id, m, round(sum(value), 2) AS v, sum(c) AS c, count(*) AS size FROM m JOIN t USING (video_id) WHERE (m >> k) % 2 = 1 GROUP BY ALL),
b AS (SELECT video_id, m FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {order}, c, m) AS r FROM s WHERE c <= {capacity}) WHERE r = 1)
SELECT t.video_id, ord, value, duration FROM b JOIN t USING (video_id) WHERE (m >> k) % 2 = 1
"""


def knap(name: str, cost: str, capacity: int, budget: float, order: str = "v DESC", **how):
    @query(name, A.sql(SUBSETS.format(cost=cost, capacity=capacity, order=order), "items"))
    def f(spark, sf_dir):
        return S.knapsack_rows(A.items(spark, sf_dir), ["video_id"], ["ord"], "value", "duration", budget, **how)


knap("sel_1_knapsack_more_items", "greatest(1, round_even(duration / 0.5e0, 0))::BIGINT", 120, 60.0, "v DESC, size DESC", step=0.5, how="round", more_items=True)
knap("sel_2_knapsack_margin", "greatest(1, round_even(duration / 0.5e0, 0))::BIGINT", 80, 40.2, step=0.5, how="round", capacity_how="floor", margin=1e-8)
knap("sel_4_duration_filling", "greatest(1, ceil(duration))::BIGINT", 60, 60.0, "c DESC, v DESC", step=1.0, how="ceil", exact=True)
knap("sel_5_knapsack_seconds", "greatest(1, ceil(duration))::BIGINT", 45, 45.0, step=1.0, how="ceil", margin=1e-6)
knap("sel_6_knapsack_frames", "greatest(1, ceil(duration))::BIGINT", 55, 55.0, step=1.0, how="ceil")
knap("sel_7_knapsack_whole", "greatest(1, floor(duration))::BIGINT", 50, 50.7, step=1.0, how="floor", capacity_how="floor")


@query("sel_3_protected_first")
def protected_first(spark, sf_dir):
    d = A.items(spark, sf_dir).select("video_id", "ord", "duration", (F.round(F.col("value") * 100).cast("long") % 101 / F.lit(100.0)).alias("score"), (F.col("flag") == "R").alias("protected"), (F.col("discount") > 0.05).alias("anchor"), (F.col("flag") == "A").alias("reserve"))
    return S.chosen_rows(d, ["ord"], "score", "duration", 60.0, protected="protected", anchor="anchor", reserve="reserve")


@query("sel_8_soft_diversity")
def soft_diversity(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("position", F.col("start_seconds") / F.col("video_duration"))
    return S.diverse_rows(d, ["video_id"], "scene_id", "narrative_score", "duration_seconds", "position", "story_id", 90.0)


def _pool_sql(limit: int, bins: int) -> str:
    """The rule of the candidate pool, a lane after the other: rows that the pool offers room for, less those that it has."""
    lanes = (("required", None), ("local", 0.35), ("time", None), ("event", 0.15), ("neighbour", 0.10), ("story", 0.20), ("score", None))
    steps = ["p0 AS (SELECT video_id, 0::BIGINT AS scene_id, '' AS source, 0::BIGINT AS place FROM shots WHERE false)"]
    for k, (lane, share) in enumerate(lanes):
        most = 1000 if share is None else max(2, round(share * limit))
        room = "1000" if share is None or lane == "local" else f"{limit} - coalesce(c, 0)"
        steps.append(f"""p{k + 1} AS (SELECT * FROM p{k} UNION ALL SELECT video_id, scene_id, source, place FROM (
 SELECT l.video_id, l.scene_id, '{lane}' AS source, coalesce(c, 0) + row_number() OVER (PARTITION BY l.video_id ORDER BY n) AS place
 FROM (SELECT video_id, scene_id, min(n) AS n FROM (SELECT video_id, scene_id, n FROM {lane}_ LEFT JOIN (SELECT video_id, count(*) AS c FROM p{k} GROUP BY video_id) USING (video_id) WHERE n <= least({most}, {room})) GROUP BY ALL) l
 LEFT JOIN (SELECT video_id, count(*) AS c FROM p{k} GROUP BY video_id) t ON t.video_id = l.video_id
 WHERE NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.video_id = l.video_id AND p.scene_id = l.scene_id)) WHERE place <= {limit})""")
    return f"""
WITH d AS (SELECT *, least(cast(floor({bins}e0 * ((start_seconds + end_seconds) / 2e0 - min(start_seconds) OVER v) / greatest(max(end_seconds) OVER v - min(start_seconds) OVER v, 0.001e0)) AS BIGINT), {bins - 1}) AS bin, lag(scene_id) OVER w AS prev, lead(scene_id) OVER w AS next FROM shots WINDOW v AS (PARTITION BY video_id), w AS (PARTITION BY video_id ORDER BY start_seconds, scene_id)),
required_ AS (SELECT video_id, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY scene_id) AS n FROM d WHERE emotion = 1e0),
local_ AS (SELECT video_id, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, scene_id) AS n, prev, next FROM d WHERE action_score >= 0.5e0),
time_ AS (SELECT video_id, scene_id, bin AS n FROM d QUALIFY row_number() OVER (PARTITION BY video_id, bin ORDER BY narrative_score DESC, scene_id) = 1),
event_ AS (SELECT video_id, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY bin) AS n FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY video_id, bin ORDER BY emotion DESC, narrative_score DESC, scene_id) = 1)),
neighbour_ AS (SELECT video_id, x AS scene_id, row_number() OVER (PARTITION BY video_id ORDER BY n, side) AS n FROM (SELECT video_id, n, unnest([0, 1]) AS side, unnest([prev, next]) AS x FROM local_) WHERE x IS NOT NULL),
story_ AS (SELECT video_id, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS n FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY video_id, story_id ORDER BY narrative_score DESC, scene_id) = 1)),
score_ AS (SELECT video_id, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS n FROM d),
{', '.join(steps)}
SELECT video_id, scene_id, source, place::INTEGER AS place FROM p{len(lanes)}"""


def _pool(name: str, limit: int, bins: int) -> None:
    @query(name, A.sql(_pool_sql(limit, bins), "shots"))
    def pool(spark, sf_dir):
        s = A.shots(spark, sf_dir)
        local = s.where("action_score >= 0.5").select("video_id", "scene_id", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("action_score"), "scene_id")).alias("n"))
        return K.candidate_pool(s, local, s.where("emotion = 1e0").select("video_id", "scene_id"), "narrative_score", "emotion", "story_id", limit)


_pool("sel_10_candidate_pool", 32, 8)
_pool("sel_10_candidate_pool_small", 16, 8)
_pool("sel_10_candidate_pool_wide", 72, 16)


@query("sel_11_marginal_relevance")
def marginal_relevance(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("mid", (F.col("start_seconds") + F.col("end_seconds")) / 2 / F.col("video_duration")).withColumn("len", F.least(F.col("duration_seconds") / 20, F.lit(1.0)))
    return S.mmr_rows(d, ["video_id"], "scene_id", "narrative_score", ["clip_action", "clip_dialogue", "narrative_score", "energy", "speech_ratio", "len", "mid"], "story_id", 12, 0.25)


#: The tables' columns by the plan's names.
PLAN = {"event": "emotion", "story": "story_id", "importance_score": "narrative_score"}


def _chosen(spark, sf_dir, category: str, score: str, target: float, distribution: str = "adaptive"):
    d = M.prepared(A.shots(spark, sf_dir), score, PLAN).withColumn("required", F.lit(False))
    return M.choose_shots(W.eligible(d, "smoothed_score"), category, target, distribution)


@query("sel_12_region_quotas")
def region_quotas(spark, sf_dir):
    return _chosen(spark, sf_dir, "action", "action_score", 90.0)


@query("sel_12_compact_quotas")
def compact_quotas(spark, sf_dir):
    return _chosen(spark, sf_dir, "dialogue", "dialogue_score", 30.0)


@query("sel_12_act_quotas")
def act_quotas(spark, sf_dir):
    return _chosen(spark, sf_dir, "importance", "narrative_score", 90.0, "acts")


@query("sel_13_adaptive_importance")
def adaptive_importance(spark, sf_dir):
    return _chosen(spark, sf_dir, "importance", "narrative_score", 60.0)


@query("sel_14_balanced_acts")
def balanced_acts(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("act", P.act((F.col("start_seconds") + F.col("end_seconds")) / 2 / F.col("video_duration")))
    d = d.withColumn("must", (F.col("scene_id") == 1) & (F.col("duration_seconds") < 30)).withColumn("protected", F.col("onset") > 0.9).withColumn("anchor", F.col("emotion") > 0.9).withColumn("reserve", F.col("energy") < 0.3)
    return S.chosen_rows(d, ["scene_id"], "narrative_score", "duration_seconds", 90.0, "act", "must", "protected", "anchor", "reserve")


@query("sel_15_greedy_fill")
def greedy_fill(spark, sf_dir):
    p = M.plan(A.shots(spark, sf_dir), "dialogue", 60.0, words=A.words(spark, sf_dir), turns=_turns(spark, sf_dir), columns=PLAN)
    return p.where("status = 'chosen'").select("video_id", "kind", "segment_id", "start_seconds", "end_seconds", "trimmed")


@query("sel_16_duration_ceiling", A.sql("SELECT video_id, scene_id, round(least(end_seconds, start_seconds + 60e0 - before), 6) AS end_seconds FROM (SELECT *, round(coalesce(sum(round(duration_seconds * 1000)::BIGINT) OVER (PARTITION BY video_id ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e3, 3) AS before FROM shots WHERE action_score >= 0.5e0) WHERE before < 59e0", "shots"))
def duration_ceiling(spark, sf_dir):
    w = Window.partitionBy("video_id").orderBy("scene_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.round(F.coalesce(F.sum(F.round(F.col("duration_seconds") * 1000).cast("long")).over(w), F.lit(0)) / F.lit(1e3), 3)
    d = A.shots(spark, sf_dir).where("action_score >= 0.5").withColumn("before", before).where("before < 59")
    return d.select("video_id", "scene_id", F.round(F.least(F.col("end_seconds"), F.col("start_seconds") + 60.0 - F.col("before")), 6).alias("end_seconds"))


@query("sel_17_final_guard")
def final_guard(spark, sf_dir):
    t = A.turns(spark, sf_dir)

    def f(rows):
        turns = [(r["start_seconds"], r["end_seconds"]) for r in rows]
        segs = [{"start": r["start_seconds"] + 0.5, "end": r["start_seconds"] + 6.0, "score": (r["turn"] % 7) / 7, "speech": True} for r in rows]
        return [{"start_seconds": r["start"], "end_seconds": r["end"], "score": r["score"]} for r in S.guard(segs, turns, 120.0)]

    return by_group(t, ["video_id"], ["start_seconds", "end_seconds"], ["turn"], f, "start_seconds double, end_seconds double, score double")


@query("sel_18_gold_shots", A.sql("WITH g AS (SELECT video_id, story_id AS shot, round(avg(action_score), 9) AS m, count(*) AS n FROM shots GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m DESC, shot) AS k FROM g WHERE n = 4) SELECT r.video_id, shot FROM r JOIN (SELECT DISTINCT video_id, floor(0.15e0 * n_shots) AS b FROM shots) b ON b.video_id = r.video_id WHERE k <= b // 4", "shots"))
def gold_shots(spark, sf_dir):
    # nine places: equal means tie, in whatever order their scores were added
    s = A.shots(spark, sf_dir)
    g = s.groupBy("video_id", F.col("story_id").alias("shot")).agg(F.round(F.avg("action_score"), 9).alias("m"), F.count("*").alias("n"), F.max("n_shots").alias("all")).where("n = 4")
    return K.ranked(g, ["video_id"], [F.desc("m"), "shot"], "k").where("k <= cast(floor(0.15D * `all`) as bigint) div 4").select("video_id", "shot")


@query("sel_19_uniform_baseline", A.sql("SELECT DISTINCT video_id, unnest(range(0, 10)) AS part, round(video_duration * part / 10e0, 6) AS start_seconds FROM shots", "shots"))
def uniform_baseline(spark, sf_dir):
    d = A.shots(spark, sf_dir).select("video_id", "video_duration").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("part"))
    return d.select("video_id", F.col("part").cast("long").alias("part"), F.round(F.col("video_duration") * F.col("part") / 10, 6).alias("start_seconds"))


def _turns(spark, sf_dir):
    return P2.whole_turns(A.turns(spark, sf_dir), ["video_id"])


@query("sel_9_duration_refill")
def duration_refill(spark, sf_dir):
    """The reserves that the plan of a summary adds, and whether they keep the budget."""
    p = M.plan(A.shots(spark, sf_dir), "action", 60.0, words=A.words(spark, sf_dir), turns=_turns(spark, sf_dir), columns=PLAN)
    return p.where("kind = 'reserve'").select("video_id", "segment_id", "start_seconds", "end_seconds", "segment_score", "status")


@query("api_summarize")
def summarize(spark, sf_dir):
    return M.summarize(A.shots(spark, sf_dir), "action", 60.0, columns=PLAN)


@query("api_summarize_films")
def summarize_films(spark, sf_dir):
    return M.summarize(A.films(spark, sf_dir), "action", 180.0, columns=PLAN)


@query("api_summarize_all")
def summarize_all(spark, sf_dir):
    return M.summarize(A.shots(spark, sf_dir), "dialogue", None, columns=PLAN)


@query("api_summarize_importance")
def summarize_importance(spark, sf_dir):
    return M.summarize(A.shots(spark, sf_dir), "importance", 90.0, "narrative_score", columns=PLAN)


@query("api_summarize_speech")
def summarize_speech(spark, sf_dir):
    return M.summarize(A.shots(spark, sf_dir), "dialogue", 60.0, turns=_turns(spark, sf_dir), words=A.words(spark, sf_dir), columns=PLAN)


@query("api_summarize_acts")
def summarize_acts(spark, sf_dir):
    return M.summarize(_told(spark, sf_dir), "importance", 120.0, "narrative_score", turns=_turns(spark, sf_dir), words=A.words(spark, sf_dir), distribution="acts", columns=PLAN)


@query("api_summary_report")
def summary_report(spark, sf_dir):
    return M.report(M.plan(_told(spark, sf_dir), "importance", 120.0, "narrative_score", words=A.words(spark, sf_dir), turns=_turns(spark, sf_dir), distribution="acts", columns=PLAN))


def _told(spark, sf_dir):
    """Shots with the texts of the turns that begin in them."""
    t = A.turns(spark, sf_dir).select("video_id", "text", F.col("start_seconds").alias("_at"))
    said = J.point_join(t, A.shots(spark, sf_dir).select("video_id", "scene_id", "start_seconds", "end_seconds"), ["video_id"], "_at", "start_seconds", "end_seconds", 30.0)
    texts = said.groupBy("video_id", "scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), " ").alias("transcript_text"))
    return A.shots(spark, sf_dir).join(texts, ["video_id", "scene_id"], "left")


@query("udf_3_mock_captions", A.sql("SELECT video_id, scene_id, 'scene ' || scene_id || ': ' || event_type AS caption FROM shots", "shots"))
def mock_captions(spark, sf_dir):
    from sceneql.sources.providers import mock_captioner

    return A.shots(spark, sf_dir).select("video_id", "scene_id", mock_captioner(F.col("scene_id"), F.col("event_type")).alias("caption"))


@query("udf_5_budget_select", A.sql(SUBSETS.format(cost="greatest(1, round_even(duration / 0.5e0, 0))::BIGINT", capacity=120, order="v DESC, size DESC"), "items"))
def budget_select(spark, sf_dir):
    from sceneql.operators.tables import register

    register(spark)
    items = A.items(spark, sf_dir).select(F.col("video_id").alias("k"), "ord", "value", "duration")
    chosen = spark.sql("SELECT k AS video_id, ord, value, cost AS duration FROM budget_select(TABLE(SELECT k, ord, value, duration FROM {items}) PARTITION BY (pmod(hash(k), 4096)) ORDER BY (k, ord), 60.0D, 0.5D)", items=items)
    return chosen
