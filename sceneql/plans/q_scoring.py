"""Queries of projections, filters and predicates (PRJ) over shots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.operators import scoring as P
from sceneql.operators import windows as W
from sceneql.plans import adapters as A
from sceneql.plans.registry import query

ID = ["video_id", "scene_id"]


def prj(name: str, column, sql: str, out: str = "x"):
    """A query that adds one column to every shot, and its SQL."""
    query(name, A.sql(f"SELECT video_id, scene_id, {sql} AS {out} FROM shots", "shots"))(lambda spark, sf_dir: A.shots(spark, sf_dir).select(*ID, column().alias(out)))


clip01 = "least(greatest({}, 0e0), 1e0)"
prj("prj_1_clip_similarity", lambda: F.round(P.similarity("clip_action"), 6), f"round({clip01.format('(clip_action - 0.15e0) / 0.20e0')}, 6)", "similarity")
prj("prj_2_cut_frequency", lambda: F.round(P.cut_frequency("duration_seconds"), 6), f"round({clip01.format('(15e0 - duration_seconds) / 15e0')}, 6)", "cut_frequency")
prj("prj_3_action_score", lambda: F.round(P.action("clip_action", "energy", "duration_seconds"), 6), f"round(0.40e0 * {clip01.format('(clip_action - 0.15e0) / 0.20e0')} + 0.35e0 * energy + 0.25e0 * {clip01.format('(15e0 - duration_seconds) / 15e0')}, 6)", "action")
prj("prj_4_dialogue_score", lambda: F.round(P.dialogue("speech_ratio", "clip_dialogue", "density"), 6), f"round(0.45e0 * speech_ratio + 0.30e0 * {clip01.format('(clip_dialogue - 0.15e0) / 0.20e0')} + 0.25e0 * least(density / 3e0, 1e0), 6)", "dialogue")
prj("prj_5_importance_score", lambda: F.round(P.importance("action_score", "dialogue_score", "narrative_score", "speech_ratio", "energy", "onset", "emotion"), 6), "round(0.16e0 * greatest(action_score, dialogue_score) + 0.39e0 * narrative_score + 0.17e0 * speech_ratio + 0.10e0 * energy + 0.10e0 * onset + 0.08e0 * emotion, 6)", "importance")
_POS = "(scene_id::DOUBLE / n_shots)"
prj("prj_6_legacy_importance", lambda: F.round(P.legacy_importance(F.col("scene_id") / F.col("n_shots"), F.col("video_duration"), "action_score", "dialogue_score", "narrative_score", "speech_ratio", "energy", "onset"), 8),
    f"""round((0.16e0 * greatest(action_score, dialogue_score) + 0.31e0 * narrative_score + 0.17e0 * speech_ratio + 0.10e0 * energy + 0.10e0 * onset
    + 0.08e0 * CASE WHEN video_duration >= 3600e0 AND {_POS} >= 0.95e0 THEN 0.25e0 WHEN {_POS} <= 0.20e0 THEN 0.85e0 WHEN {_POS} >= 0.75e0 THEN 0.90e0 ELSE 0.50e0 END
    + CASE WHEN {_POS} >= 0.925e0 AND {_POS} < 0.95e0 THEN 0.12e0 * greatest(0e0, 1e0 - abs({_POS} - 0.9347e0) / 0.010e0) ELSE 0e0 END) * CASE WHEN video_duration >= 3600e0 AND {_POS} >= 0.95e0 THEN 0.15e0 ELSE 1e0 END, 8)""", "importance")  # fmt: skip
prj("prj_7_category_labels", lambda: F.concat_ws(",", P.labels("action_score", "dialogue_score", "narrative_score")), "coalesce(nullif(concat_ws(',', CASE WHEN action_score >= 0.45e0 THEN 'action' END, CASE WHEN dialogue_score >= 0.40e0 THEN 'dialogue' END, CASE WHEN narrative_score >= 0.40e0 THEN 'important' END), ''), 'general')", "labels")
_EDGE = f"greatest((0.03e0 - {_POS}) / 0.03e0, ({_POS} - 0.96e0) / 0.04e0, 0e0)"
prj("prj_8_credit_probability", lambda: F.round(P.credits("clip_action", F.col("scene_id") / F.col("n_shots"), "speech_ratio"), 6),
    f"round({clip01.format(f'(0.65e0 * clip_action + 0.25e0 * {_EDGE} + 0.10e0 * (1e0 - least(2e0 * speech_ratio, 1e0))) * CASE WHEN {_EDGE} = 0e0 THEN 0.35e0 ELSE 1e0 END')}, 6)", "credit")
_H = f"(CASE WHEN event_type = 'signup' THEN 0.55e0 ELSE 0e0 END + CASE WHEN {_POS} >= 0.90e0 OR {_POS} <= 0.055e0 THEN 0.25e0 ELSE 0e0 END + CASE WHEN dialogue_score < 0.1e0 THEN 0.10e0 ELSE 0e0 END + 0.20e0 * energy)"
prj("prj_9_heuristic_credits", lambda: F.round(P.heuristic_credits("event_type", F.col("scene_id") / F.col("n_shots"), "dialogue_score", "energy", ("signup",)), 8),
    f"round({clip01.format(f"CASE WHEN event_type <> 'signup' AND {_POS} < 0.90e0 THEN least({_H}, 0.58e0) ELSE {_H} END")}, 8)", "credit")
#: The tables' labels that stand for words of action and of music.
_LABELS = (("error", "purchase"), ("signup",))
prj("prj_12_scene_flags", lambda: F.concat_ws(",", P.scene_flags("event_type", "dialogue_score", "speech_ratio", "onset", *_LABELS)), "coalesce(concat_ws(',', CASE WHEN dialogue_score >= 0.40e0 THEN 'dialogue' END, CASE WHEN speech_ratio < 0.10e0 THEN 'silent' END, CASE WHEN event_type IN ('error', 'purchase') OR onset >= 0.72e0 THEN 'action' END, CASE WHEN event_type = 'signup' THEN 'music' END), '')", "flags")
_T = "((start_seconds + end_seconds) / 2e0 / video_duration)"
_MID = lambda: (F.col("start_seconds") + F.col("end_seconds")) / 2 / F.col("video_duration")
prj("prj_17_narrative_region", lambda: P.narrative_region(F.col("scene_id") / F.col("n_shots")), "CASE " + " ".join(f"WHEN {_POS} <= {b}e0 THEN '{n}'" for n, b, _ in P.REGIONS[:-1]) + f" ELSE '{P.REGIONS[-1][0]}' END", "region")
prj("prj_18_act", lambda: P.act(_MID()), f"CASE WHEN {_T} < 0.25e0 THEN 'act_i' WHEN {_T} < 0.75e0 THEN 'act_ii' ELSE 'act_iii' END", "act")
prj("prj_19_balanced_region", lambda: P.balanced_region(_MID()), f"CASE WHEN {_T} <= 0.18e0 THEN 1 WHEN {_T} <= 0.45e0 THEN 2 WHEN {_T} <= 0.72e0 THEN 3 WHEN {_T} <= 0.82e0 THEN 4 WHEN {_T} <= 0.94e0 THEN 5 ELSE 6 END", "region")
prj("prj_20_position_label", lambda: P.position_label(F.col("start_seconds") / F.col("video_duration")), "CASE WHEN start_seconds / video_duration <= 0.20e0 THEN 'intro' WHEN start_seconds / video_duration >= 0.75e0 THEN 'ending' ELSE 'middle' END", "position")
prj("prj_21_estimated_duration", lambda: F.round(P.estimated_duration("duration_seconds", "action"), 6), "round(least(greatest(duration_seconds + 1.5e0 + 2e0, 4e0), 12e0), 6)", "estimated")
prj("prj_22_candidate_limit", lambda: P.candidate_limit(F.col("video_duration") / 60), "CASE WHEN m <= 10 THEN 16 WHEN m <= 30 THEN 24 WHEN m <= 60 THEN 32 WHEN m <= 90 THEN 40 WHEN m <= 150 THEN 48 WHEN m <= 165 THEN 56 ELSE 72 END".replace("m ", "video_duration / 60e0 "), "candidates")
#: The tables have no categories: two event types stand for two of them.
_CATEGORY = {"click": "action", "view": "dialogue"}


@query("prj_23_category_config", A.sql("SELECT video_id, scene_id, " + ", ".join(f"CASE event_type {' '.join(f"WHEN '{e}' THEN {float(P.CATEGORIES[c][k])!r}::DOUBLE" for e, c in _CATEGORY.items())} ELSE {float(P.CATEGORIES['importance'][k])!r}::DOUBLE END AS {n}" for k, n in enumerate(("shortest", "target", "longest", "before", "after", "gap"))) + " FROM shots", "shots"))
def category_config(spark, sf_dir):
    category = F.create_map(*[F.lit(x) for pair in _CATEGORY.items() for x in pair])[F.col("event_type")]
    return A.shots(spark, sf_dir).select("video_id", "scene_id", P.config(category).alias("c")).select("video_id", "scene_id", "c.*")

prj("prj_31_colour_class", lambda: P.colour("onset", "action_score", "dialogue_score"), "CASE WHEN onset >= 0.9e0 THEN 'overlap' WHEN action_score >= 0.45e0 AND action_score >= dialogue_score THEN 'action' WHEN dialogue_score >= 0.40e0 THEN 'dialogue' ELSE 'neutral' END", "colour")
prj("prj_33_fade_filter", lambda: P.fade("duration_seconds", "speech_ratio"), "CASE WHEN speech_ratio > 0.1e0 THEN '' ELSE printf('afade=t=in:st=0:d=%.4f,afade=t=out:st=%.4f:d=%.4f', least(0.35e0, duration_seconds * 0.1e0), duration_seconds - least(0.35e0, duration_seconds * 0.1e0), least(0.35e0, duration_seconds * 0.1e0)) END", "fade")
prj("prj_34_recommendation_limit", lambda: P.recommendation_limit("n_shots", "duration_seconds"), "least(n_shots, 24, greatest(8, ceil(duration_seconds / 15e0)::BIGINT))", "most")
prj("prj_35_timecode", lambda: P.clock("start_seconds"), "printf('%02d:%02d', floor(start_seconds / 60e0)::BIGINT, floor(start_seconds)::BIGINT % 60)", "clock")
prj("src_16_key_frame_time", lambda: F.round(P.key_frame("start_seconds", "end_seconds"), 6), "round(least(end_seconds - 0.05e0, start_seconds + greatest(0.05e0, 0.55e0 * (end_seconds - start_seconds))), 6)", "at")
prj("prj_24_transcript_anomalies", lambda: F.concat_ws(",", P.anomalies(F.col("duration_seconds") * 10, F.col("density") / 20)), "coalesce(concat_ws(',', CASE WHEN duration_seconds * 10 >= 90 THEN 'extreme_duration' END, CASE WHEN duration_seconds * 10 > 45 AND density / 20 < 0.20e0 THEN 'sparse' END), '')", "reasons")
prj("sel_20_hybrid_rerank", lambda: F.round(P.hybrid("narrative_score", "emotion", F.col("cents") % 4 == 0), 8), "round(CASE WHEN cents % 4 = 0 THEN greatest(0.75e0 * narrative_score + 0.25e0 * emotion, 0.82e0 + 0.18e0 * narrative_score) ELSE 0.45e0 * narrative_score + 0.55e0 * emotion END, 8)", "hybrid")
prj("sel_21_reviewed_blend", lambda: F.round(F.when(F.col("cents") % 3 == 0, 0.42 * F.col("narrative_score") + 0.58 * F.col("emotion")).otherwise(F.col("narrative_score")), 6), "round(CASE WHEN cents % 3 = 0 THEN 0.42e0 * narrative_score + 0.58e0 * emotion ELSE narrative_score END, 6)", "blend")
prj("eval_3_budget_violations", lambda: F.col("duration_seconds") > 0.15 * F.col("video_duration") + 0.05, "duration_seconds > 0.15e0 * video_duration + 0.05e0", "violates")


@query("prj_10_credit_filter", A.sql("SELECT video_id, scene_id FROM (SELECT *, max(CASE WHEN credit_probability < 0.65e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS any_left FROM shots) WHERE credit_probability < 0.65e0 OR any_left = 0", "shots"))
def credit_filter(spark, sf_dir):
    return P.without_credits(A.shots(spark, sf_dir), "credit_probability").select(*ID)


@query("prj_11_eligible", A.sql("SELECT video_id, scene_id FROM (SELECT *, max(narrative_score) OVER (PARTITION BY video_id) AS hi, avg(narrative_score) OVER (PARTITION BY video_id) AS mean FROM shots) WHERE NOT (narrative_score < 0.40e0 * hi AND narrative_score < mean)", "shots"))
def eligible(spark, sf_dir):
    return W.eligible(A.shots(spark, sf_dir), "narrative_score").select(*ID)


_WEIGHTS = ", ".join(f"CASE profile {' '.join(f"WHEN '{n}' THEN {w[k]}" for n, w in P.PROFILES.items())} END AS {part}" for k, part in enumerate(P.PARTS))


@query("prj_13_content_profile", A.sql(f"""
WITH c AS (SELECT video_id, max(c)::DOUBLE / sum(c) AS dom, count(*) AS k FROM (SELECT video_id, event_type, count(*) AS c FROM shots GROUP BY ALL) GROUP BY video_id),
p AS (SELECT video_id, avg((event_type IN ('error', 'purchase') OR onset >= 0.72e0)::INT) AS a, avg((speech_ratio < 0.10e0)::INT) AS s, avg((event_type = 'signup')::INT) AS m, avg(onset) AS v, avg((dialogue_score >= 0.40e0)::INT) AS d FROM shots GROUP BY video_id),
q AS (SELECT p.video_id, CASE WHEN a >= 0.34e0 THEN 'action_led' WHEN s >= 0.58e0 AND (v >= 0.35e0 OR m >= 0.25e0) THEN 'atmospheric' WHEN k >= 4 AND dom < 0.58e0 THEN 'ensemble' WHEN d >= 0.62e0 THEN 'dialogue_led' ELSE 'mixed' END AS profile FROM p JOIN c USING (video_id))
SELECT video_id, profile, {_WEIGHTS} FROM q""", "shots"))
def content_profile(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("flags", P.scene_flags("event_type", "dialogue_score", "speech_ratio", "onset", *_LABELS)).withColumn("actors", F.array("event_type"))
    return P.content_profile(d, "flags", "onset", "actors")


_PARTS = ["dialogue_score", "energy", "speech_ratio", "onset", "narrative_score", "emotion"]


@query("prj_15_six_component_score", A.sql("SELECT video_id, scene_id, round((0.65e0 * (24 * dialogue_score + 16 * energy + 16 * speech_ratio + 12 * onset + 21 * narrative_score + 11 * emotion) / 100e0 + 0.35e0 * action_score) * (1e0 - credit_probability), 6) AS score, round(0.65e0 * 24 * dialogue_score / 100e0, 6) AS dialogue, round(0.65e0 * 11 * emotion / 100e0, 6) AS structure FROM shots WHERE credit_probability < 0.72e0 AND (cents % 3 <> 0 OR (event_type = 'click' AND action_score >= 0.55e0))", "shots"))
def six_components(spark, sf_dir):
    # a third of the rows has an exclusive wish, which clicks match
    d = P.six_components(A.shots(spark, sf_dir), _PARTS, P.PROFILES["mixed"], "action_score", "credit_probability", F.col("cents") % 3 == 0, F.col("event_type") == "click", "action_score")
    return d.select(*ID, F.round("score", 6).alias("score"), F.col("parts")["dialogue"].alias("dialogue"), F.col("parts")["structure"].alias("structure"))


@query("prj_16_story_repetition", A.sql("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_id, story_id ORDER BY narrative_score DESC, scene_id) AS rk FROM shots),
m AS (SELECT a.video_id, a.scene_id, max(1e0 - abs(a.action_score - b.action_score)) AS sim FROM r a JOIN r b ON a.video_id = b.video_id AND a.story_id = b.story_id AND b.rk < a.rk GROUP BY ALL)
SELECT r.video_id, r.scene_id, round(CASE WHEN rk > 2 THEN least(0.55e0, (rk - 1 - 2 + 1) * 0.14e0 * least(greatest((coalesce(sim, 0e0) - 0.52e0) / 0.48e0, 0e0), 1e0)) ELSE 0e0 END, 6) AS penalty FROM r LEFT JOIN m USING (video_id, scene_id)""", "shots"))
def story_repetition(spark, sf_dir):
    return P.repetition_penalty(A.shots(spark, sf_dir), "narrative_score", "action_score", 2)


@query("prj_25_targeted_recheck", A.sql("""
WITH p AS (SELECT video_id, turn, CASE WHEN text LIKE '%?%' THEN 1e0 WHEN len(ws) < 3 THEN 0.95e0 ELSE (len(ws) % 10) / 10e0 END AS priority FROM turns)
SELECT video_id, turn, priority FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY priority DESC, turn) AS r FROM p) WHERE r <= 8""", "turns"))
def targeted_recheck(spark, sf_dir):
    t = A.turns(spark, sf_dir)
    n = ((F.col("end_ms") - F.col("start_ms")) / 400).cast("long")
    p = t.select("video_id", "turn", F.when(F.col("text").contains("?"), 1.0).when(n < 3, 0.95).otherwise((n % 10) / 10).alias("priority"))
    w = Window.partitionBy("video_id").orderBy(F.desc("priority"), "turn")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 8").drop("r")


@query("prj_26_asr_row_filter", A.sql("SELECT video_id, turn FROM turns WHERE (start_ms // 1000 % 10) / 10e0 <= 0.65e0 AND trim(text) <> '' AND start_seconds <= 120e0", "turns"))
def asr_row_filter(spark, sf_dir):
    return P.asr_rows(A.turns(spark, sf_dir).withColumn("no_speech_prob", F.expr("(start_ms div 1000 % 10) / 10D")), "no_speech_prob", "text", "start_seconds", 120.0).select("video_id", "turn")


@query("prj_28_caption_quality", A.sql("""
WITH w AS (SELECT video_id, turn, ws, len(ws) AS n, len(list_distinct(ws)) AS k FROM turns)
SELECT video_id, turn, n >= 3 AND (n < 6 OR k::DOUBLE / n >= 0.35e0) AS good FROM w""", "turns"))
def caption_quality(spark, sf_dir):
    return A.turns(spark, sf_dir).select("video_id", "turn", P.good_caption(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")), " ")).alias("good"))


@query("prj_30_validate_recommendations", A.sql("""
WITH c AS (SELECT video_id, scene_id, (cents % 140)::INT AS priority, event_type AS reason, event_type = 'click' AS unknown FROM shots),
k AS (SELECT c.video_id, c.scene_id, n FROM c, (SELECT unnest(range(1, 9)) AS n) WHERE EXISTS (SELECT 1 FROM c x WHERE x.video_id = c.video_id AND x.scene_id = c.scene_id + n AND NOT x.unknown))
SELECT c.video_id, c.scene_id, least(greatest(priority, 1), 100) AS priority, reason, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n), '') AS context FROM c LEFT JOIN (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY video_id, scene_id ORDER BY n) <= 4) k ON k.video_id = c.video_id AND k.scene_id = c.scene_id WHERE NOT unknown AND reason <> 'error' GROUP BY c.video_id, c.scene_id, priority, reason""", "shots"))
def validate_recommendations(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    made = s.select("video_id", "scene_id", (F.col("cents") % 140).cast("int").alias("priority"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("reason"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.col("scene_id") + n).alias("near"))
    got = P.valid_recommendations(made.union(made), s.where("event_type <> 'click'").select("video_id", "scene_id"), "near")
    return got.withColumn("context", F.array_join(F.transform("context", lambda x: (x - F.col("scene_id")).cast("string")), ","))


@query("prj_32_transition_type", A.sql("SELECT video_id, scene_id, CASE WHEN gap IS NULL THEN 'start' WHEN gap <= 2.5e0 THEN 'merge' WHEN gap < 30e0 THEN 'hard_cut' ELSE 'crossfade' END AS transition FROM (SELECT *, start_seconds - lag(end_seconds) OVER (PARTITION BY video_id ORDER BY scene_id) AS gap FROM shots WHERE action_score >= 0.5e0)", "shots"))
def transition_type(spark, sf_dir):
    s = A.shots(spark, sf_dir).where("action_score >= 0.5e0")
    return s.select(*ID, P.transition(F.col("start_seconds") - F.lag("end_seconds").over(W.by_scene())).alias("transition"))


@query("prj_36_document_content", A.sql("SELECT video_id, scene_id, 'Scene ' || scene_id || ' (' || event_type || '). Before: ' || coalesce(lag(event_type) OVER w, '-') || '. After: ' || coalesce(lead(event_type) OVER w, '-') || '.' AS content FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)", "shots"))
def document_content(spark, sf_dir):
    w = W.by_scene()
    before, after = F.coalesce(F.lag("event_type").over(w), F.lit("-")), F.coalesce(F.lead("event_type").over(w), F.lit("-"))
    return A.shots(spark, sf_dir).select(*ID, F.format_string("Scene %d (%s). Before: %s. After: %s.", "scene_id", "event_type", before, after).alias("content"))


_ASKED = {"action": ("code", "run"), "dialogue": ("write", "ask")}


@query("prj_14_request_words", A.sql(r"""
WITH r AS (SELECT conv_id, turn, text, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1000) AS request FROM conversations)
SELECT conv_id, turn, request, concat_ws(',', CASE WHEN contains(lower(request), 'code') OR contains(lower(request), 'run') THEN 'action' END, CASE WHEN contains(lower(request), 'write') OR contains(lower(request), 'ask') THEN 'dialogue' END) AS types,
 array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[,;\n]+'), lambda x: trim(x) <> '')[:12], lambda x: left(trim(x), 80)), '|') AS people, contains(lower(request), 'only ') OR contains(lower(request), 'the ') AS strict FROM r"""))
def request_words(spark, sf_dir):
    # the tables' conversations are invented: words that occur in them
    d = P.request(A.table(spark, sf_dir, "conversations"), "text", types=_ASKED, markers=("only ", "the "))
    return d.select("conv_id", "turn", "request", F.concat_ws(",", "types").alias("types"), F.array_join("people", "|").alias("people"), "strict")


@query("prj_29_payload", A.sql("SELECT video_id, turn, left(text, 300) AS a, left(text, 180) AS b FROM turns", "turns"))
def payload(spark, sf_dir):
    d = A.turns(spark, sf_dir).withColumn("payload", P.payload({"text": ("text", 300), "caption": ("text", 180)}))
    got = F.from_json("payload", "text string, caption string")
    return d.select("video_id", "turn", got["text"].alias("a"), got["caption"].alias("b"))


@query("prj_37_decorate_nested", A.sql("SELECT video_id, string_agg('/media/' || video_id || '/' || scene_id || '.jpg', ',' ORDER BY scene_id) AS urls FROM shots GROUP BY video_id", "shots"))
def decorate_nested(spark, sf_dir):
    g = A.shots(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("scene_id", F.lit("").alias("url")))).alias("scenes"))
    done = F.transform("scenes", lambda x: x.withField("url", F.format_string("/media/%d/%d.jpg", F.col("video_id"), x["scene_id"])))
    return g.select("video_id", F.array_join(F.transform(done, lambda x: x["url"]), ",").alias("urls"))


@query("prj_27_turning_points", A.sql("""
WITH t AS (SELECT *, (start_seconds + end_seconds) / 2e0 / max(end_seconds) OVER (PARTITION BY video_id) AS p, (turn % 10) / 10e0 AS event, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM turns),
r AS (SELECT * FROM (VALUES ('inciting_incident', 0.15e0, 0.30e0, ['the', 'la']), ('midpoint', 0.45e0, 0.55e0, ['of', 'de']), ('climax', 0.80e0, 0.95e0, ['and', 'le']), ('resolution', 0.85e0, 0.99e0, ['is', 'der'])) v(role, lo, hi, terms)),
m AS (SELECT t.*, role, len(list_filter(terms, lambda x: len(list_filter(w, lambda y: starts_with(y, x))) > 0)) AS n FROM t JOIN r ON p BETWEEN lo AND hi),
c AS (SELECT *, least(1e0, 0.45e0 + 0.35e0 * event + 0.20e0 * least(n, 2) / 2) AS sure FROM m WHERE n >= 1),
f AS (SELECT * FROM c WHERE sure >= 0.55e0),
k AS (SELECT video_id, p AS climax FROM f WHERE role = 'climax' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(sure, 3) DESC, event DESC, p, turn) = 1 AND n >= 2),
g AS (SELECT f.* FROM f LEFT JOIN k USING (video_id) WHERE role <> 'resolution' OR climax IS NULL OR p > climax)
SELECT video_id, role, turn, round(sure, 3) AS confidence, CASE WHEN n >= 2 THEN 'evidence_found' ELSE 'candidate_unverified' END AS status FROM g QUALIFY row_number() OVER (PARTITION BY video_id, role ORDER BY round(sure, 3) DESC, event DESC, p, turn) = 1""", "turns"))
def turning_points(spark, sf_dir):
    # the tables' words are invented: terms that occur in them
    terms = {"inciting_incident": ["the", "la"], "midpoint": ["of", "de"], "climax": ["and", "le"], "resolution": ["is", "der"]}
    return P.turning_points(A.turns(spark, sf_dir).withColumn("event", F.col("turn") % 10 / F.lit(10.0)), "text", "event", terms)


@query("sel_20_rank_after_rerank", A.sql("SELECT video_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(0.45e0 * narrative_score + 0.55e0 * emotion, 6) DESC, scene_id) AS r FROM shots) WHERE r <= 5", "shots"))
def rank_after_rerank(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("h", F.round(P.hybrid("narrative_score", "emotion", F.lit(False)), 6))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("h"), "scene_id"))).where("r <= 5").select(*ID)
