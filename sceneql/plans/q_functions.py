"""Queries of scalar functions (FN) over conversations, documents, shots and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.functions import vectors as V
from sceneql.plans import adapters as A
from sceneql.plans.registry import query

DANGLING, STARTERS = ["the", "of", "and", "de", "la", "und"], ["and", "et", "und", "y"]


def fn(name: str, sql: str, column, out: str):
    """A query of one expression over the turns of conversations."""

    @query(name, f"SELECT conv_id, turn, {sql} AS {out} FROM conversations")
    def f(spark, sf_dir):
        return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", column().alias(out))


_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LEX = r"regexp_extract_all(lower(text), '\p{L}+')"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
fn("fn_1_collapse_space", r"trim(regexp_replace(text, '\s+', ' ', 'g'))", lambda: T.collapse("text"), "s")
fn("fn_2_tokens", f"array_to_string({_TOK}, '|')", lambda: F.concat_ws("|", T.tokens("text")), "s")
fn("fn_3_lexical", f"array_to_string({_LEX}, '|')", lambda: F.concat_ws("|", T.lexical("text")), "s")
fn("fn_4_lower", "lower(text)", lambda: F.lower("text"), "s")
fn("fn_5_bigrams", f"array_to_string(list_transform(list_zip({_TOK}[:-2], {_TOK}[2:]), lambda p: p[1] || '::' || p[2]), '|')", lambda: F.concat_ws("|", T.bigrams(T.tokens("text"))), "s")
fn("fn_7_sentence_end", "regexp_matches(trim(text), '[.!?\u2026]+([\"''\u201d\u2019)\\]]+)?$')", lambda: T.ends_sentence("text"), "ends")
fn("fn_8_completeness", f"trim(text) <> '' AND NOT regexp_matches(trim(text), '[,;:]$') AND NOT coalesce({_LEX}[-1] IN {_in(DANGLING)}, false)", lambda: T.complete("text", DANGLING), "complete")
fn("fn_9_join_words", r"regexp_replace(array_to_string(string_split(replace(text, ',', ' ,'), ' '), ' '), '\s+([,.;:!?…])', '\1', 'g')", lambda: T.join_words(F.split(F.replace("text", F.lit(","), F.lit(" ,")), " ")), "s")
fn("fn_10_prefix_term", r"regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the')", lambda: T.has_prefix("text", "the"), "hit")
fn("fn_11_any_marker", "contains(lower(text), 'tion') OR contains(lower(text), 'ung') OR contains(lower(text), 'ment')", lambda: T.has_any("text", ["tion", "ung", "ment"]), "hit")
fn("fn_12_parse_timecode", "(turn % 60) * 60 + conv_id % 60", lambda: T.seconds_of(F.format_string("%02d:%02d", F.col("turn") % 60, F.col("conv_id") % 60)), "seconds")
fn("fn_14_slug", "left(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g')), 20)", lambda: T.slug("text"), "slug")
fn("fn_15_json_object", "'{\"t\":' || turn || '}'", lambda: T.first_object(F.concat(F.lit("noise "), F.to_json(F.struct(F.col("turn").alias("t"))), F.lit(' tail {"x": 1}'))), "obj")
fn("fn_16_config_hash", "sha256('{\"role\":\"' || role || '\",\"turn\":' || turn || '}')", lambda: T.config_hash(F.struct("role", "turn")), "hash")
fn("fn_17_fingerprint", "sha256(text)", lambda: F.sha2(F.col("text").cast("binary"), 256), "hash")
fn("fn_20_translate_label", "CASE WHEN contains(lower(role), 'use') THEN 'human' WHEN contains(lower(role), 'sys') THEN 'setup' ELSE role END", lambda: T.translate_event("role", [("use", "human"), ("sys", "setup")]), "label")
fn("fn_24_short_copy", r"array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[:5], ' ')", lambda: T.short_copy("text", 5), "s")


@query("fn_6_feature_hashing", rf"""
WITH t AS (SELECT DISTINCT unnest({_TOK}) AS w FROM conversations), h AS (SELECT w, sha256(w) AS h FROM t)
SELECT w AS token, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT) % 512 AS place, CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM h""")
def feature_hashing(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations").select(F.explode(T.tokens("text")).alias("token")).distinct()
    return t.select("token", T.hash_place(F.col("token")).alias("place"), T.hash_sign(F.col("token")).alias("sign"))


@query("fn_13_timecode", A.sql("SELECT video_id, scene_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code FROM (SELECT *, round(start_seconds * 1000)::BIGINT AS ms FROM shots)", "shots"))
def timecode(spark, sf_dir):
    return A.shots(spark, sf_dir).select("video_id", "scene_id", T.timecode("start_seconds").alias("code"))


@query("fn_18_cosine", A.sql("SELECT a.kf_id, b.kf_id AS other, round(least(greatest(list_cosine_similarity(a.vec, b.vec), 0e0), 1e0), 6) AS unit, round(least(greatest(list_cosine_similarity(a.vec, b.vec), -1e0), 1e0), 6) AS signed FROM vectors a JOIN vectors b ON a.video_id = b.video_id WHERE a.kf_id < b.kf_id", "vectors"))
def cosine(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    a = v.select("video_id", "kf_id", "vec")
    b = v.select("video_id", F.col("kf_id").alias("other"), F.col("vec").alias("ov"))
    return a.join(b, "video_id").where("kf_id < other").select("kf_id", "other", F.round(V.cosine("vec", "ov"), 6).alias("unit"), F.round(V.cosine("vec", "ov", -1.0), 6).alias("signed"))


@query("fn_19_normalise", A.sql("SELECT kf_id, round(list_sum(list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))), 6) AS total FROM vectors", "vectors"))
def normalise(spark, sf_dir):
    return A.vectors(spark, sf_dir).withColumn("u", V.normalise("vec")).select("kf_id", F.round(V.total("u"), 6).alias("total"))


@query("fn_21_overlap_length", A.sql("SELECT video_id, scene_id, round(greatest(0e0, least(end_seconds, start_seconds + 7e0) - greatest(start_seconds, 3e0)), 6) AS seconds FROM shots", "shots"))
def overlap_length(spark, sf_dir):
    length = F.greatest(F.lit(0.0), F.least(F.col("end_seconds"), F.col("start_seconds") + 7.0) - F.greatest(F.col("start_seconds"), F.lit(3.0)))
    return A.shots(spark, sf_dir).select("video_id", "scene_id", F.round(length, 6).alias("seconds"))


@query("fn_22_robust_scale", A.sql("WITH p AS (SELECT video_id, quantile_cont(duration_seconds, 0.02) AS lo, quantile_cont(duration_seconds, 0.98) AS hi FROM shots GROUP BY video_id) SELECT video_id, scene_id, round(0.06e0 + 0.88e0 * least(greatest((duration_seconds - lo) / (hi - lo), 0e0), 1e0), 6) AS scaled FROM shots JOIN p USING (video_id)", "shots"))
def robust_scale(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    p = s.groupBy("video_id").agg(F.percentile("duration_seconds", F.lit(0.02)).alias("lo"), F.percentile("duration_seconds", F.lit(0.98)).alias("hi"))
    x = F.least(F.greatest((F.col("duration_seconds") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return s.join(p, "video_id").select("video_id", "scene_id", F.round(0.06 + 0.88 * x, 6).alias("scaled"))


@query("fn_23_compact_vector", A.sql("SELECT video_id, scene_id, round(list_sum([clip_action, clip_dialogue, narrative_score, energy, speech_ratio, least(duration_seconds / 20e0, 1e0), least(greatest((start_seconds + end_seconds) / 2e0 / video_duration, 0e0), 1e0)]), 6) AS total FROM shots", "shots"))
def compact_vector(spark, sf_dir):
    mid = F.least(F.greatest((F.col("start_seconds") + F.col("end_seconds")) / 2 / F.col("video_duration"), F.lit(0.0)), F.lit(1.0))
    v = F.array("clip_action", "clip_dialogue", "narrative_score", "energy", "speech_ratio", F.least(F.col("duration_seconds") / 20, F.lit(1.0)), mid)
    return A.shots(spark, sf_dir).select("video_id", "scene_id", F.round(V.total(v), 6).alias("total"))
