"""Queries of similarity, retrieval, clustering and projection (SIM)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.functions import vectors as V
from sceneql.operators import clusters as C
from sceneql.operators import intervals as I
from sceneql.operators import joins as J
from sceneql.operators import retrieval as R
from sceneql.operators.groups import by_arrays, by_group
from sceneql.plans import adapters as A
from sceneql.plans.registry import query


def _pair(v, left, right):
    a = v.where(left).select("video_id", "kf_id", "label", "vec")
    b = v.where(right).select("video_id", F.col("kf_id").alias("other"), F.col("label").alias("other_label"), F.col("vec").alias("ov"))
    return a, b


@query("sim_1_bank_scores", A.sql("SELECT v.kf_id, p.kf_id // 3 AS bank, round(max(list_dot_product(v.vec, p.vec)), 6) AS score FROM vectors v, vectors p WHERE p.kf_id < 9 GROUP BY ALL", "vectors"))
def bank_scores(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id < 9").select(F.expr("kf_id div 3").alias("bank"), F.col("vec").alias("pv"))
    return v.join(F.broadcast(p)).groupBy("kf_id", "bank").agg(F.round(F.max(V.dot("vec", "pv")), 6).alias("score"))  # nine rows


@query("sim_2_contrastive_query", A.sql("SELECT v.kf_id, round(list_dot_product(v.vec, t.vec) - 0.35e0 * list_dot_product(v.vec, n.vec), 6) AS score FROM vectors v, vectors t, vectors n WHERE t.kf_id = 0 AND n.kf_id = 1", "vectors"))
def contrastive_query(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id = 0").select(F.col("vec").alias("t")).crossJoin(v.where("kf_id = 1").select(F.col("vec").alias("n")))  # one row
    return v.join(F.broadcast(p)).select("kf_id", F.round(V.dot("vec", "t") - 0.35 * V.dot("vec", "n"), 6).alias("score"))


@query("sim_3_zero_shot", A.sql("SELECT kf_id, arg_max(prompt, (s, -prompt)) AS prompt FROM (SELECT v.kf_id, p.kf_id AS prompt, list_dot_product(v.vec, p.vec) AS s FROM vectors v, vectors p WHERE p.kf_id < 9) GROUP BY kf_id", "vectors"))
def zero_shot(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id < 9").select(F.col("kf_id").alias("prompt"), F.col("vec").alias("pv"))
    s = v.join(F.broadcast(p)).select("kf_id", "prompt", V.dot("vec", "pv").alias("s"))  # nine rows
    return s.groupBy("kf_id").agg(F.max_by("prompt", F.struct(F.col("s"), -F.col("prompt"))).alias("prompt"))


def _tfidf_sql(grams: str, most: int | None, tf: str) -> str:
    """Weights of the tokens that `grams` makes of a text, by conversation; the `most` commonest tokens alone."""
    cap = f"QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sum(tf) DESC, encode(token)) <= {most}" if most else ""
    return rf"""
WITH t AS (SELECT conv_id, turn, unnest({grams}) AS token FROM conversations), tf AS (SELECT conv_id, turn, token, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT conv_id, token, count(*) AS df FROM tf GROUP BY conv_id, token {cap}), n AS (SELECT conv_id, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id),
w AS (SELECT tf.conv_id, turn, token, {tf} * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (conv_id, token) JOIN n USING (conv_id)),
v AS (SELECT conv_id, turn, token, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS weight FROM w)
"""


_WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_PAIRS_SQL = f"list_concat({_WORDS_SQL}, list_transform(list_zip({_WORDS_SQL}[:-2], {_WORDS_SQL}[2:]), lambda x: x[1] || ' ' || x[2]))"
_CHARS_SQL = (
    r"flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: list_concat("
    + ", ".join(f"CASE WHEN {k} = 3 OR len(w) + 2 > {k - 1} THEN list_transform(range(1, greatest(len(w) + 2 - {k - 1}, 1)::BIGINT + 1), lambda i: substr(' ' || w || ' ', i, {k})) ELSE [] END" for k in (3, 4, 5)) + ")))"
)


def _weights(spark, sf_dir):
    return R.tfidf(A.table(spark, sf_dir, "conversations"), "turn", T.word_grams("text"), ["conv_id"])


@query("sim_4_tfidf", _tfidf_sql(_PAIRS_SQL, None, "(1 + ln(tf))") + "SELECT conv_id, turn, token, round(weight, 6) AS weight FROM v")
def tfidf(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query("sim_4_tfidf_capped", _tfidf_sql(_WORDS_SQL, 64, "tf") + "SELECT conv_id, turn, token, round(weight, 6) AS weight FROM v")
def tfidf_capped(spark, sf_dir):
    # the conversations are short: 64 words stand for the 512 of long films, so that the cap acts
    w = R.tfidf(A.table(spark, sf_dir, "conversations"), "turn", T.tokens("text"), ["conv_id"], 64, False)
    return w.withColumn("weight", F.round("weight", 6))


@query("sim_5_relevance", _tfidf_sql(_CHARS_SQL, 2048, "tf") + ", s AS (SELECT a.conv_id, a.turn, sum(a.weight * b.weight) AS s FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.token = b.token AND b.turn = 0 AND a.turn > 0 GROUP BY ALL) SELECT conv_id, turn, round(CASE WHEN max(s) OVER p > min(s) OVER p THEN (s - min(s) OVER p) / (max(s) OVER p - min(s) OVER p) ELSE 0.5e0 END, 6) AS relevance FROM s WINDOW p AS (PARTITION BY conv_id)")
def relevance(spark, sf_dir):
    from sceneql.operators.topk import min_max

    s = R.similar_to(A.table(spark, sf_dir, "conversations"), "turn", "text", T.char_grams, "conv_id", 0, 2048).where("turn > 0")
    return min_max(s, "similarity", "relevance", 0.5, ["conv_id"]).select("conv_id", "turn", F.round("relevance", 6).alias("relevance"))


@query("sim_6_hybrid_retrieval", A.sql("WITH s AS (SELECT q.kf_id, c.kf_id AS doc, 0.70e0 * greatest(0e0, list_dot_product(q.vec, c.vec)) + 0.25e0 * greatest(0e0, CASE WHEN q.label = c.label THEN 1e0 ELSE 0e0 END) + 0.05e0 * greatest(0e0, 1e0 - abs(q.kf_id - c.kf_id) / 500e0) AS s FROM vectors q JOIN vectors c ON q.kf_id <> c.kf_id WHERE q.kf_id % 100 = 0) SELECT kf_id, doc, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY kf_id ORDER BY round(s, 9) DESC, doc) AS r FROM s) WHERE r <= 5", "vectors"))
def hybrid_retrieval(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    q = v.where("kf_id % 100 = 0").select("kf_id", "label", "vec")
    c = v.select(F.col("kf_id").alias("doc"), F.col("label").alias("doc_label"), F.col("vec").alias("dv"))
    # a stated set of queries against all rows, in blocks
    s = R.top_hybrid(q, c, ["kf_id", "label", "vec"], ["doc", "doc_label", "dv"], 500.0, 5)
    return s.select("kf_id", "doc", F.round("s", 6).alias("score"))


@query("sim_7_cosine_top_k", A.sql("SELECT kf_id, doc, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY kf_id ORDER BY s DESC, doc) AS r FROM (SELECT q.kf_id, c.kf_id AS doc, list_cosine_similarity(q.vec, c.vec) AS s FROM vectors q, vectors c)) WHERE r <= 10", "vectors"))
def cosine_top_k(spark, sf_dir):
    got = R.neighbours(A.vectors(spark, sf_dir), "kf_id", "vec", "doc", 10)
    return got.select("kf_id", "doc", F.round("similarity", 6).alias("similarity"))


@query("sim_8_related_context", A.sql("SELECT kf_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY kf_id ORDER BY s DESC, doc) AS r FROM (SELECT q.kf_id, c.kf_id AS doc, list_cosine_similarity(q.vec, c.vec) AS s FROM vectors q JOIN vectors c ON q.video_id = c.video_id AND q.scene_id <> c.scene_id)) WHERE r <= 2", "vectors"))
def related_context(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    b = v.select("video_id", F.col("kf_id").alias("doc"), F.col("scene_id").alias("story"), F.col("vec").alias("dv"))
    s = v.join(b, "video_id").where("scene_id <> story").withColumn("s", V.cosine("vec", "dv", -1.0))
    w = Window.partitionBy("kf_id").orderBy(F.desc("s"), "doc")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 2").select("kf_id", "doc")


@query("sim_9_uniqueness", A.sql("WITH u AS (SELECT a.video_id, a.kf_id, 1e0 - max(0.78e0 * greatest(0e0, list_dot_product(a.vec, b.vec)) + 0.22e0 * (a.label = b.label)::INT) AS u FROM vectors a JOIN vectors b ON a.video_id = b.video_id AND a.kf_id <> b.kf_id GROUP BY ALL) SELECT kf_id, round(CASE WHEN max(u) OVER p > min(u) OVER p THEN (u - min(u) OVER p) / (max(u) OVER p - min(u) OVER p) ELSE 0.5e0 END, 6) AS uniqueness FROM u WINDOW p AS (PARTITION BY video_id)", "vectors"))
def uniqueness(spark, sf_dir):
    from sceneql.operators.topk import min_max

    a, b = _pair(A.vectors(spark, sf_dir), "true", "true")
    s = a.join(b, "video_id").where("kf_id <> other").select("video_id", "kf_id", (0.78 * F.greatest(F.lit(0.0), V.dot("vec", "ov")) + 0.22 * (F.col("label") == F.col("other_label")).cast("int")).alias("s"))
    u = s.groupBy("video_id", "kf_id").agg((1.0 - F.max("s")).alias("u"))
    return min_max(u, "u", "uniqueness", 0.5).select("kf_id", F.round("uniqueness", 6).alias("uniqueness"))


@query("sim_10_plane")
def plane(spark, sf_dir):
    return R.plane(A.vectors(spark, sf_dir), "kf_id", "vec")[0]


@query("sim_10_story_points")
def story_points(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    points, shares = R.plane(v, "kf_id", "vec")
    return R.centroids(points.join(v.select("kf_id", "scene_id"), "kf_id"), "scene_id").select("*", F.lit(shares[0]).alias("first_share"), F.lit(shares[1]).alias("second_share"))


@query("sim_11_face_clusters")
def face_clusters(spark, sf_dir):
    def f(rows):
        return [{"kf_id": r["kf_id"], "cluster": c} for r, c in zip(rows, C.agglomerate([r["vec"] for r in rows], 0.42))]

    return by_group(A.vectors(spark, sf_dir), ["video_id"], ["kf_id"], ["vec"], f, "kf_id bigint, cluster int")


@query("sim_12_cluster_merge")
def cluster_merge(spark, sf_dir):
    def f(rows):
        first = C.agglomerate([r["vec"] for r in rows], 0.42)
        frames = [(r["scene_id"], r["kf_id"]) for r in rows]
        return [{"kf_id": r["kf_id"], "cluster": c} for r, c in zip(rows, C.merge_clusters([r["vec"] for r in rows], first, frames))]

    return by_group(A.vectors(spark, sf_dir), ["video_id"], ["kf_id"], ["scene_id", "vec"], f, "kf_id bigint, cluster int")


@query("sim_13_identity_hints", A.sql("WITH s AS (SELECT a.kf_id AS x, b.kf_id AS y, list_dot_product(a.vec, b.vec) AS s FROM vectors a JOIN vectors b ON a.video_id = b.video_id AND a.kf_id <> b.kf_id), b AS (SELECT x, arg_max(y, (s, -y)) AS y FROM s WHERE s >= 0.42e0 GROUP BY x) SELECT p.x AS l, p.y AS r FROM b p JOIN b q ON p.x = q.y AND p.y = q.x WHERE p.x < p.y", "vectors"))
def identity_hints(spark, sf_dir):
    a, b = _pair(A.vectors(spark, sf_dir), "true", "true")
    s = a.join(b, "video_id").where("kf_id <> other").select("kf_id", "other", V.dot("vec", "ov").alias("s"))
    return R.mutual_best(s, "kf_id", "other", "s", 0.42)


@query("sim_14_voice_clusters")
def voice_clusters(spark, sf_dir):
    return by_group(A.vectors(spark, sf_dir), ["video_id"], ["kf_id"], ["vec"], lambda rows: [{"kf_id": r["kf_id"], "voice": c} for r, c in zip(rows, C.voices([r["vec"] for r in rows]))], "kf_id bigint, voice int")


def _voiced(spark, sf_dir):
    """Turns of the keyframes' vectors: they follow each other, .2 to 1.4 s long, and every third runs into the next."""
    length = 0.2 + 0.2 * (F.col("kf_id") % 7)
    w = Window.partitionBy("video_id").orderBy("kf_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.round(F.coalesce(F.sum(length).over(w), F.lit(0.0)), 3)
    v = A.vectors(spark, sf_dir).withColumn("start_seconds", start).withColumn("end_seconds", F.round(start + length + F.when(F.col("kf_id") % 3 == 0, 0.15).otherwise(0.0), 3))
    return v.select("video_id", "kf_id", "start_seconds", "end_seconds", F.concat(F.lit("S_"), F.col("label") % 5).alias("speaker"), "vec")


@query("sim_15_speaker_correction")
def speaker_correction(spark, sf_dir):
    t = _voiced(spark, sf_dir)
    said = t.select("video_id", F.col("kf_id").alias("_other"), F.col("speaker").alias("_who"), F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"))
    at_once = J.overlap_join(t.select("video_id", "kf_id", "start_seconds", "end_seconds"), said, ["video_id"], "start_seconds", "end_seconds", "_s", "_e", 10.0).where("kf_id <> _other")
    busy = at_once.groupBy("video_id", "kf_id").agg(F.collect_set("_who").alias("busy"))

    def f(g):
        r = g["turns"]
        w = np.minimum(5.0, r["end_seconds"] - r["start_seconds"])
        taken = [set() if b is None else set(b) for b in r["busy"]]
        return list(zip(r["kf_id"].tolist(), C.reassign(np.stack(r["vec"]), r["speaker"].tolist(), w, taken)))

    return by_arrays({"turns": (t.join(busy, ["video_id", "kf_id"], "left"), ["kf_id"])}, ["video_id"], f, "kf_id bigint, speaker string")


@query("sim_16_correction_chain")
def correction_chain(spark, sf_dir):
    t = _voiced(spark, sf_dir)
    both = I.overlap_regions(t, ["video_id"], "start_seconds", "end_seconds", "speaker").select("video_id", F.split("speakers", r"\|").alias("who"))
    pairs = both.select("video_id", "who", F.explode("who").alias("a")).select("video_id", "a", F.explode("who").alias("b")).where("a < b").distinct()
    return C.corrected_turns(t, pairs)


@query("sim_17_histogram_distance", A.sql("WITH h AS (SELECT kf_id, video_id, list_transform(vec, lambda x: abs(x)) AS h FROM vectors) SELECT a.kf_id, b.kf_id AS other, round(sqrt(greatest(0e0, 1e0 - list_sum(list_transform(list_zip(a.h, b.h), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(a.h) * list_sum(b.h)))), 5) AS distance FROM h a JOIN h b ON a.video_id = b.video_id WHERE a.kf_id < b.kf_id", "vectors"))
def histogram_distance(spark, sf_dir):
    v = A.vectors(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.abs(x.cast("double"))))
    a, b = _pair(v, "true", "true")
    return a.join(b, "video_id").where("kf_id < other").select("kf_id", "other", F.round(V.bhattacharyya("vec", "ov"), 5).alias("distance"))


@query("sim_18_face_quality", A.sql("SELECT video_id, story_id, scene_id, round(q, 6) AS quality FROM (SELECT *, 0.45e0 * energy + 0.25e0 * onset + 0.20e0 * emotion + 0.10e0 * action_score AS q, row_number() OVER (PARTITION BY video_id, story_id ORDER BY 0.45e0 * energy + 0.25e0 * onset + 0.20e0 * emotion + 0.10e0 * action_score DESC, scene_id) AS r FROM shots) WHERE r = 1", "shots"))
def face_quality(spark, sf_dir):
    s = A.shots(spark, sf_dir).withColumn("q", 0.45 * F.col("energy") + 0.25 * F.col("onset") + 0.20 * F.col("emotion") + 0.10 * F.col("action_score"))
    best = s.groupBy("video_id", "story_id").agg(F.max_by(F.struct("scene_id", "q"), F.struct(F.col("q"), -F.col("scene_id"))).alias("b"))
    return best.select("video_id", "story_id", F.col("b.scene_id").alias("scene_id"), F.round("b.q", 6).alias("quality"))
