"""Queries of aggregations (AGG), top-k (TOP) and set operations (SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import vectors as V
from sceneql.functions import vocabularies as L
from sceneql.operators import joins as J
from sceneql.operators import scoring as P
from sceneql.operators import evaluate as E
from sceneql.operators import topk as K
from sceneql.plans import adapters as A
from sceneql.plans.registry import query


@query("agg_1_mean_similarity", A.sql("WITH p AS (SELECT vec AS pv FROM vectors WHERE kf_id = 0), m AS (SELECT scene_id, avg(list_dot_product(vec, pv)) AS s FROM vectors, p WHERE label <> 3 GROUP BY scene_id) SELECT v.scene_id, round(coalesce(any_value(s), 0.20e0), 6) AS similarity FROM (SELECT DISTINCT scene_id FROM vectors) v LEFT JOIN m USING (scene_id) GROUP BY v.scene_id", "vectors"))
def mean_similarity(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id = 0").select(F.col("vec").alias("pv"))
    m = v.where("label <> 3").join(F.broadcast(p)).groupBy("scene_id").agg(F.avg(V.dot("vec", "pv")).alias("s"))  # one row
    return v.select("scene_id").distinct().join(m, "scene_id", "left").select("scene_id", F.round(F.coalesce("s", F.lit(0.20)), 6).alias("similarity"))


@query("agg_2_mean_vector", A.sql("WITH e AS (SELECT scene_id, unnest(vec) AS x, unnest(range(64)) AS i FROM vectors), m AS (SELECT scene_id, i, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT scene_id, sqrt(sum(x * x)) AS n FROM m GROUP BY scene_id) SELECT scene_id, i AS dim, round(CASE WHEN n > 1e-12 THEN x / n ELSE x END, 5) AS x FROM m JOIN n USING (scene_id)", "vectors"))
def mean_vector(spark, sf_dir):
    g = A.vectors(spark, sf_dir).groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kf_id", "vec"))), lambda x: x["vec"]).alias("vs"))
    d = g.withColumn("m", V.mean_vector("vs", 64)).withColumn("u", V.normalise("m"))
    return d.select("scene_id", F.posexplode("u").alias("dim", "x")).select("scene_id", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


@query("agg_3_bank_maximum", A.sql("WITH p AS (SELECT kf_id AS b, vec AS pv FROM vectors WHERE kf_id < 4) SELECT scene_id, round(max(s), 6) AS best FROM (SELECT scene_id, b, avg(list_dot_product(vec, pv)) AS s FROM vectors, p GROUP BY ALL) GROUP BY scene_id", "vectors"))
def bank_maximum(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id < 4").select(F.col("kf_id").alias("b"), F.col("vec").alias("pv"))
    return v.join(F.broadcast(p)).groupBy("scene_id", "b").agg(F.avg(V.dot("vec", "pv")).alias("s")).groupBy("scene_id").agg(F.round(F.max("s"), 6).alias("best"))  # four rows


@query("agg_4_peak_similarity", A.sql("WITH p AS (SELECT a.vec AS t, b.vec AS n FROM vectors a, vectors b WHERE a.kf_id = 0 AND b.kf_id = 1) SELECT scene_id, round(max(list_dot_product(vec, t)), 6) AS raw, round(max(list_dot_product(vec, t) - 0.35e0 * list_dot_product(vec, n)), 6) AS contrastive FROM vectors, p GROUP BY scene_id", "vectors"))
def peak_similarity(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    p = v.where("kf_id = 0").select(F.col("vec").alias("t")).crossJoin(v.where("kf_id = 1").select(F.col("vec").alias("n")))  # one row
    d = v.join(F.broadcast(p)).withColumn("a", V.dot("vec", "t")).withColumn("b", V.dot("vec", "n"))
    return d.groupBy("scene_id").agg(F.round(F.max("a"), 6).alias("raw"), F.round(F.max(F.col("a") - 0.35 * F.col("b")), 6).alias("contrastive"))


@query("agg_5_energy_by_shot", A.sql("SELECT s.video_id, s.scene_id, round(avg(r.energy), 6) AS mean, round(max(r.energy), 6) AS peak FROM shots s JOIN shots r ON s.video_id = r.video_id AND r.start_seconds >= s.start_seconds AND r.start_seconds <= s.end_seconds GROUP BY ALL", "shots"))
def energy_by_shot(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    r = s.select("video_id", F.col("start_seconds").alias("t"), "energy")
    pairs = J.overlap_join(s.select("video_id", "scene_id", "start_seconds", "end_seconds"), r.withColumn("t2", F.col("t")), ["video_id"], "start_seconds", "end_seconds", "t", "t2", 30.0, -1e-9)
    return pairs.groupBy("video_id", "scene_id").agg(F.round(F.avg("energy"), 6).alias("mean"), F.round(F.max("energy"), 6).alias("peak"))


@query("agg_6_onset_contrast", A.sql("""
WITH s AS (SELECT story_id, video_id, scene_id, energy, row_number() OVER (PARTITION BY video_id, story_id ORDER BY scene_id) AS r, count(*) OVER (PARTITION BY video_id, story_id) AS n FROM shots),
g AS (SELECT video_id, story_id, max(energy) FILTER (r <= greatest(1, n // 3)) AS peak, avg(energy) AS mean FROM s GROUP BY ALL),
p AS (SELECT *, coalesce(lag(mean) OVER (PARTITION BY video_id ORDER BY story_id), mean) AS quiet FROM g)
SELECT video_id, story_id, round(greatest(0e0, (peak - quiet) / greatest(peak, 1e-6)), 6) AS contrast FROM p""", "shots"))
def onset_contrast(spark, sf_dir):
    w = Window.partitionBy("video_id", "story_id")
    s = A.shots(spark, sf_dir).withColumn("r", F.row_number().over(w.orderBy("scene_id"))).withColumn("n", F.count("*").over(w))
    g = s.groupBy("video_id", "story_id").agg(F.max(F.when(F.col("r") <= F.greatest(F.lit(1), F.expr("n div 3")), F.col("energy"))).alias("peak"), F.avg("energy").alias("mean"))
    quiet = F.coalesce(F.lag("mean").over(Window.partitionBy("video_id").orderBy("story_id")), F.col("mean"))
    return g.withColumn("quiet", quiet).select("video_id", "story_id", F.round(F.greatest(F.lit(0.0), (F.col("peak") - F.col("quiet")) / F.greatest("peak", F.lit(1e-6))), 6).alias("contrast"))


@query("agg_7_min_max", A.sql("SELECT video_id, scene_id, round((energy - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END, 6) AS flat_zero, round(CASE WHEN hi > lo THEN (energy - lo) / (hi - lo) ELSE 1e0 END, 6) AS flat_one, round(CASE WHEN hi > lo THEN (energy - lo) / (hi - lo) ELSE 0.5e0 END, 6) AS flat_half FROM (SELECT *, min(energy) OVER (PARTITION BY video_id) AS lo, max(energy) OVER (PARTITION BY video_id) AS hi FROM shots)", "shots"))
def min_max(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    for out, flat in (("flat_zero", 0.0), ("flat_one", 1.0), ("flat_half", 0.5)):
        s = K.min_max(s, "energy", out, flat)
    return s.select("video_id", "scene_id", *[F.round(c, 6).alias(c) for c in ("flat_zero", "flat_one", "flat_half")])


@query("agg_8_speech_time", A.sql("""
WITH f AS (SELECT *, max(end_seconds) OVER (PARTITION BY video_id, turn ORDER BY start_seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM words),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start_seconds > far THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, turn ORDER BY start_seconds ROWS UNBOUNDED PRECEDING) AS k FROM f),
m AS (SELECT video_id, turn, min(start_seconds) AS a, max(end_seconds) AS z, count(*) AS n FROM g GROUP BY video_id, turn, k)
SELECT video_id, turn, round(sum(z - a), 4) AS seconds, sum(n)::BIGINT AS words FROM m GROUP BY ALL""", "words"))
def speech_time(spark, sf_dir):
    from sceneql.operators import intervals as I

    m = I.merge(A.words(spark, sf_dir), ["video_id", "turn"], "start_seconds", "end_seconds")
    return m.groupBy("video_id", "turn").agg(F.round(F.sum(F.col("end_seconds") - F.col("start_seconds")), 4).alias("seconds"), F.sum("n").alias("words"))


@query("agg_9_dominant_mode", A.sql("SELECT video_id, story_id, CASE WHEN sum(speech_ratio * duration_seconds) / greatest(sum(duration_seconds), 0.001e0) >= 0.55e0 THEN 'dialogue' WHEN sum(energy * duration_seconds) / greatest(sum(duration_seconds), 0.001e0) >= 0.60e0 THEN 'action_audio' ELSE 'mixed' END AS mode FROM shots GROUP BY ALL", "shots"))
def dominant_mode(spark, sf_dir):
    weigh = lambda c: F.sum(F.col(c) * F.col("duration_seconds")) / F.greatest(F.sum("duration_seconds"), F.lit(0.001))
    return A.shots(spark, sf_dir).groupBy("video_id", "story_id").agg(F.when(weigh("speech_ratio") >= 0.55, "dialogue").when(weigh("energy") >= 0.60, "action_audio").otherwise("mixed").alias("mode"))


@query("agg_10_adaptive_threshold", A.sql("SELECT video_id, round(least(greatest(median(action_score) + 0.15e0 * stddev_pop(action_score), 0.46e0), 0.68e0), 6) AS threshold FROM shots GROUP BY video_id", "shots"))
def adaptive_threshold(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id").agg(F.round(P.clip(F.median("action_score") + 0.15 * F.stddev_pop("action_score"), 0.46, 0.68), 6).alias("threshold"))


@query("agg_11_mad_threshold", A.sql("WITH m AS (SELECT video_id, median(energy) AS med FROM shots GROUP BY video_id) SELECT s.video_id, round(least(0.72e0, greatest(0.20e0, any_value(med) + greatest(0.08e0, 5.5e0 * median(abs(energy - med))))), 6) AS threshold FROM shots s JOIN m USING (video_id) GROUP BY s.video_id", "shots"))
def mad_threshold(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    m = s.groupBy("video_id").agg(F.median("energy").alias("med"))
    mad = s.join(m, "video_id").groupBy("video_id").agg(F.max("med").alias("med"), F.median(F.abs(F.col("energy") - F.col("med"))).alias("mad"))
    return mad.select("video_id", F.round(F.least(F.lit(0.72), F.greatest(F.lit(0.20), F.col("med") + F.greatest(F.lit(0.08), 5.5 * F.col("mad")))), 6).alias("threshold"))


@query("agg_12_distinct_speakers", A.sql("SELECT video_id, story_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM shots GROUP BY ALL", "shots"))
def distinct_speakers(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id", "story_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("kinds"))


@query("agg_13_ordered_distinct_text", A.sql("SELECT video_id, story_id, string_agg(event_type, ' ' ORDER BY scene_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY video_id, story_id, lower(event_type) ORDER BY scene_id) AS r FROM shots) WHERE r = 1 GROUP BY ALL", "shots"))
def ordered_distinct_text(spark, sf_dir):
    return K.distinct_text(A.shots(spark, sf_dir), ["video_id", "story_id"], "event_type", "scene_id", " ", "text")


@query("agg_14_segment_score", A.sql("SELECT video_id, story_id, round(0.60e0 * max(narrative_score) + 0.40e0 * avg(narrative_score), 6) AS score FROM shots GROUP BY ALL", "shots"))
def segment_score(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id", "story_id").agg(F.round(0.60 * F.max("narrative_score") + 0.40 * F.avg("narrative_score"), 6).alias("score"))


@query("agg_15_cue_counts", A.sql("SELECT video_id, turn, least(4, list_count(list_filter(['the', 'de', 'th', 'le', 'er', 'en'], lambda c: len(list_filter(ws, lambda t: starts_with(lower(t), c))) > 0))) AS cues FROM turns", "turns"))
def cue_counts(spark, sf_dir):
    tokens = F.split(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))), " ")
    return A.turns(spark, sf_dir).select("video_id", "turn", F.least(F.lit(4), K.cues(tokens, ["the", "de", "th", "le", "er", "en"])).cast("long").alias("cues"))


@query("agg_16_screen_time", A.sql("""
WITH h AS (SELECT video_id, story_id, event_type AS actor, count(DISTINCT scene_id) AS hits FROM shots GROUP BY ALL), c AS (SELECT video_id, story_id, sum(duration_seconds) AS d, count(*) AS k FROM shots GROUP BY ALL),
t AS (SELECT h.video_id, actor, sum(d * hits / k) AS seconds, count(*) AS n FROM h JOIN c ON c.video_id = h.video_id AND c.story_id = h.story_id GROUP BY ALL),
f AS (SELECT t.*, n >= greatest(2, ceil(0.2e0 * m)) AS ok FROM t JOIN (SELECT video_id, count(*) AS m FROM c GROUP BY video_id) USING (video_id)),
r AS (SELECT *, bool_or(ok) OVER (PARTITION BY video_id) AS hits FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(seconds, 6) DESC, actor) AS rank FROM r WHERE ok OR NOT hits)
SELECT video_id, actor, round(seconds, 6) AS seconds, n, rank::INTEGER AS rank, CASE WHEN rank <= 3 THEN 'lead' ELSE 'support' END AS role FROM o WHERE rank <= CASE WHEN hits THEN 4 ELSE 3 END""", "shots"))
def screen_time(spark, sf_dir):
    # a story is a scene, its shots are the samples; a fifth of the scenes and four actors, so that floor and limit act
    s = A.shots(spark, sf_dir)
    seen = s.select("video_id", F.col("story_id").alias("scene_id"), F.col("scene_id").alias("sample"), F.col("event_type").alias("actor"))
    scenes = s.groupBy("video_id", F.col("story_id").alias("scene_id")).agg(F.sum("duration_seconds").alias("duration_seconds"), F.count("*").alias("samples"))
    return K.screen_time(seen, scenes, 0.2, 4).withColumn("seconds", F.round("seconds", 6))


@query("agg_17_majority_vote", A.sql("""
WITH c AS (SELECT video_id, speaker, floor(price / 60000)::BIGINT AS actor, count(*) AS n FROM spans GROUP BY ALL),
s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY video_id, speaker) AS share, row_number() OVER (PARTITION BY video_id, speaker ORDER BY n DESC, actor) AS r FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id, actor ORDER BY share DESC, n DESC, speaker DESC) AS k FROM s WHERE r = 1 AND n >= 2 AND share >= 0.28e0)
SELECT video_id, speaker, actor, n, round(share, 6) AS share FROM o WHERE k = 1""", "spans"))
def majority_vote(spark, sf_dir):
    # prices are spread evenly, so no share reaches .72 here: .28, that votes are won and lost
    s = A.spans(spark, sf_dir).withColumn("actor", F.floor(F.col("price") / 60000))
    return K.majority(s, ["video_id", "speaker"], "actor", 2, 0.28, once=True).withColumn("share", F.round("share", 6))


@query("agg_18_purity", A.sql("SELECT video_id, round(max(n)::DOUBLE / sum(n), 6) AS purity FROM (SELECT video_id, event_type, count(*) AS n FROM shots GROUP BY ALL) GROUP BY video_id", "shots"))
def purity(spark, sf_dir):
    c = A.shots(spark, sf_dir).groupBy("video_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("video_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


@query("agg_19_prototypes", A.sql("WITH e AS (SELECT label, least(5, kf_id % 9 + 1)::DOUBLE AS w, unnest(vec) AS x, unnest(range(64)) AS i FROM vectors), m AS (SELECT label, i, sum(x * w) / sum(w) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT label, i AS dim, round(x / n, 5) AS x FROM m JOIN n USING (label)", "vectors"))
def prototypes(spark, sf_dir):
    v = A.vectors(spark, sf_dir).withColumn("w", F.least(F.lit(5), F.col("kf_id") % 9 + 1).cast("double"))
    e = v.select("label", "w", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    n = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label")))
    return e.select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("x") / n, 5).alias("x"))


@query("agg_20_act_seconds", A.sql("WITH a AS (SELECT * FROM (VALUES ('act_i', 0e0, 0.25e0), ('act_ii', 0.25e0, 0.75e0), ('act_iii', 0.75e0, 1e0)) t(act, lo, hi)) SELECT video_id, act, round(sum(greatest(0e0, least(end_seconds, hi * video_duration) - greatest(start_seconds, lo * video_duration))), 6) AS seconds FROM shots, a WHERE event_type <> 'error' GROUP BY ALL", "shots"))
def act_seconds(spark, sf_dir):
    s = A.shots(spark, sf_dir).where("event_type <> 'error'").select("*", F.expr("stack(3, 'act_i', 0D, 0.25D, 'act_ii', 0.25D, 0.75D, 'act_iii', 0.75D, 1D) as (act, lo, hi)"))
    inside = F.greatest(F.lit(0.0), F.least(F.col("end_seconds"), F.col("hi") * F.col("video_duration")) - F.greatest(F.col("start_seconds"), F.col("lo") * F.col("video_duration")))
    return s.groupBy("video_id", "act").agg(F.round(F.sum(inside), 6).alias("seconds"))


@query("agg_21_best_per_story", A.sql("SELECT video_id, story_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, story_id ORDER BY narrative_score DESC, scene_id) AS r FROM shots) WHERE r = 1", "shots"))
def best_per_story(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id", "story_id").agg(F.max_by("scene_id", F.struct(F.col("narrative_score"), -F.col("scene_id"))).alias("scene_id"))


def annotated(spark, sf_dir):
    """(predicted frames, the frames of 20 users, videos with their categories); a shot is a frame."""
    s = A.shots(spark, sf_dir)
    gold = s.select("video_id", F.col("scene_id").alias("frame"), "cents", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("user")).where("(cents * user) % 7 >= 4").select("video_id", "user", "frame")
    videos = s.groupBy("video_id").agg(F.count("*").alias("n_frames")).withColumn("category", F.concat(F.lit("c"), F.col("video_id") % 4))
    return s.where("narrative_score >= 0.7").select("video_id", F.col("scene_id").alias("frame")), gold, videos


@query("agg_22_distribution", A.sql("""
WITH m AS (SELECT video_id, (start_seconds + end_seconds) / 2e0 / video_duration AS x, start_seconds AS s, video_duration FROM shots),
n AS (SELECT video_id, unnest(['region', 'act', 'bin']) AS kind, unnest([CASE WHEN x <= 0.15e0 THEN 'opening' WHEN x <= 0.38e0 THEN 'development' WHEN x <= 0.65e0 THEN 'middle' WHEN x <= 0.75e0 THEN 'rising' WHEN x <= 0.80e0 THEN 'conflict' WHEN x <= 0.81e0 THEN 'turn' WHEN x <= 0.82e0 THEN 'onset' WHEN x <= 0.90e0 THEN 'climax' WHEN x <= 0.925e0 THEN 'falling' ELSE 'resolution' END,
 CASE WHEN x < 0.25e0 THEN 'act_i' WHEN x < 0.75e0 THEN 'act_ii' ELSE 'act_iii' END, least(9, floor(round(10e0 * s / video_duration, 9)))::BIGINT::VARCHAR]) AS name FROM m)
SELECT video_id, kind, name, count(*) AS n FROM n GROUP BY ALL""", "shots"))
def distribution(spark, sf_dir):
    # nine places: a start at a whole tenth, in milliseconds, is in the tenth that it begins
    middle = (F.col("start_seconds") + F.col("end_seconds")) / 2 / F.col("video_duration")
    return K.distribution(A.shots(spark, sf_dir), ["video_id"], {"region": P.narrative_region(middle), "act": P.act(middle), "bin": F.least(F.lit(9), F.floor(F.round(10.0 * F.col("start_seconds") / F.col("video_duration"), 9)))})


_USERS = """
WITH m AS (SELECT video_id, scene_id, unnest(range(1, 21)) AS usr, cents, narrative_score FROM shots), g AS (SELECT *, (cents * usr) % 7 >= 4 AS t, narrative_score >= 0.7e0 AS p FROM m),
c AS (SELECT video_id, usr, count(*) FILTER (p AND t) AS h, count(*) FILTER (p) AS np, count(*) FILTER (t) AS nt FROM g GROUP BY ALL),
u AS (SELECT video_id, usr, np, CASE WHEN h > 0 THEN 2e0 * h / (np + nt) ELSE 0e0 END AS f1, CASE WHEN np > 0 THEN h / np::DOUBLE ELSE 0e0 END AS precision, CASE WHEN nt > 0 THEN h / nt::DOUBLE ELSE 0e0 END AS recall FROM c),
v AS (SELECT video_id, 'c' || video_id % 4 AS category, max(np) > 0 AS ok, avg(f1) AS f1, avg(precision) AS precision, avg(recall) AS recall FROM u GROUP BY video_id)
"""


@query("agg_23_macro_average", A.sql(_USERS + "SELECT coalesce(category, 'all') AS category, count(*) AS n, count(*) FILTER (ok) AS succeeded, round(avg(CASE WHEN ok THEN f1 ELSE 0e0 END), 6) AS f1, round(avg(f1) FILTER (ok), 6) AS f1_of_successes, round(avg(precision) FILTER (ok), 6) AS precision_of_successes, round(avg(recall) FILTER (ok), 6) AS recall_of_successes FROM v GROUP BY GROUPING SETS ((category), ())", "shots"))
def macro_average(spark, sf_dir):
    return E.benchmark(E.user_scores(*annotated(spark, sf_dir))).select("category", *[F.round(c, 6).alias(c) if c not in ("n", "succeeded") else F.col(c) for c in ("n", "succeeded", "f1", "f1_of_successes", "precision_of_successes", "recall_of_successes")])


@query("agg_24_detector_summary", A.sql("SELECT event_type AS detector, count(*) AS scenes, round(avg(duration_seconds), 4) AS mean_seconds FROM shots GROUP BY ALL", "shots"))
def detector_summary(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy(F.col("event_type").alias("detector")).agg(F.count("*").alias("scenes"), F.round(F.avg("duration_seconds"), 4).alias("mean_seconds"))


@query("agg_25_usage_sums", A.sql("SELECT video_id, k AS key, sum(v)::BIGINT AS total FROM (SELECT video_id, unnest(['calls', 'cents']) AS k, unnest([1, cents]) AS v FROM shots) GROUP BY ALL", "shots"))
def usage_sums(spark, sf_dir):
    m = A.shots(spark, sf_dir).select("video_id", F.create_map(F.lit("calls"), F.lit(1).cast("long"), F.lit("cents"), F.col("cents")).alias("usage"))
    return m.select("video_id", F.explode("usage").alias("key", "v")).groupBy("video_id", "key").agg(F.sum("v").alias("total"))


@query("agg_26_coherence", A.sql("SELECT video_id, round(count(*) / sum(duration_seconds), 6) AS cut_density, count(DISTINCT story_id) AS stories FROM shots GROUP BY video_id", "shots"))
def coherence(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id").agg(F.round(F.count("*") / F.sum("duration_seconds"), 6).alias("cut_density"), F.countDistinct("story_id").alias("stories"))


@query("agg_27_stage_completeness", A.sql("SELECT video_id, bool_and(event_type <> 'error') AS complete, min_by(scene_id, CASE WHEN event_type = 'error' THEN scene_id END) AS first_failed FROM shots GROUP BY video_id", "shots"))
def stage_completeness(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id").agg(F.bool_and(F.col("event_type") != "error").alias("complete"), F.min(F.when(F.col("event_type") == "error", F.col("scene_id"))).alias("first_failed"))


def _top(name, order, n, sql_order, keys="video_id", rows="shots"):
    @query(name, A.sql(f"SELECT video_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {sql_order}) AS r FROM {rows}) WHERE r <= {n}", rows))
    def f(spark, sf_dir):
        return K.top(A.shots(spark, sf_dir), keys.split(", "), order(), n, "r").select("video_id", "scene_id")


_top("top_1_best_then_id", lambda: [F.desc("narrative_score"), "scene_id"], 5, "narrative_score DESC, scene_id")
_top("top_8_best_keyframes", lambda: [F.desc("action_score"), "scene_id"], 2, "action_score DESC, scene_id")
_top("top_13_latest", lambda: [F.desc("scene_id")], 100, "scene_id DESC")


@query("top_2_bounded_pool", A.sql("SELECT video_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS r FROM shots) WHERE r <= least(400, greatest(80, 4 * ceil(60e0 / 4e0)))", "shots"))
def bounded_pool(spark, sf_dir):
    return K.pool(A.shots(spark, sf_dir), ["video_id"], [F.desc("narrative_score"), "scene_id"], 60.0, 4.0).select("video_id", "scene_id")


@query("top_3_story_then_overall", A.sql("SELECT video_id, scene_id, rank::INTEGER AS rank FROM (SELECT video_id, scene_id, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, story_id ORDER BY narrative_score DESC, scene_id) AS r FROM shots) WHERE r <= 2 OR emotion >= 0.95e0) WHERE rank <= 400", "shots"))
def story_then_overall(spark, sf_dir):
    d = K.story_cap(A.shots(spark, sf_dir), ["video_id"], "story_id", [F.desc("narrative_score"), "scene_id"], 2, 400, F.col("emotion") >= 0.95)
    return d.select("video_id", "scene_id", "rank")


@query("top_6_caption_shortlist_story", A.sql("SELECT video_id, scene_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY action_score < 0.7e0, emotion DESC, narrative_score DESC, scene_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, story_id ORDER BY action_score < 0.7e0, emotion DESC, narrative_score DESC, scene_id) AS r FROM shots) WHERE r <= 2) WHERE rank <= 16", "shots"))
def caption_shortlist(spark, sf_dir):
    # locally chosen shots come first, then events, then importance; 16 frames a video
    order = [F.col("action_score") < 0.7, F.desc("emotion"), F.desc("narrative_score"), "scene_id"]
    return K.story_cap(A.shots(spark, sf_dir), ["video_id"], "story_id", order, 2, 16).select("video_id", "scene_id", "rank")


@query("top_5_anchors_per_act", A.sql("WITH a AS (SELECT *, CASE WHEN (start_seconds + end_seconds) / 2e0 / video_duration < 0.25e0 THEN 'act_i' WHEN (start_seconds + end_seconds) / 2e0 / video_duration < 0.75e0 THEN 'act_ii' ELSE 'act_iii' END AS act FROM shots), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, act ORDER BY narrative_score DESC, scene_id) AS k FROM a) SELECT video_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS g FROM r WHERE k <= CASE act WHEN 'act_i' THEN 1 ELSE 2 END) WHERE g <= 4", "shots"))
def anchors_per_act(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("act", P.act((F.col("start_seconds") + F.col("end_seconds")) / 2 / F.col("video_duration")))
    order = [F.desc("narrative_score"), "scene_id"]
    d = K.ranked(d, ["video_id", "act"], order, "k").where(F.col("k") <= F.when(F.col("act") == "act_i", 1).otherwise(2))
    return K.top(d, ["video_id"], order, 4, "g").select("video_id", "scene_id")


@query("top_4_act_reserves", A.sql("""
WITH d AS (SELECT video_id, scene_id, story_id, round((0.20e0 * coalesce(lag(narrative_score) OVER w, narrative_score) + 0.60e0 * narrative_score + 0.20e0 * coalesce(lead(narrative_score) OVER w, narrative_score))::VARCHAR::DECIMAL(38, 20), 4) AS x, emotion, onset >= 0.95e0 AS chosen,
  CASE WHEN (start_seconds + end_seconds) / 2e0 / video_duration < 0.25e0 THEN 1 WHEN (start_seconds + end_seconds) / 2e0 / video_duration < 0.75e0 THEN 2 ELSE 3 END AS act FROM shots WINDOW w AS (PARTITION BY video_id ORDER BY scene_id)),
f AS (SELECT * FROM d WHERE (video_id, story_id) NOT IN (SELECT (video_id, story_id) FROM d WHERE chosen)),
a1 AS (SELECT * FROM (SELECT * FROM f WHERE act = 1 QUALIFY row_number() OVER (PARTITION BY video_id, story_id ORDER BY x DESC, emotion DESC, scene_id) = 1) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY x DESC, emotion DESC, scene_id) <= 2),
a2 AS (SELECT * FROM (SELECT * FROM f WHERE act = 2 AND (video_id, story_id) NOT IN (SELECT (video_id, story_id) FROM a1) QUALIFY row_number() OVER (PARTITION BY video_id, story_id ORDER BY x DESC, emotion DESC, scene_id) = 1) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY x DESC, emotion DESC, scene_id) <= 2),
a3 AS (SELECT * FROM (SELECT * FROM f WHERE act = 3 AND (video_id, story_id) NOT IN (SELECT (video_id, story_id) FROM a1 UNION ALL SELECT (video_id, story_id) FROM a2) QUALIFY row_number() OVER (PARTITION BY video_id, story_id ORDER BY x DESC, emotion DESC, scene_id) = 1) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY x DESC, emotion DESC, scene_id) <= 2)
SELECT video_id, scene_id FROM a1 UNION ALL SELECT video_id, scene_id FROM a2 UNION ALL SELECT video_id, scene_id FROM a3""", "shots"))
def act_reserves(spark, sf_dir):
    from sceneql.operators import summary as M

    s = A.shots(spark, sf_dir)
    d = M.prepared(s.drop("credit_probability"), "narrative_score", {"event": "emotion", "story": "story_id"})
    # two an act, so that stories passed over in one act are left for the next
    return M.act_reserves(d.join(s.where("onset >= 0.95").select("video_id", "scene_id"), ["video_id", "scene_id"]), d, 2)


@query("top_7_top_fifth", A.sql("SELECT video_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY action_score DESC, scene_id DESC) AS r FROM shots) WHERE r <= floor(n_shots * 0.2e0)", "shots"))
def top_fifth(spark, sf_dir):
    d = K.ranked(A.shots(spark, sf_dir), ["video_id"], [F.desc("action_score"), F.desc("scene_id")], "r")
    return d.where(F.col("r") <= F.floor(F.col("n_shots") * 0.2)).select("video_id", "scene_id")


@query("top_9_cap_keeps_required", A.sql("SELECT video_id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS r FROM shots) WHERE r <= 10 OR emotion = 1e0", "shots"))
def cap_keeps_required(spark, sf_dir):
    return K.ranked(A.shots(spark, sf_dir), ["video_id"], [F.desc("narrative_score"), "scene_id"], "r").where("r <= 10 or emotion = 1e0").select("video_id", "scene_id")


@query("top_10_chronological", A.sql("SELECT video_id, scene_id, start_seconds FROM shots ORDER BY video_id, start_seconds, scene_id", "shots"))
def chronological(spark, sf_dir):
    return A.shots(spark, sf_dir).select("video_id", "scene_id", "start_seconds").orderBy("video_id", "start_seconds", "scene_id")


@query("top_11_stride_batches", A.sql("SELECT video_id, scene_id, (r - 1) % k AS batch FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS r, ceil(n_shots / 12e0)::BIGINT AS k FROM shots)", "shots"))
def stride_batches(spark, sf_dir):
    d = K.ranked(A.shots(spark, sf_dir), ["video_id"], [F.desc("narrative_score"), "scene_id"], "r")
    return d.select("video_id", "scene_id", ((F.col("r") - 1) % F.ceil(F.col("n_shots") / 12)).alias("batch"))


@query("top_12_batches_of_six", A.sql("SELECT video_id, scene_id, (scene_id - 1) // 6 AS batch FROM shots", "shots"))
def batches_of_six(spark, sf_dir):
    return K.ranked(A.shots(spark, sf_dir), ["video_id"], ["scene_id"], "r").select("video_id", "scene_id", F.expr("(r - 1) div 6").alias("batch"))


@query("top_14_fill_until_target", A.sql("SELECT video_id, scene_id FROM (SELECT *, coalesce(sum(round(duration_seconds * 1000)) OVER (PARTITION BY video_id ORDER BY action_score DESC, scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shots) WHERE before < 60000", "shots"))
def fill_until_target(spark, sf_dir):
    d = A.shots(spark, sf_dir).withColumn("ms", F.round(F.col("duration_seconds") * 1000))
    return K.fill(d, ["video_id"], [F.desc("action_score"), "scene_id"], "ms", 60000).select("video_id", "scene_id")


@query("set_1_word_dedup", A.sql("SELECT video_id, lower(word) AS word, max(p) AS p FROM (SELECT *, (i % 7) / 7e0 AS p FROM words) GROUP BY video_id, round(start_seconds, 3), round(end_seconds, 3), lower(word)", "words"))
def word_dedup(spark, sf_dir):
    w = A.words(spark, sf_dir).withColumn("p", (F.col("i") % 7) / F.lit(7.0))
    return w.union(w).groupBy("video_id", F.round("start_seconds", 3).alias("a"), F.round("end_seconds", 3).alias("z"), F.lower("word").alias("word")).agg(F.max("p").alias("p")).select("video_id", "word", "p")


@query("set_2_priority_union", A.sql("WITH u AS (SELECT video_id, scene_id, 1 AS pr, 'required' AS source FROM shots WHERE emotion = 1e0 UNION ALL SELECT video_id, scene_id, 2, 'peak' FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY emotion DESC, scene_id) AS r FROM shots) WHERE r <= 5 UNION ALL SELECT video_id, scene_id, 3, 'score' FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY narrative_score DESC, scene_id) AS r FROM shots) WHERE r <= 8) SELECT video_id, scene_id, arg_min(source, pr) AS source FROM u GROUP BY ALL", "shots"))
def priority_union(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    lanes = [("required", s.where("emotion = 1e0")), ("peak", K.top(s, ["video_id"], [F.desc("emotion"), "scene_id"], 5, "r")), ("score", K.top(s, ["video_id"], [F.desc("narrative_score"), "scene_id"], 8, "r"))]
    return K.priority_union(lanes, ["video_id", "scene_id"])


@query("set_3_id_set_union", A.sql("SELECT video_id, story_id, string_agg(DISTINCT (cents % 5)::VARCHAR, ',' ORDER BY (cents % 5)::VARCHAR) AS ids FROM shots GROUP BY ALL", "shots"))
def id_set_union(spark, sf_dir):
    d = A.shots(spark, sf_dir).groupBy("video_id", "story_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array((F.col("cents") % 5).cast("string")))))).alias("ids"))
    return d.select("video_id", "story_id", F.concat_ws(",", "ids").alias("ids"))


@query("set_4_turn_dedup", "SELECT DISTINCT conv_id, role, text FROM conversations")
def turn_dedup(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "role", "text").dropDuplicates()


@query("set_5_timeline_union", A.sql("SELECT video_id, start_seconds, 'shot' AS kind, event_type, NULL AS speaker FROM shots UNION ALL SELECT video_id, start_seconds, 'turn', NULL, speaker FROM turns", "shots", "turns"))
def timeline_union(spark, sf_dir):
    s = A.shots(spark, sf_dir).select("video_id", "start_seconds", F.lit("shot").alias("kind"), "event_type")
    t = A.turns(spark, sf_dir).select("video_id", "start_seconds", F.lit("turn").alias("kind"), "speaker")
    return s.unionByName(t, allowMissingColumns=True).orderBy("video_id", "start_seconds", "kind")


@query("set_6_set_equality", A.sql("SELECT video_id, bool_and(action_score >= 0.05e0) AS same FROM shots GROUP BY video_id", "shots"))
def set_equality(spark, sf_dir):
    s = A.shots(spark, sf_dir).select("video_id", "scene_id", "action_score")
    return K.same_sets(s, s.where("action_score >= 0.05e0"), ["video_id"], ["scene_id"])


@query("set_7_missing_roles", A.sql("SELECT video_id, coalesce(list_sort(list_filter(['click', 'error', 'view', 'zoom'], lambda x: NOT list_contains(have, x))).array_to_string(','), '') AS missing FROM (SELECT video_id, list(event_type) AS have FROM shots GROUP BY video_id)", "shots"))
def missing_roles(spark, sf_dir):
    g = A.shots(spark, sf_dir).groupBy("video_id").agg(F.collect_set("event_type").alias("have"))
    return g.select("video_id", F.concat_ws(",", F.array_sort(F.array_except(F.array(*map(F.lit, ("click", "error", "view", "zoom"))), "have"))).alias("missing"))


@query("set_8_intersection", A.sql("SELECT video_id, scene_id FROM shots WHERE action_score >= 0.8e0 INTERSECT SELECT video_id, scene_id FROM shots WHERE emotion >= 0.5e0", "shots"))
def intersection(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    return s.where("action_score >= 0.8").select("video_id", "scene_id").intersect(s.where("emotion >= 0.5").select("video_id", "scene_id"))


def _hits(cues) -> str:
    return "len(list_filter([" + ", ".join(f"'{c}'" for c in cues) + "], lambda c: len(list_filter(t, lambda w: starts_with(w, c))) > 0))"


@query("agg_15_dialogue_cues", f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM conversations), h AS (SELECT conv_id, turn, {_hits(L.POSITIVE)} AS p, {_hits(L.NEGATIVE)} AS n, {_hits(L.DECISION)} AS d FROM w)
SELECT conv_id, turn, round((p - n)::DOUBLE / greatest(p + n, 1), 4) AS polarity, round(least(1e0, (p + n) / 2e0), 4) AS intensity, round(least(1e0, d / 2e0), 4) AS decision, round(least(0.75e0, 0.25e0 * (p + n) + 0.15e0 * d), 4) AS confidence FROM h""")
def dialogue_cues(spark, sf_dir):
    from sceneql.functions import text as T

    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.dialogue_cues("text").alias("c")).select("conv_id", "turn", "c.*")
