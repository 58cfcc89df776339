"""Queries of evaluation (EVAL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import vectors as V
from sceneql.operators import evaluate as E
from sceneql.operators import topk as K
from sceneql.operators import windows as W
from sceneql.operators.summary import kept
from sceneql.plans import adapters as A
from sceneql.plans.q_aggregates import _USERS, annotated
from sceneql.plans.registry import query


@query("eval_1_mask_scores", A.sql("WITH p AS (SELECT DISTINCT video_id, unnest(range(start_day, end_day)) AS f FROM spans WHERE speaker = 0), t AS (SELECT DISTINCT video_id, unnest(range(start_day, end_day)) AS f FROM spans WHERE speaker = 1), u AS (SELECT coalesce(p.video_id, t.video_id) AS video_id, count(*) FILTER (p.f IS NOT NULL AND t.f IS NOT NULL) AS h, count(p.f) AS np, count(t.f) AS nt FROM p FULL JOIN t ON p.video_id = t.video_id AND p.f = t.f GROUP BY 1) SELECT video_id, round(CASE WHEN np > 0 THEN h::DOUBLE / np ELSE 0e0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN h::DOUBLE / nt ELSE 0e0 END, 6) AS recall, round(CASE WHEN h > 0 THEN 2e0 * h / (np + nt) ELSE 0e0 END, 6) AS f1 FROM u", "spans"))
def mask_scores(spark, sf_dir):
    s = A.spans(spark, sf_dir)
    mask = lambda k: s.where(f"speaker = {k}").select("video_id", F.explode(F.sequence("start_day", F.col("end_day") - 1)).alias("f"))
    d = E.mask_scores(mask(0), mask(1), ["video_id"], "f")
    return d.select("video_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("eval_2_benchmark_means", A.sql(_USERS + """,
z AS (SELECT video_id, n_shots AS nf, count(*) FILTER (narrative_score >= 0.7e0) AS n FROM shots GROUP BY ALL), b AS (SELECT DISTINCT video_id, 1 + k * nf // n AS scene_id FROM (SELECT *, unnest(range(0, n)) AS k FROM z WHERE n > 0)),
bn AS (SELECT video_id, count(*) AS np FROM b GROUP BY video_id), bh AS (SELECT m.video_id, usr, count(b.scene_id) AS h, count(*) AS nt FROM m LEFT JOIN b ON b.video_id = m.video_id AND b.scene_id = m.scene_id WHERE (cents * usr) % 7 >= 4 GROUP BY ALL),
bu AS (SELECT v.video_id, v.category, v.ok, coalesce(CASE WHEN h > 0 THEN 2e0 * h / (np + nt) END, 0e0) AS f FROM v CROSS JOIN (SELECT unnest(range(1, 21)) AS usr) x LEFT JOIN bn ON bn.video_id = v.video_id LEFT JOIN bh ON bh.video_id = v.video_id AND bh.usr = x.usr),
bv AS (SELECT video_id, category, ok, avg(f) AS f FROM bu GROUP BY ALL), w AS (SELECT coalesce(category, 'all') AS category, round(avg(f) FILTER (ok), 6) AS uniform FROM bv GROUP BY GROUPING SETS ((category), ())),
y AS (SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(CASE WHEN ok THEN f1 ELSE 0e0 END), 6) AS f1, round(avg(f1) FILTER (ok), 6) AS f1_of_successes FROM v GROUP BY GROUPING SETS ((category), ()))
SELECT category, n, f1, f1_of_successes, uniform FROM y JOIN w USING (category)""", "shots"))
def benchmark_means(spark, sf_dir):
    predicted, gold, videos = annotated(spark, sf_dir)
    sizes = videos.join(predicted.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    model = E.benchmark(E.user_scores(predicted, gold, videos))
    plain = E.benchmark(E.user_scores(E.uniform_frames(sizes), gold, videos)).select("category", F.round("f1_of_successes", 6).alias("uniform"))
    return model.select("category", "n", F.round("f1", 6).alias("f1"), F.round("f1_of_successes", 6).alias("f1_of_successes")).join(plain, "category")


@query("eval_4_cut_matching", A.sql("""
WITH RECURSIVE p AS (SELECT video_id, start_seconds AS t, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds) AS rn FROM shots WHERE action_score >= 0.6e0),
f AS (SELECT video_id, list(start_seconds ORDER BY start_seconds) AS free, count(*) AS n FROM shots WHERE emotion >= 0.5e0 GROUP BY video_id), c AS (SELECT video_id, count(*) AS n FROM p GROUP BY video_id),
r AS (SELECT coalesce(f.video_id, c.video_id) AS video_id, 0::BIGINT AS rn, coalesce(f.free, []) AS free, 0::BIGINT AS hits, coalesce(c.n, 0) AS np, coalesce(f.n, 0) AS nt FROM f FULL JOIN c ON f.video_id = c.video_id
 UNION ALL SELECT r.video_id, p.rn, CASE WHEN len(list_filter(r.free, lambda x: abs(x - p.t) <= 1e0)) > 0 THEN list_filter(r.free, lambda x: x <> list_filter(r.free, lambda y: abs(y - p.t) <= 1e0)[1]) ELSE r.free END,
  r.hits + CASE WHEN len(list_filter(r.free, lambda x: abs(x - p.t) <= 1e0)) > 0 THEN 1 ELSE 0 END, np, nt FROM r JOIN p ON p.video_id = r.video_id AND p.rn = r.rn + 1)
SELECT video_id, hits, np AS predicted, nt AS truth FROM r WHERE rn = np""", "shots"))
def cut_matching(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    return E.match_cuts(s.where("action_score >= 0.6"), s.where("emotion >= 0.5"), ["video_id"], "start_seconds", 1.0)


@query("eval_5_cuts_many_to_one", A.sql("SELECT video_id, count(*) AS hits FROM (SELECT * FROM shots WHERE action_score >= 0.6e0) p WHERE EXISTS (SELECT 1 FROM shots t WHERE t.video_id = p.video_id AND t.emotion >= 0.5e0 AND abs(t.start_seconds - p.start_seconds) <= 2e0) GROUP BY video_id", "shots"))
def cuts_many_to_one(spark, sf_dir):
    from sceneql.operators.joins import overlap_join

    s = A.shots(spark, sf_dir)
    p = s.where("action_score >= 0.6").select("video_id", "scene_id", F.col("start_seconds").alias("p"), F.col("start_seconds").alias("p2"))
    t = s.where("emotion >= 0.5").select("video_id", (F.col("start_seconds") - 2.0).alias("lo"), (F.col("start_seconds") + 2.0).alias("hi"), F.col("start_seconds").alias("t"))
    hits = overlap_join(p, t, ["video_id"], "p", "p2", "lo", "hi", 30.0, -1e-9).where(F.abs(F.col("t") - F.col("p")) <= 2)
    return hits.select("video_id", "scene_id").distinct().groupBy("video_id").agg(F.count("*").alias("hits"))


@query("eval_6_top_overlap", A.sql("WITH t AS (SELECT video_id, quantile_cont(emotion, 0.8) AS q FROM shots GROUP BY video_id), r AS (SELECT s.*, emotion >= q AS hit, row_number() OVER (PARTITION BY s.video_id ORDER BY narrative_score DESC, scene_id) AS k FROM shots s JOIN t USING (video_id)) SELECT video_id, count(*) FILTER (hit AND k <= floor(n_shots * 0.2e0)) AS hits, count(*) FILTER (hit) AS truth FROM r GROUP BY video_id", "shots"))
def top_overlap(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    q = s.groupBy("video_id").agg(F.percentile("emotion", F.lit(0.8)).alias("q"))
    r = K.ranked(s.join(q, "video_id").withColumn("hit", F.col("emotion") >= F.col("q")), ["video_id"], [F.desc("narrative_score"), "scene_id"], "k")
    return r.groupBy("video_id").agg(F.count(F.when(F.col("hit") & (F.col("k") <= F.floor(F.col("n_shots") * 0.2)), 1)).alias("hits"), F.count(F.when(F.col("hit"), 1)).alias("truth"))


@query("eval_7_ablation", A.sql("WITH u AS (SELECT video_id, scene_id, n_shots, emotion, unnest(['action', 'dialogue', 'narrative']) AS signal, unnest([action_score, dialogue_score, narrative_score]) AS x FROM shots), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, signal ORDER BY x DESC, scene_id) AS k FROM u) SELECT signal, count(*) FILTER (k <= floor(n_shots * 0.2e0) AND emotion >= 0.7e0) AS hits FROM r GROUP BY signal", "shots"))
def ablation(spark, sf_dir):
    u = A.shots(spark, sf_dir).select("video_id", "scene_id", "n_shots", "emotion", F.expr("stack(3, 'action', action_score, 'dialogue', dialogue_score, 'narrative', narrative_score) as (signal, x)"))
    r = K.ranked(u, ["video_id", "signal"], [F.desc("x"), "scene_id"], "k")
    return r.groupBy("signal").agg(F.count(F.when((F.col("k") <= F.floor(F.col("n_shots") * 0.2)) & (F.col("emotion") >= 0.7), 1)).alias("hits"))


@query("eval_8_spearman", A.sql("WITH r AS (SELECT video_id, rank() OVER (PARTITION BY video_id ORDER BY emotion) + (count(*) OVER (PARTITION BY video_id, emotion) - 1) / 2e0 AS x, rank() OVER (PARTITION BY video_id ORDER BY energy) + (count(*) OVER (PARTITION BY video_id, energy) - 1) / 2e0 AS y FROM shots) SELECT video_id, round(corr(x, y), 6) AS rho FROM r GROUP BY video_id", "shots"))
def spearman(spark, sf_dir):
    return E.spearman(A.shots(spark, sf_dir), ["video_id"], "emotion", "energy").withColumn("rho", F.round("rho", 6))


@query("eval_8_kendall", A.sql("WITH p AS (SELECT a.video_id, sign(a.emotion - b.emotion) AS dx, sign(a.energy - b.energy) AS dy FROM shots a JOIN shots b ON a.video_id = b.video_id AND a.scene_id < b.scene_id) SELECT video_id, round(CASE WHEN sum(abs(dx)) > 0 AND sum(abs(dy)) > 0 THEN sum(dx * dy)::DOUBLE / sqrt(sum(abs(dx))::DOUBLE * sum(abs(dy))) ELSE 0e0 END, 6) AS tau FROM p GROUP BY video_id", "shots"))
def kendall(spark, sf_dir):
    return E.kendall(A.shots(spark, sf_dir), ["video_id"], "scene_id", "emotion", "energy").withColumn("tau", F.round("tau", 6))


@query("eval_9_diversity", A.sql("WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY label DESC, kf_id) AS r FROM vectors) WHERE r <= 5) SELECT a.video_id, round(1e0 - avg(list_dot_product(a.vec, b.vec)), 6) AS diversity FROM t a JOIN t b ON a.video_id = b.video_id AND a.kf_id < b.kf_id GROUP BY a.video_id", "vectors"))
def diversity(spark, sf_dir):
    t = K.top(A.vectors(spark, sf_dir), ["video_id"], [F.desc("label"), "kf_id"], 5)
    b = t.select("video_id", F.col("kf_id").alias("other"), F.col("vec").alias("ov"))
    return t.join(b, "video_id").where("kf_id < other").groupBy("video_id").agg(F.round(1.0 - F.avg(V.dot("vec", "ov")), 6).alias("diversity"))


@query("eval_10_segment_knapsack")
def segment_knapsack(spark, sf_dir):
    """Every rater's frames by one knapsack over the predicted segments, and the prediction against each user's; the means."""
    s = A.shots(spark, sf_dir)
    w = Window.partitionBy("video_id").orderBy("scene_id").rowsBetween(Window.unboundedPreceding, -1)
    length = F.least(F.lit(20), F.greatest(F.lit(1), F.ceil("duration_seconds"))).cast("long")
    cut = s.withColumn("first", F.coalesce(F.sum(length).over(w), F.lit(0))).withColumn("last", F.col("first") + length - 1)
    score = {f"r{r}": F.col("narrative_score") if r == 0 else ((F.col("cents") * r) % 5 + 1).cast("double") for r in range(E.USERS + 1)}
    spans = kept(E.segment_spans(cut.select("video_id", "first", "last", *[c.alias(name) for name, c in score.items()]), list(score)))
    videos = s.select("video_id", F.concat(F.lit("c"), F.col("video_id") % 4).alias("category")).distinct()
    scores = E.span_scores(spans.where("rater = 0"), spans.where("rater > 0").withColumnRenamed("rater", "user"), videos)
    return E.benchmark(scores).select("category", "n", "succeeded", F.round("f1", 6).alias("f1"))
