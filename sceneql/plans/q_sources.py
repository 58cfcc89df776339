"""Queries of sources, sinks and control (SRC, CACHE, CTL) and of the streaming extension, on tables written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sceneql.operators import joins as J
from sceneql.plans import adapters as A
from sceneql.plans.q_selection import SUBSETS
from sceneql.plans.registry import query
from sceneql.sources import tables as S
from sceneql.sources.manifest import Manifest
from sceneql.streaming import sessions


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{S.shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


_SHOT_ROWS = "SELECT video_id, scene_id, start_seconds, end_seconds FROM shots"


@query("src_1_json_round_trip", A.sql(_SHOT_ROWS, "shots"))
def json_round_trip(spark, sf_dir):
    path = scratch(spark)
    S.write_json(A.shots(spark, sf_dir).select("video_id", "scene_id", "start_seconds", "end_seconds"), path)
    return S.read_json(spark, path, "video_id long, scene_id long, start_seconds double, end_seconds double", lines=True)


@query("src_3_csv_round_trip", A.sql(_SHOT_ROWS, "shots"))
def csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    S.write_csv(A.shots(spark, sf_dir).select("video_id", "scene_id", "start_seconds", "end_seconds"), path)
    return spark.read.option("header", True).schema("video_id long, scene_id long, start_seconds double, end_seconds double").csv(path)


@query("src_6_annotation_scan", A.sql("WITH u AS (SELECT video_id, scene_id, least(5, 1 + cents % 5) AS r FROM shots) SELECT video_id, scene_id - 1 AS frame, r AS rating FROM u", "shots"))
def annotation_scan(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    lines = s.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_id", F.least(F.lit(5), 1 + F.col("cents") % 5).cast("string").alias("r")))), lambda x: x["r"]), ",").alias("scores"))
    return S.ratings(lines, users=1).select("video_id", F.col("frame").cast("long").alias("frame"), F.col("rating").cast("long").alias("rating"))


@query("src_7_document_store", A.sql("SELECT kf_id AS id, round(s, 6) AS similarity FROM (SELECT v.kf_id, list_cosine_similarity(v.vec, q.vec) AS s FROM vectors v, vectors q WHERE q.kf_id = 7 AND v.label = 3) ORDER BY s DESC, kf_id LIMIT 5", "vectors"))
def document_store(spark, sf_dir):
    path = scratch(spark)
    v = A.vectors(spark, sf_dir)
    S.write_store(v.select(F.col("kf_id").alias("id"), F.col("label").cast("string").alias("kind"), "vec"), path)
    asked = v.where("kf_id = 7").select("vec").first()["vec"]
    return S.search_store(spark, path, asked, 5, "3").select("id", F.round("similarity", 6).alias("similarity"))


@query("src_12_detect_shots", A.sql("""
WITH RECURSIVE f AS (SELECT user_id AS video_id, event_id AS frame, (CAST(round(value * 100) AS BIGINT) % 101) / 100e0 AS change FROM events), o AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS rn FROM f WHERE change > 0.5e0),
t AS (SELECT video_id, rn, frame, frame AS last, true AS keep FROM o WHERE rn = 1 UNION ALL SELECT o.video_id, o.rn, o.frame, CASE WHEN o.frame - t.last >= 15 THEN o.frame ELSE t.last END, o.frame - t.last >= 15 FROM t JOIN o ON o.video_id = t.video_id AND o.rn = t.rn + 1),
s AS (SELECT video_id, frame FROM t WHERE keep AND frame > 0 UNION ALL SELECT DISTINCT video_id, 0 FROM f), l AS (SELECT video_id, max(frame) + 1 AS e FROM f GROUP BY video_id)
SELECT s.video_id, row_number() OVER w AS scene_id, round(s.frame / 25e0, 3) AS start_seconds, round(coalesce(lead(s.frame) OVER w, e) / 25e0, 3) AS end_seconds FROM s JOIN l ON l.video_id = s.video_id WINDOW w AS (PARTITION BY s.video_id ORDER BY s.frame)"""))
def detect_shots(spark, sf_dir):
    f = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), (F.round(F.col("value") * 100).cast("long") % 101 / F.lit(100.0)).alias("change"))
    return S.detect_shots(f, ["video_id"], "frame", "change", 25.0).withColumn("scene_id", F.col("scene_id").cast("long"))


@query("src_14_sharpest_frames", A.sql("""
WITH w AS (SELECT video_id, scene_id, unnest(CASE WHEN duration_seconds < 10e0 THEN [0] ELSE [0, 1, 2] END) AS k, duration_seconds AS d, start_seconds AS s FROM shots),
b AS (SELECT video_id, scene_id, k, s + (CASE WHEN d < 10e0 THEN 0.30e0 WHEN k = 0 THEN 0.10e0 WHEN k = 1 THEN 0.35e0 ELSE 0.65e0 END) * d AS a, s + (CASE WHEN d < 10e0 THEN 0.70e0 WHEN k = 0 THEN 0.35e0 WHEN k = 1 THEN 0.65e0 ELSE 0.90e0 END) * d AS z FROM w),
f AS (SELECT video_id, scene_id AS frame, start_seconds + 0.5e0 * duration_seconds AS t, energy AS blur FROM shots UNION ALL SELECT video_id, scene_id + 1000, start_seconds + 0.2e0 * duration_seconds, onset FROM shots)
SELECT b.video_id, b.scene_id, k AS kf_index, arg_max(frame, (blur, -frame)) AS frame FROM b JOIN f ON f.video_id = b.video_id AND t >= a AND t < z GROUP BY ALL""", "shots"))
def sharpest_frames(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    f = s.select("video_id", F.col("scene_id").alias("frame"), (F.col("start_seconds") + 0.5 * F.col("duration_seconds")).alias("t"), F.col("energy").alias("blur"))
    f = f.union(s.select("video_id", F.col("scene_id") + 1000, F.col("start_seconds") + 0.2 * F.col("duration_seconds"), "onset"))
    return S.sharpest(s, f, ["video_id"])


@query("src_15_sample_frames", A.sql("SELECT video_id, floor(start_seconds / 20e0)::BIGINT AS k, arg_min(scene_id, (start_seconds, scene_id)) AS frame, min(start_seconds) AS t FROM shots GROUP BY ALL", "shots"))
def sample_frames(spark, sf_dir):
    return S.sample_frames(A.shots(spark, sf_dir).select("video_id", F.col("scene_id").alias("frame"), F.col("start_seconds").alias("t")), ["video_id"], 20.0)


@query("src_19_keyframe_names", A.sql("SELECT scene_id::INT AS scene_id, (cents % 3)::INT AS kf_index, count(*) AS n FROM shots GROUP BY ALL", "shots"))
def keyframe_names(spark, sf_dir):
    names = A.shots(spark, sf_dir).select(F.format_string("/k/scene_%d_kf%d.jpg", "scene_id", F.col("cents") % 3).alias("path"))
    return S.keyframe_names(names, "path").groupBy("scene_id", "kf_index").agg(F.count("*").alias("n"))


@query("src_21_trim_graph", A.sql("""
SELECT video_id, string_agg(printf('[0:v]trim=start=%.3f:end=%.3f,setpts=PTS-STARTPTS[v%d];[0:a]atrim=start=%.3f:end=%.3f,asetpts=PTS-STARTPTS[a%d]', s, e, i, s, e, i), ';' ORDER BY i)
 || ';' || string_agg(printf('[v%d][a%d]', i, i), '' ORDER BY i) || printf('concat=n=%d:v=1:a=1[v][a]', count(*)) AS graph
FROM (SELECT video_id, start_seconds AS s, end_seconds AS e, row_number() OVER (PARTITION BY video_id ORDER BY scene_id) - 1 AS i FROM shots) GROUP BY video_id""", "shots"))
def trim_graph(spark, sf_dir):
    return A.shots(spark, sf_dir).groupBy("video_id").agg(S.trim_graph("start_seconds", "end_seconds", "scene_id").alias("graph"))


@query("src_23_timeline_lines", A.sql("SELECT '[' || printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' - ' || printf('%02d:%02d:%02d.%03d', z // 3600000, z // 60000 % 60, z // 1000 % 60, z % 1000) || '] speech: ' || speaker AS line FROM (SELECT start_ms AS a, end_ms AS z, speaker FROM turns)", "turns"))
def timeline_lines(spark, sf_dir):
    return A.turns(spark, sf_dir).select(S.timeline_lines(F.lit("speech"), "start_seconds", "end_seconds", "speaker").alias("line"))


@query("src_25_overrides", A.sql("SELECT video_id, start_seconds AS start, end_seconds AS \"end\", speaker FROM turns WHERE end_seconds > start_seconds", "turns"))
def overrides(spark, sf_dir):
    t = A.turns(spark, sf_dir).where("end_seconds > start_seconds")
    return S.overrides(t.select("video_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "speaker"))


@query("src_27_content_ingest", "WITH h AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM benchmark), k AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM benchmark WHERE text LIKE 'T%'), r AS (SELECT sha256, row_number() OVER (ORDER BY sha256) AS n FROM k), o AS (SELECT h.sha256, r.n, sum(CASE WHEN r.n IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY h.sha256 ROWS UNBOUNDED PRECEDING) AS s FROM h LEFT JOIN r USING (sha256)) SELECT sha256, 'video' || coalesce(n, (SELECT max(n) FROM r) + s)::BIGINT AS alias FROM o")
def content_ingest(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    known = b.where("text like 'T%'").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).distinct()
    known = S.numbered(known, ["sha256"], "n").select("sha256", F.concat(F.lit("video"), "n").alias("alias"))
    return S.ingest(b, known, "text")


@query("src_29_alias_mapping", "SELECT c_custkey AS video_id, 'video' || row_number() OVER (ORDER BY c_custkey) AS alias FROM customer")
def alias_mapping(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"))
    return S.numbered(c, ["video_id"], "n").select("video_id", F.concat(F.lit("video"), "n").alias("alias"))


@query("cache_1_stage_reuse", A.sql("SELECT video_id, count(*) AS n FROM shots GROUP BY video_id", "shots"))
def stage_reuse(spark, sf_dir):
    m = Manifest(spark, scratch(spark))
    made = []

    def stage():
        made.append(1)
        return A.shots(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))

    m.run("counts", {"version": 1}, stage)
    out, _ = m.run("counts", {"version": 1}, stage)
    if len(made) != 1:
        raise AssertionError("a valid stage ran again")
    return out


@query("cache_5_hash_cache", "SELECT d.doc_id, coalesce(c.cached, false) AS cached FROM documents d LEFT JOIN (SELECT DISTINCT sha256(text) AS h, true AS cached FROM documents WHERE source = 'src0') c ON sha256(d.text) = c.h")
def hash_cache(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    c = d.where("source = 'src0'").select("h", F.lit(True).alias("cached")).distinct()
    return d.join(c, "h", "left").select("doc_id", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("ctl_1_retry_in_halves", A.sql("SELECT video_id, scene_id, cents % 13 <> 0 AS done FROM shots", "shots"))
def retry_in_halves(spark, sf_dir):
    from sceneql.operators.groups import by_group
    from sceneql.sources.batches import in_halves

    def f(rows):
        def call(part):
            if any(r["cents"] % 13 == 0 for r in part):
                raise ValueError("bad row")
            return part

        done, failed = in_halves(rows, call)
        return [{"scene_id": r["scene_id"], "done": True} for r in done] + [{"scene_id": r["scene_id"], "done": False} for r in failed]

    return by_group(A.shots(spark, sf_dir), ["video_id"], ["scene_id"], ["cents"], f, "scene_id bigint, done boolean")


@query("stream_1_sliding_counts", "WITH w AS (SELECT event_type, unnest(range(0, 4)) AS k, ts FROM events) SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM w GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    return sessions.sliding_counts(A.table(spark, sf_dir, "events"), "event_type")


@query("stream_2_sessions", A.sql("WITH g AS (SELECT *, sum(CASE WHEN us - pus >= 2750000 OR pus IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT video_id, round(start_seconds * 1000000)::BIGINT AS us, lag(round(start_seconds * 1000000)::BIGINT) OVER (PARTITION BY video_id ORDER BY start_seconds) AS pus FROM words)) SELECT video_id, min(us) AS start, max(us) + 2750000 AS \"end\", count(*) AS n FROM g GROUP BY video_id, k", "words"))
def word_sessions(spark, sf_dir):
    w = A.words(spark, sf_dir).select("video_id", F.timestamp_micros(F.round(F.col("start_seconds") * 1000000).cast("long")).alias("ts"))
    return sessions.utterance_sessions(w).select("video_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("src_2_atomic_overwrite", A.sql("SELECT video_id, count(*) AS n FROM shots GROUP BY video_id", "shots"))
def atomic_overwrite(spark, sf_dir):
    path = scratch(spark)
    S.write_json(A.shots(spark, sf_dir).limit(3).select("video_id", F.lit(0).alias("n")), path)
    S.write_json(A.shots(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n")), path)
    return S.read_json(spark, path, "video_id long, n long", lines=True)


@query("src_4_matrix_column", A.sql("SELECT kf_id, round(list_sum(vec), 5) AS total FROM vectors", "vectors"))
def matrix_column(spark, sf_dir):
    from sceneql.functions.vectors import total

    path = scratch(spark)
    A.vectors(spark, sf_dir).select("kf_id", F.col("vec").cast("array<float>").alias("vec")).write.parquet(path)
    return spark.read.parquet(path).select("kf_id", F.round(total("vec"), 5).alias("total"))


@query("src_5_catalog", "SELECT n_nationkey::VARCHAR AS video_id, 'video' || row_number() OVER (ORDER BY n_nationkey) AS alias FROM nation")
def catalog(spark, sf_dir):
    path = scratch(spark)
    n = A.table(spark, sf_dir, "nation").select(F.lit("c").alias("category"), F.col("n_nationkey").cast("string").alias("video_id"), F.col("n_nationkey").alias("ordinal"))
    n.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    return S.read_catalog(spark, path, 25).select("video_id", "alias")


@query("src_10_index_reuse", A.sql("SELECT count(*) AS n, 1 AS builds FROM vectors", "vectors"))
def index_reuse(spark, sf_dir):
    m, built = Manifest(spark, scratch(spark)), []

    def build():
        built.append(1)
        return A.vectors(spark, sf_dir)

    for _ in range(3):
        index, _ = m.run("index", {"schema_version": 2, "source": "embeddings"}, build)
    return index.agg(F.count("*").alias("n"), F.lit(len(built)).alias("builds"))


@query("src_11_shots_or_whole", A.sql("SELECT video_id, count(*) FILTER (action_score >= 0.98e0) = 0 AS whole FROM shots GROUP BY video_id", "shots"))
def shots_or_whole(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    d = S.or_whole(s.where("action_score >= 0.98e0").select("video_id", "scene_id", "start_seconds", "end_seconds"), s.select("video_id", "video_duration").distinct())
    return d.groupBy("video_id").agg(F.bool_and("whole").alias("whole"))


@query("src_13_adaptive_shots", A.sql("WITH m AS (SELECT video_id, median(energy) AS med FROM shots GROUP BY video_id), d AS (SELECT s.video_id, any_value(med) AS med, median(abs(energy - med)) AS mad FROM shots s JOIN m USING (video_id) GROUP BY s.video_id) SELECT s.video_id, count(*) AS cuts FROM shots s JOIN d USING (video_id) WHERE energy > least(0.72e0, greatest(0.20e0, med + greatest(0.08e0, 5.5e0 * mad))) GROUP BY s.video_id", "shots"))
def adaptive_shots(spark, sf_dir):
    s = A.shots(spark, sf_dir)
    return S.over_mad(s, ["video_id"], "energy").groupBy("video_id").agg(F.count("*").alias("cuts"))


@query("src_24_caption_lines", A.sql("SELECT video_id, string_agg(printf('%03d', scene_id) || ' ' || event_type, chr(10) ORDER BY scene_id) AS body FROM shots GROUP BY video_id", "shots"))
def caption_lines(spark, sf_dir):
    path = scratch(spark)
    line = F.concat(F.format_string("%03d", "scene_id"), F.lit(" "), F.col("event_type"))
    g = A.shots(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("scene_id", line.alias("line")))).alias("l"))
    g.select("video_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body")).write.json(path)
    return spark.read.schema("video_id long, body string").json(path)


@query("src_28_metric_csv", A.sql("SELECT event_type, count(*) AS n FROM shots GROUP BY event_type", "shots"))
def metric_csv(spark, sf_dir):
    path = scratch(spark)
    S.write_csv(A.shots(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("event_type string, n long").csv(path)


@query("cache_2_stage_status", A.sql("SELECT stage, status, rows FROM (SELECT 'good' AS stage, 'complete' AS status, count(*) AS rows FROM shots WHERE action_score >= 0.5e0) UNION ALL SELECT 'bad', 'failed', 0", "shots"))
def stage_status(spark, sf_dir):
    m = Manifest(spark, scratch(spark))
    good, _ = m.run("good", {"floor": 0.5}, lambda: A.shots(spark, sf_dir).where("action_score >= 0.5"))
    try:
        m.run("bad", {}, lambda: A.shots(spark, sf_dir).select(F.raise_error(F.lit("stage")).alias("x")))
    except Exception:
        pass
    rows = {"good": good.count(), "bad": 0}
    return spark.createDataFrame([(s, m.entry(s)["status"], rows[s]) for s in ("good", "bad")], "stage string, status string, rows long")


@query("cache_3_chained_hashes", A.sql("SELECT build, stage, version, (SELECT count(*) FROM shots WHERE scene_id <= version) AS rows FROM (VALUES (1, 'up', 1), (2, 'down', 1), (3, 'up', 2), (4, 'down', 2)) AS v(build, stage, version)", "shots"))
def chained_hashes(spark, sf_dir):
    m, built = Manifest(spark, scratch(spark)), []

    for version in (1, 1, 2):
        up, h = m.run("up", {"scenes": version}, lambda: (built.append(["up", version]), A.shots(spark, sf_dir).where(F.col("scene_id") <= version))[1])  # noqa: B023
        down, _ = m.run("down", {}, lambda: (built.append(["down", version]), up.select("video_id", "scene_id"))[1], h)  # noqa: B023
        for b in built:
            if len(b) == 2:
                b.append((up if b[0] == "up" else down).count())
    return spark.createDataFrame([(i + 1, *k) for i, k in enumerate(built)], "build int, stage string, version int, rows long")


@query("cache_4_response_cache", A.sql("SELECT video_id, scene_id, cents % 10 AS answer FROM shots WHERE cents % 4 <> 0", "shots"))
def response_cache(spark, sf_dir):
    """Answers are kept by the hash of what was asked; only whole ones that were applied count."""
    s = A.shots(spark, sf_dir).select("video_id", "scene_id", "cents", F.sha2(F.to_json(F.struct("cents", "event_type")), 256).alias("asked"))
    kept = s.select("asked", (F.col("cents") % 10).alias("answer"), F.lit("applied").alias("status"), (F.col("cents") % 4 == 0).alias("partial")).distinct()
    path = scratch(spark)
    kept.write.parquet(path)
    cache = spark.read.parquet(path).where("status = 'applied' and not partial").select("asked", "answer")
    return s.join(cache, "asked").select("video_id", "scene_id", "answer")


@query("udf_1_column_parameters", A.sql(SUBSETS.format(cost="greatest(1, round_even(duration / 0.5e0, 0))::BIGINT", capacity=120, order="v DESC, size DESC").replace("SELECT t.video_id, ord, value, duration FROM b", "SELECT t.video_id AS film, ord AS place, value AS worth, duration AS price FROM b"), "items"))
def column_parameters(spark, sf_dir):
    from sceneql.operators.selection import knapsack_rows

    d = A.items(spark, sf_dir).select(F.col("video_id").alias("film"), F.col("ord").alias("place"), F.col("value").alias("worth"), F.col("duration").alias("price"))
    return knapsack_rows(d, ["film"], ["place"], "worth", "price", 60.0, more_items=True)


@query("udf_2_word_provider", A.sql("SELECT video_id, turn, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS said FROM words GROUP BY ALL", "words"))
def word_provider(spark, sf_dir):
    from sceneql.sources.providers import provide, provider

    provide("words", lambda turns: A.words(turns.sparkSession, sf_dir))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    return provider("words")(A.turns(spark, sf_dir)).groupBy("video_id", "turn").agg(F.count("*").alias("n"), said.alias("said"))


@query("udf_4_injected_answers", A.sql("SELECT video_id, scene_id, 'scene ' || scene_id || ': ' || event_type AS caption, 1 + cents % 100 AS priority FROM shots WHERE cents % 3 = 0", "shots"))
def injected_answers(spark, sf_dir):
    """A client's answers are a provider of rows, a captioner one of a column; a test or a caller puts in its own."""
    from sceneql.sources.providers import provide, provider

    provide("recommendations", lambda shots: shots.where("cents % 3 = 0").withColumn("priority", 1 + F.col("cents") % 100))
    asked = provider("recommendations")(A.shots(spark, sf_dir))
    return provider("captions")(asked).select("video_id", "scene_id", "caption", "priority")


@query("udf_6_progress_and_cancel", A.sql("SELECT 'shots' AS stage, 1 AS done, count(*) AS n FROM shots UNION ALL SELECT 'videos', 2, count(DISTINCT video_id) FROM shots UNION ALL SELECT 'cancelled', 2, 0", "shots"))
def progress_and_cancel(spark, sf_dir):
    from sceneql.sources.batches import Cancelled, run_stages

    s, seen, counts = A.shots(spark, sf_dir), [], []
    stages = [("shots", lambda: counts.append(s.count())), ("videos", lambda: counts.append(s.select("video_id").distinct().count())), ("rest", lambda: counts.append(-1))]
    try:
        run_stages(spark, stages, lambda name, done, of: seen.append((name, done)), lambda: len(seen) == 2)
    except Cancelled:
        seen.append(("cancelled", len(counts)))
        counts.append(0)
    return spark.createDataFrame([(*a, n) for a, n in zip(seen, counts)], "stage string, done int, n long")


@query("src_8_store_matrix", A.sql("SELECT kf_id AS id, row_number() OVER (ORDER BY kf_id) - 1 AS row, round(list_sum(vec), 5) AS total FROM vectors", "vectors"))
def store_matrix(spark, sf_dir):
    from sceneql.functions.vectors import total

    path = scratch(spark)
    S.write_store(A.vectors(spark, sf_dir).select(F.col("kf_id").alias("id"), F.col("label").cast("string").alias("kind"), "vec"), path)
    return S.store_matrix(spark, path).select("id", "row", F.round(total("vec"), 5).alias("total"))


@query("src_9_store_replace", A.sql("SELECT label::VARCHAR AS kind, count(*) AS n FROM vectors WHERE label <> 3 GROUP BY ALL", "vectors"))
def store_replace(spark, sf_dir):
    """A store that is written again holds nothing of what it held."""
    path = scratch(spark)
    v = A.vectors(spark, sf_dir).select(F.col("kf_id").alias("id"), F.col("label").cast("string").alias("kind"), "vec")
    S.write_store(v.where("kind = '3'"), path)
    S.write_store(v.where("kind <> '3'"), path)
    return spark.read.schema("id long, vec array<float>, kind string").parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


@query("src_26_media_numbers", "SELECT path, CASE WHEN p_partkey % 7 = 0 THEN 999 ELSE p_partkey END::INT AS number FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '/m/intro' || repeat('x', (p_partkey % 5)::INT) || '.mp4' ELSE '/m/video' || p_partkey || '.mp4' END AS path FROM part)")
def media_numbers(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("/m/intro"), F.expr("repeat('x', cast(p_partkey % 5 as int))"))).otherwise(F.concat(F.lit("/m/video"), F.col("p_partkey")))
    return S.by_number(A.table(spark, sf_dir, "part").select(F.concat(name, F.lit(".mp4")).alias("path")))


@query("cache_6_duplicate_upload", A.sql("SELECT video_id, count(*) AS n, 'analysis,selection,selection' AS built FROM shots WHERE action_score >= 0.8e0 GROUP BY video_id", "shots"))
def duplicate_upload(spark, sf_dir):
    """A second upload of one content takes over the analysis and runs its own selection alone."""
    first, second, built = Manifest(spark, scratch(spark)), Manifest(spark, scratch(spark)), []

    def upload(m, least):
        def analyse():
            built.append("analysis")
            return A.shots(spark, sf_dir).select("video_id", "scene_id", "action_score")

        def select():
            built.append("selection")
            return scored.where(F.col("action_score") >= least).groupBy("video_id").agg(F.count("*").alias("n"))

        scored, h = m.run("analysis", {"content": "same"}, analyse)
        return m.run("selection", {"least": least}, select, h)[0]

    upload(first, 0.5)
    second.adopt(first, ["analysis"])
    return upload(second, 0.8).withColumn("built", F.lit(",".join(built)))


@query("api_retrieve", A.sql("SELECT kf_id AS id FROM (SELECT v.kf_id, list_cosine_similarity(v.vec, q.vec) AS s FROM vectors v, vectors q WHERE q.kf_id = 3 AND v.kf_id <> 3) ORDER BY s DESC, kf_id LIMIT 8", "vectors"))
def retrieve(spark, sf_dir):
    from sceneql.operators.retrieval import top_cosine

    v = A.vectors(spark, sf_dir)
    q = v.where("kf_id = 3").select(F.lit(0).alias("q"), F.col("vec").alias("qv"))
    return top_cosine(q, v.where("kf_id <> 3").select(F.col("kf_id").alias("id"), "vec"), "q", "qv", "id", "vec", 8).select("id")


@query("api_speaker_timeline")
def speaker_timeline(spark, sf_dir):
    from sceneql.plans.q_speech import speaker_turns

    t = speaker_turns(spark, sf_dir)
    return t.select("video_id", S.timeline_lines(F.lit("speech"), "start_seconds", "end_seconds", "speaker").alias("line"))


@query("api_evaluate", A.sql("WITH p AS (SELECT video_id, scene_id FROM shots WHERE action_score >= 0.7e0), t AS (SELECT video_id, scene_id FROM shots WHERE emotion >= 0.7e0), u AS (SELECT coalesce(p.video_id, t.video_id) AS video_id, count(*) FILTER (p.scene_id IS NOT NULL AND t.scene_id IS NOT NULL) AS h, count(p.scene_id) AS np, count(t.scene_id) AS nt FROM p FULL JOIN t ON p.video_id = t.video_id AND p.scene_id = t.scene_id GROUP BY 1) SELECT round(avg(CASE WHEN h > 0 THEN 2e0 * h / (np + nt) ELSE 0e0 END), 6) AS f1, count(*) AS videos FROM u", "shots"))
def evaluate(spark, sf_dir):
    from sceneql.operators.evaluate import mask_scores

    s = A.shots(spark, sf_dir)
    d = mask_scores(s.where("action_score >= 0.7"), s.where("emotion >= 0.7"), ["video_id"], "scene_id")
    return d.agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("videos"))
