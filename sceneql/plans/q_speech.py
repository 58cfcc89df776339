"""Queries of speech (IVL-6, 7, 9 to 11, 18, 20 to 25)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.operators import joins as J
from sceneql.operators import speech as S
from sceneql.operators.groups import by_arrays, by_group
from sceneql.plans import adapters as A
from sceneql.plans.registry import query

_END = "regexp_matches({}, '[.!?]+$')"


@query("ivl_6_utterances", A.sql(f"""
WITH f AS (SELECT *, lag({_END.format('word')}) OVER w AS pf, start_seconds - lag(end_seconds) OVER w AS gap FROM words WINDOW w AS (PARTITION BY video_id ORDER BY start_seconds, end_seconds, word)),
g AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf OR gap >= 2.75e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds, word ROWS UNBOUNDED PRECEDING) AS u FROM f)
SELECT video_id, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, count(*) AS n, string_agg(word, ' ' ORDER BY start_seconds, end_seconds, word) AS text FROM g GROUP BY video_id, u""", "words"))
def utterances(spark, sf_dir):
    return S.utterances(A.words(spark, sf_dir), ["video_id"]).drop("closed_by", "complete")


@query("ivl_7_whole_turns", A.sql("""
WITH RECURSIVE t AS (SELECT DISTINCT video_id, start_seconds, end_seconds, regexp_matches(trim(text), '[.!?…]+(["”’)\\]]+)?$') AS fin FROM turns WHERE trim(text) <> '' AND end_seconds - start_seconds <= 90e0),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds) AS rn FROM t),
r AS (SELECT video_id, rn, start_seconds, end_seconds, fin, 1 AS g FROM o WHERE rn = 1
 UNION ALL SELECT o.video_id, o.rn, CASE WHEN j THEN r.start_seconds ELSE o.start_seconds END, CASE WHEN j THEN greatest(r.end_seconds, o.end_seconds) ELSE o.end_seconds END, o.fin, CASE WHEN j THEN g ELSE g + 1 END
 FROM (SELECT r.*, o2.rn AS orn, o2.start_seconds AS os, (NOT r.fin AND o2.start_seconds - r.end_seconds BETWEEN 0 AND 0.8e0 AND o2.end_seconds - r.start_seconds <= 45e0) AS j FROM r JOIN o o2 ON o2.video_id = r.video_id AND o2.rn = r.rn + 1) r JOIN o ON o.video_id = r.video_id AND o.rn = r.orn)
SELECT video_id, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds FROM r GROUP BY video_id, g""", "turns"))
def whole_turns(spark, sf_dir):
    return S.whole_turns(A.turns(spark, sf_dir), ["video_id"])


@query("ivl_11_window_description", A.sql("SELECT q.video_id, q.turn, count(w.word) > 0 AS has_speech, count(w.word) AS word_count, coalesce(string_agg(w.word, ' ' ORDER BY w.start_seconds), '') AS text FROM (SELECT video_id, turn, start_seconds + 0.6e0 AS a, start_seconds + 3.1e0 AS z FROM turns) q LEFT JOIN words w ON w.video_id = q.video_id AND w.end_seconds > a AND w.start_seconds < z GROUP BY ALL", "words"))
def window_description(spark, sf_dir):
    q = A.turns(spark, sf_dir).select("video_id", "turn", (F.col("start_seconds") + 0.6).alias("start_seconds"), (F.col("start_seconds") + 3.1).alias("end_seconds"))
    return S.describe(q, A.words(spark, sf_dir).drop("turn"), ["video_id"], "turn")


def _utterances(spark, sf_dir):
    u = S.utterances(A.words(spark, sf_dir), ["video_id"], ["the", "de", "und", "y", "et", "and"])
    return u.select("video_id", F.col("start_seconds").alias("s"), F.col("end_seconds").alias("e"), "text", "complete", T.continues("text", ["and", "et", "und", "y"]).alias("continues"), T.asks("text").alias("asks"))


def _said(g: dict) -> S.Said:
    u, w = g["said"], g.get("words")
    return S.Said.of(zip(*(u[c] for c in ("s", "e", "complete", "continues", "asks"))), zip(w["start_seconds"], w["end_seconds"]) if w else ())


@query("ivl_9_expand_complete")
def expand_complete(spark, sf_dir):
    def f(g):
        said = _said(g)
        return [(a, *S.expand_complete(a + 0.3, a + 2.3, said)) for a in said.starts.tolist()]

    return by_arrays({"said": (_utterances(spark, sf_dir), ["s", "e"])}, ["video_id"], f, "at double, start_seconds double, end_seconds double")


@query("ivl_10_alignment")
def alignment(spark, sf_dir):
    def f(g):
        said, out = _said(g), []
        for a in said.starts.tolist():
            got = S.align(a + 0.5, a + 5.0, said, "dialogue", 18.0)
            out.append((a, got["start"], got["end"], got["mode"], got["reasons"]))
        return out

    frames = {"said": (_utterances(spark, sf_dir), ["s", "e"]), "words": (A.words(spark, sf_dir).select("video_id", "start_seconds", "end_seconds"), ["start_seconds", "end_seconds"])}
    return by_arrays(frames, ["video_id"], f, "at double, start_seconds double, end_seconds double, mode string, reasons string")


@query("ivl_20_word_speakers")
def word_speakers(spark, sf_dir):
    t = A.turns(spark, sf_dir).select("video_id", "start_seconds", (F.col("end_seconds") - 0.2).alias("end_seconds"), "speaker")
    return S.word_speakers(A.words(spark, sf_dir), t)


@query("ivl_21_speaker_turns")
def speaker_turns(spark, sf_dir):
    from sceneql.operators import intervals as I

    s = word_speakers(spark, sf_dir).withColumn("end_seconds", F.col("start_seconds") + 0.35)
    return I.merge_same(s, ["video_id"], "speaker", "start_seconds", "end_seconds", None)


@query("ivl_18_overlap_relabel", A.sql("WITH a AS (SELECT video_id, span_id, start_day, end_day FROM spans WHERE status <> 'F'), b AS (SELECT video_id, speaker, start_day AS ts, end_day AS te FROM spans WHERE status = 'F'), s AS (SELECT a.video_id, span_id, speaker, sum(least(end_day, te) - greatest(start_day, ts)) AS d, min((ts, te)) AS f FROM a JOIN b ON a.video_id = b.video_id AND te > start_day AND ts < end_day GROUP BY ALL) SELECT a.video_id, a.span_id, coalesce(speaker, -1) AS speaker FROM a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id, span_id ORDER BY d DESC, f, speaker) AS r FROM s) x ON x.span_id = a.span_id AND r = 1", "spans"))
def overlap_relabel(spark, sf_dir):
    s = A.spans(spark, sf_dir)
    a = s.where("status <> 'F'").select("video_id", "span_id", "start_day", "end_day")
    b = s.where("status = 'F'").select("video_id", "speaker", F.col("start_day").alias("ts"), F.col("end_day").alias("te"))
    best = J.largest_overlap(a, b, ["video_id"], "span_id", "start_day", "end_day", "ts", "te", "speaker", 8.0)
    return a.join(best.select("span_id", "speaker"), "span_id", "left").select("video_id", "span_id", F.coalesce("speaker", F.lit(-1)).alias("speaker"))


@query("ivl_22_transcript_repair", A.sql("WITH g AS (SELECT video_id, start_seconds, end_seconds, text FROM turns), bad AS (SELECT * FROM g WHERE end_seconds - start_seconds > 20e0), c AS (SELECT video_id, unnest(range(0, 2000, 5))::DOUBLE AS s FROM (SELECT DISTINCT video_id FROM turns)), u AS (SELECT * FROM g WHERE NOT (end_seconds - start_seconds > 20e0) UNION ALL SELECT c.video_id, s, s + 5e0, 'chunk' FROM c JOIN bad ON bad.video_id = c.video_id AND s + 2.5e0 >= bad.start_seconds AND s + 2.5e0 < bad.end_seconds) SELECT video_id, start_seconds, end_seconds, text, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds, text)::INT AS id FROM u", "turns"))
def transcript_repair(spark, sf_dir):
    t = A.turns(spark, sf_dir).select("video_id", "start_seconds", "end_seconds", "text")
    c = t.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0), F.lit(1995), F.lit(5))).alias("start_seconds"))
    c = c.withColumn("start_seconds", F.col("start_seconds").cast("double")).withColumn("end_seconds", F.col("start_seconds") + 5.0).withColumn("text", F.lit("chunk"))
    return S.repair(t, c, ["video_id"], F.col("end_seconds") - F.col("start_seconds") > 20.0).drop("repaired")


@query("ivl_23_boundary_verification", A.sql("""
WITH q AS (SELECT video_id, turn, start_seconds + 0.85e0 AS a, end_seconds - 0.75e0 AS z, max(end_seconds) OVER (PARTITION BY video_id) AS d FROM turns),
f AS (SELECT q.video_id, q.turn, max(w.end_seconds) AS far FROM q JOIN words w ON w.video_id = q.video_id AND w.start_seconds < z + 0.05e0 AND w.end_seconds > z + 0.05e0 GROUP BY ALL),
n AS (SELECT q.video_id, q.turn, min(w.start_seconds) AS near FROM q JOIN words w ON w.video_id = q.video_id AND w.start_seconds < a - 0.05e0 AND w.end_seconds > a - 0.05e0 GROUP BY ALL),
e AS (SELECT q.*, least(coalesce(lead(a) OVER (PARTITION BY video_id ORDER BY a, z, turn), d), d, z + 1.5e0, far + 0.3e0) AS m, far FROM q LEFT JOIN f USING (video_id, turn)),
g AS (SELECT *, CASE WHEN far IS NOT NULL AND m > z + 0.05e0 THEN round(m, 3) ELSE z END AS y FROM e),
h AS (SELECT g.*, near, greatest(near - 0.3e0, coalesce(lag(y) OVER (PARTITION BY g.video_id ORDER BY a, z, g.turn), 0e0), a - 1.5e0, 0e0) AS b FROM g LEFT JOIN n ON n.video_id = g.video_id AND n.turn = g.turn)
SELECT h.video_id, h.turn, round(CASE WHEN near IS NOT NULL AND b < a - 0.05e0 THEN round(b, 3) ELSE a END, 6) AS start_seconds, round(y, 6) AS end_seconds FROM h""", "words"))
def boundary_verification(spark, sf_dir):
    # segments that begin and end inside a turn's words
    t = A.turns(spark, sf_dir).withColumn("d", F.max("end_seconds").over(Window.partitionBy("video_id")))
    q = t.select("video_id", "turn", (F.col("start_seconds") + 0.85).alias("start_seconds"), (F.col("end_seconds") - 0.75).alias("end_seconds"), "d")
    got = S.verified_edges(q, A.words(spark, sf_dir), ["video_id"], "turn", "d")
    return got.select("video_id", "turn", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"))


@query("ivl_24_silence_refinement", A.sql("SELECT q.video_id, q.turn, round(max(w.end_seconds) + 0.45e0, 6) AS refined FROM (SELECT video_id, turn, start_seconds + 12e0 AS z FROM turns) q JOIN words w ON w.video_id = q.video_id AND w.end_seconds > z - 15e0 AND w.start_seconds < z + 8e0 WHERE regexp_matches(w.word, '[.!?]$') GROUP BY ALL", "words"))
def silence_refinement(spark, sf_dir):
    q = A.turns(spark, sf_dir).select("video_id", F.col("turn").alias("q"), (F.col("start_seconds") + 12.0 - 15.0).alias("lo"), (F.col("start_seconds") + 12.0 + 8.0).alias("hi"))
    w = A.words(spark, sf_dir).where(F.col("word").rlike("[.!?]$")).select("video_id", "start_seconds", "end_seconds")
    hits = J.overlap_join(q, w, ["video_id"], "lo", "hi", "start_seconds", "end_seconds", 30.0)
    return hits.groupBy("video_id", F.col("q").alias("turn")).agg(F.round(F.max("end_seconds") + 0.45, 6).alias("refined"))


@query("ivl_25_safe_budget_end", A.sql(f"""
WITH f AS (SELECT *, lag({_END.format('word')}) OVER w AS pf, start_seconds - lag(end_seconds) OVER w AS gap FROM words WINDOW w AS (PARTITION BY video_id ORDER BY start_seconds, end_seconds, word)),
g AS (SELECT *, sum(CASE WHEN pf IS NULL OR pf OR gap >= 2.75e0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds, word ROWS UNBOUNDED PRECEDING) AS u FROM f),
u AS (SELECT video_id, max(end_seconds) AS e, arg_max(word, start_seconds) AS last FROM g GROUP BY video_id, u),
a AS (SELECT video_id, max(e) AS ue FROM u WHERE NOT regexp_matches(last, '[,;:]$') AND e <= 8.02e0 GROUP BY video_id),
b AS (SELECT t.video_id, max(t.end_seconds - 0.1e0) AS se FROM turns t WHERE t.end_seconds - 0.1e0 <= 8.02e0 AND NOT EXISTS (SELECT 1 FROM words w WHERE w.video_id = t.video_id AND w.start_seconds + 0.02e0 < t.end_seconds - 0.1e0 AND t.end_seconds - 0.1e0 < w.end_seconds - 0.02e0) GROUP BY t.video_id),
c AS (SELECT video_id, max(end_seconds) AS we FROM words WHERE end_seconds <= 8.02e0 GROUP BY video_id)
SELECT video_id, round(coalesce(ue, se, we, 8e0), 6) AS "end", CASE WHEN ue IS NOT NULL THEN 'sentence' WHEN se IS NOT NULL THEN 'shot' WHEN we IS NOT NULL THEN 'word' ELSE 'target' END AS mode FROM (SELECT DISTINCT video_id FROM turns) LEFT JOIN a USING (video_id) LEFT JOIN b USING (video_id) LEFT JOIN c USING (video_id)""", "words"))
def safe_budget_end(spark, sf_dir):
    # shots end a tenth of a second before the turns; eight seconds, so that every kind of end occurs
    shots = A.turns(spark, sf_dir).withColumn("end_seconds", F.col("end_seconds") - 0.1)
    w = A.words(spark, sf_dir)
    return S.safe_end(S.utterances(w, ["video_id"]), shots, w, ["video_id"], 8.0).withColumn("end", F.round("end", 6))
