"""Shot scores, labels, regions and predicates, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneql.functions import vocabularies as L
from sceneql.operators.segments import CATEGORIES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def similarity(x) -> Column:
    """Raw image-text similarity, .15 to .35, as 0 to 1."""
    return clip((_c(x) - 0.15) / 0.20)


def cut_frequency(duration) -> Column:
    return clip((15.0 - _c(duration)) / 15.0)


def action(clip_action, energy, duration) -> Column:
    return 0.40 * similarity(clip_action) + 0.35 * _c(energy) + 0.25 * cut_frequency(duration)


def dialogue(speech_ratio, clip_dialogue, density) -> Column:
    return 0.45 * _c(speech_ratio) + 0.30 * similarity(clip_dialogue) + 0.25 * F.least(_c(density) / 3.0, F.lit(1.0))


def importance(act, dia, narrative, speech, energy, onset, emotion) -> Column:
    return 0.16 * F.greatest(_c(act), _c(dia)) + 0.39 * _c(narrative) + 0.17 * _c(speech) + 0.10 * _c(energy) + 0.10 * _c(onset) + 0.08 * _c(emotion)


def legacy_importance(position: Column, video: Column, act, dia, narrative, speech, energy, onset) -> Column:
    """The earlier weights: a U-shaped bonus for position, a bump near the resolution, and a weak tail of long films."""
    tail = (video >= 3600) & (position >= 0.95)
    u = F.when(tail, 0.25).when(position <= 0.20, 0.85).when(position >= 0.75, 0.90).otherwise(0.50)
    bump = F.when((position >= 0.925) & (position < 0.95), 0.12 * F.greatest(F.lit(0.0), 1.0 - F.abs(position - 0.9347) / 0.010)).otherwise(0.0)
    base = 0.16 * F.greatest(_c(act), _c(dia)) + 0.31 * _c(narrative) + 0.17 * _c(speech) + 0.10 * _c(energy) + 0.10 * _c(onset)
    return (base + 0.08 * u + bump) * F.when(tail, 0.15).otherwise(1.0)


def labels(act, dia, important) -> Column:
    some = F.array_compact(F.array(F.when(_c(act) >= 0.45, "action"), F.when(_c(dia) >= 0.40, "dialogue"), F.when(_c(important) >= 0.40, "important")))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("general")))


def credits(visual, position: Column, speech) -> Column:
    edge = F.greatest((0.03 - position) / 0.03, (position - 0.96) / 0.04, F.lit(0.0))
    return clip((0.65 * _c(visual) + 0.25 * edge + 0.10 * (1.0 - F.least(2.0 * _c(speech), F.lit(1.0)))) * F.when(edge == 0, 0.35).otherwise(1.0))


def any_word(text, words: Sequence[str]) -> Column:
    """Whether the text, lower-cased, holds any of the words."""
    low = F.lower(_c(text))
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(False))


def heuristic_credits(text, position: Column, dia, dark, words: Sequence[str] = L.CREDIT_WORDS) -> Column:
    """Keyword, edge of the video, silence and darkness; capped without a keyword before the last tenth."""
    word = any_word(text, words)
    h = F.when(word, 0.55).otherwise(0.0) + F.when((position >= 0.90) | (position <= 0.055), 0.25).otherwise(0.0) + F.when(_c(dia) < 0.1, 0.10).otherwise(0.0) + 0.20 * _c(dark)
    return clip(F.when(~word & (position < 0.90), F.least(h, F.lit(0.58))).otherwise(h))


def without_credits(df: DataFrame, probability: str, limit: float = 0.65) -> DataFrame:
    """Rows under the limit; all rows of a video that has none."""
    left = F.max((F.col(probability) < limit).cast("int")).over(Window.partitionBy("video_id"))
    return df.withColumn("_left", left).where((F.col(probability) < limit) | (F.col("_left") == 0)).drop("_left")


def scene_flags(text, dia, speech, change, action_words: Sequence[str] = L.ACTION_WORDS, music_words: Sequence[str] = L.MUSIC_WORDS) -> Column:
    """Which of dialogue, silent, action (by a word or by how much the picture changes) and music a scene is."""
    return F.array_compact(F.array(F.when(_c(dia) >= 0.40, "dialogue"), F.when(_c(speech) < 0.10, "silent"), F.when(any_word(text, action_words) | (_c(change) >= 0.72), "action"), F.when(any_word(text, music_words), "music")))


#: Weights of dialogue, audio, character, visual, uniqueness and structure, by content profile.
PROFILES = {"mixed": (24, 16, 16, 12, 21, 11), "action_led": (12, 23, 12, 23, 18, 12), "atmospheric": (8, 16, 10, 24, 30, 12), "ensemble": (21, 12, 25, 10, 20, 12), "dialogue_led": (31, 11, 16, 8, 22, 12)}


PARTS = ("dialogue", "audio", "character", "visual", "uniqueness", "structure")


def content_profile(df: DataFrame, flags: str, change: str, actors: str) -> DataFrame:
    """(video_id, profile, and the profile's six weights) from the shares of scenes by flag, how much the picture changes, and
    how the actors share the scenes.

    flags: array of scene_flags; actors: array of names. Rules in order: a third of action; silence with motion or music; four
    actors of which none dominates; dialogue.
    """
    share = lambda flag: F.avg(F.when(F.array_contains(flags, flag), 1.0).otherwise(0.0))
    each = df.select("video_id", F.explode(actors).alias("_who")).groupBy("video_id", "_who").agg(F.count("*").alias("_c"))
    spread = each.groupBy("video_id").agg(F.count("*").alias("_k"), (F.max("_c") / F.sum("_c")).alias("_most"))
    p = df.groupBy("video_id").agg(share("action").alias("_a"), share("silent").alias("_s"), share("music").alias("_m"), F.avg(change).alias("_v"), share("dialogue").alias("_d")).join(spread, "video_id", "left")
    still = (F.col("_s") >= 0.58) & ((F.col("_v") >= 0.35) | (F.col("_m") >= 0.25))
    profile = F.when(F.col("_a") >= 0.34, "action_led").when(still, "atmospheric").when((F.col("_k") >= 4) & (F.col("_most") < 0.58), "ensemble").when(F.col("_d") >= 0.62, "dialogue_led").otherwise("mixed")
    weights = F.create_map(*[x for name, w in PROFILES.items() for x in (F.lit(name), F.struct(*[F.lit(v).alias(n) for n, v in zip(PARTS, w)]))])
    return p.select("video_id", profile.alias("profile")).select("video_id", "profile", weights[F.col("profile")].alias("_w")).select("video_id", "profile", "_w.*")


def six_components(df: DataFrame, parts: Sequence[str], weights: Sequence[float | Column], intent: str, credit: str, strict: Column | None = None, matches: Column | None = None, relevance: str | None = None) -> DataFrame:
    """Rows under .72 credits with score and parts: the weighted parts, blended 65 to 35 with the intent, less the credit share.

    weights: numbers, or columns of the video's profile. strict: rows whose wish is exclusive go where they don't match it or
    are relevant by less than .55. parts: what each part adds to the score.
    """
    share = lambda w, p: (F.lit(w) if isinstance(w, (int, float)) else w) * F.col(p)
    total = sum((share(w, p) for w, p in zip(weights[1:], parts[1:])), share(weights[0], parts[0])) / 100.0
    d = df.where(F.col(credit) < 0.72)
    if strict is not None:
        d = d.where(~strict | ((F.lit(True) if matches is None else matches) & (F.lit(True) if relevance is None else F.col(relevance) >= 0.55)))
    told = F.map_from_arrays(F.array(*[F.lit(n) for n in PARTS]), F.array(*[F.round(0.65 * share(w, p) / 100.0, 6) for w, p in zip(weights, parts)]))
    return d.withColumn("score", (0.65 * (total * 1.0) + 0.35 * F.col(intent)) * (1.0 - F.col(credit))).withColumn("parts", told)


def repetition_penalty(df: DataFrame, score: str, look: str, free: int) -> DataFrame:
    """(video_id, scene_id, penalty): later ranks of a story lose by how like an earlier one they are."""
    w = Window.partitionBy("video_id", "story_id").orderBy(F.desc(score), "scene_id")
    r = df.select("video_id", "story_id", "scene_id", F.col(look).alias("look"), F.row_number().over(w).alias("rk"))
    a, b = r.alias("a"), r.alias("b")
    sim = a.join(b, F.expr("a.video_id = b.video_id and a.story_id = b.story_id and b.rk < a.rk")).groupBy("a.video_id", "a.scene_id").agg(F.max(1.0 - F.abs(F.col("a.look") - F.col("b.look"))).alias("sim"))
    redundancy = clip((F.coalesce("sim", F.lit(0.0)) - 0.52) / 0.48)
    penalty = F.when(F.col("rk") > free, F.least(F.lit(0.55), (F.col("rk") - free) * 0.14 * redundancy)).otherwise(0.0)
    return r.join(sim, ["video_id", "scene_id"], "left").select("video_id", "scene_id", F.round(penalty, 6).alias("penalty"))


#: The ten narrative regions, their inclusive upper bounds and their shares of the budget.
REGIONS = (("opening", 0.15, 0.15), ("development", 0.38, 0.18), ("middle", 0.65, 0.22), ("rising", 0.75, 0.05), ("conflict", 0.80, 0.05), ("turn", 0.81, 0.05), ("onset", 0.82, 0.05), ("climax", 0.90, 0.10), ("falling", 0.925, 0.05), ("resolution", 1.0, 0.10))


def _bands(x: Column, bands: Sequence[tuple], last, closed: bool = True) -> Column:
    out = None
    for name, bound in bands:
        c = x <= bound if closed else x < bound
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(last)


def narrative_region(position: Column) -> Column:
    return _bands(position, [(n, b) for n, b, _ in REGIONS[:-1]], REGIONS[-1][0])


def act(midpoint: Column) -> Column:
    return _bands(midpoint, [("act_i", 0.25), ("act_ii", 0.75)], "act_iii", closed=False)


def balanced_region(midpoint: Column) -> Column:
    return _bands(midpoint, list(zip(range(1, 6), (0.18, 0.45, 0.72, 0.82, 0.94))), 6)


def position_label(start: Column) -> Column:
    return F.when(start <= 0.20, "intro").when(start >= 0.75, "ending").otherwise("middle")


def estimated_duration(duration, category: str, override: Column | None = None) -> Column:
    shortest, _, longest, pre, post, _ = CATEGORIES.get(category, CATEGORIES["importance"])
    out = clip(_c(duration) + pre + post, shortest, longest)
    return out if override is None else F.coalesce(override, out)


def candidate_limit(minutes: Column) -> Column:
    return _bands(minutes, [(16, 10), (24, 30), (32, 60), (40, 90), (48, 150), (56, 165)], 72)


def config(category) -> Column:
    """A category's shortest, wanted and longest seconds, lead-in, lead-out and gap, as a struct; unknown ones count as importance."""
    def of(values: Sequence[float]) -> Column:
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("shortest", "target", "longest", "before", "after", "gap"), values)])

    known = F.create_map(*[x for name, v in CATEGORIES.items() for x in (F.lit(name), of(v))])
    return F.coalesce(known[_c(category)], of(CATEGORIES["importance"]))


def colour(overlap, act_, dia) -> Column:
    return F.when(_c(overlap) >= 0.9, "overlap").when((_c(act_) >= 0.45) & (_c(act_) >= _c(dia)), "action").when(_c(dia) >= 0.40, "dialogue").otherwise("neutral")


def fade(duration, speech) -> Column:
    d = F.least(F.lit(0.35), _c(duration) * 0.1)
    return F.when(_c(speech) > 0.1, "").otherwise(F.format_string("afade=t=in:st=0:d=%.4f,afade=t=out:st=%.4f:d=%.4f", d, _c(duration) - d, d))


def recommendation_limit(n, target) -> Column:
    return F.least(_c(n), F.lit(24), F.greatest(F.lit(8), F.ceil(_c(target) / 15.0)))


def clock(seconds) -> Column:
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(_c(seconds) / 60).cast("long"), s % 60)


def key_frame(start, end) -> Column:
    return F.least(_c(end) - 0.05, _c(start) + F.greatest(F.lit(0.05), 0.55 * (_c(end) - _c(start))))


def anomalies(duration: Column, words_per_second: Column) -> Column:
    return F.array_compact(F.array(F.when(duration >= 90, "extreme_duration"), F.when((duration > 45) & (words_per_second < 0.20), "sparse")))


def hybrid(local, judged, partial: Column) -> Column:
    """Local and judged score: 45 to 55; of a partial answer 75 to 25, and not under the local floor."""
    return F.when(partial, F.greatest(0.75 * _c(local) + 0.25 * _c(judged), 0.82 + 0.18 * _c(local))).otherwise(0.45 * _c(local) + 0.55 * _c(judged))


def asr_rows(df: DataFrame, no_speech: str, text: str, start: str, ahead: float) -> DataFrame:
    return df.where((F.col(no_speech) <= 0.65) & (F.trim(text) != "") & (F.col(start) <= ahead))


def good_caption(tokens: Column) -> Column:
    """Three words or more, none of the phrases that say nothing, and not too many repeats among six or more."""
    n = F.size(tokens)
    generic = F.exists(F.array(*map(F.lit, L.GENERIC_CAPTIONS)), lambda p: F.contains(F.lower(F.array_join(tokens, " ")), p))
    return (n >= 3) & ~generic & ((n < 6) | (F.size(F.array_distinct(tokens)) / n >= 0.35))


def valid_recommendations(made: DataFrame, allowed: DataFrame, context: str | None = None, most: int = 4) -> DataFrame:
    """Rows with an allowed id and a reason, the first of an id, priorities within 1 and 100, reasons of at most 300 characters.

    context: a column with an array of ids; the first `most` of them that are allowed stay, each once.
    """
    ok = made.join(allowed, ["video_id", "scene_id"], "left_semi").where(F.trim("reason") != "")
    w = Window.partitionBy("video_id", "scene_id").orderBy("priority", "reason")
    d = ok.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    out = ["video_id", "scene_id", F.least(F.greatest("priority", F.lit(1)), F.lit(100)).alias("priority"), F.substring("reason", 1, 300).alias("reason")]
    if context is None:
        return d.select(*out)
    asked = d.select("video_id", "scene_id", F.posexplode(F.array_distinct(context)).alias("_at", "_id"))
    known = asked.join(allowed.select("video_id", F.col("scene_id").alias("_id")).distinct(), ["video_id", "_id"], "left_semi")
    ids = known.groupBy("video_id", "scene_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"]), 1, most).alias("context"))
    return d.select(*out).join(ids, ["video_id", "scene_id"], "left").withColumn("context", F.coalesce("context", F.array().cast(ids.schema["context"].dataType)))


def transition(gap: Column) -> Column:
    return F.when(gap.isNull(), "start").when(gap <= 2.5, "merge").when(gap < 30, "hard_cut").otherwise("crossfade")


def request(df: DataFrame, text: str, people: str | None = None, strict: Column | None = None, types: Mapping[str, Sequence[str]] = L.REQUEST_TYPES, markers: Sequence[str] = L.STRICT_MARKERS) -> DataFrame:
    """df with request (single spaces, 1000 characters), types of scene that its words ask for, in order of name, people (12 names
    of 80 characters, parted by commas, semicolons or lines) and strict, by a flag or a word."""
    r = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 1000)
    kinds = F.array_compact(F.array(*[F.when(any_word("request", words), name) for name, words in sorted(types.items())]))
    names = F.transform(F.filter(F.split(F.coalesce(people or text, F.lit("")), "[,;\n]+"), lambda x: F.trim(x) != ""), lambda x: F.substring(F.trim(x), 1, 80))
    given = F.lit(False) if strict is None else strict
    return df.withColumn("request", r).withColumn("types", kinds).withColumn("people", F.slice(names, 1, 12)).withColumn("strict", given | any_word("request", markers))


def payload(parts: Mapping[str, tuple[str, int]]) -> Column:
    return F.to_json(F.struct(*[F.substring(c, 1, n).alias(k) for k, (c, n) in parts.items()]))


#: The share of the time in which a role may occur, by role; the words are parameters.
ROLES = {"inciting_incident": (0.15, 0.30), "midpoint": (0.45, 0.55), "climax": (0.80, 0.95), "resolution": (0.85, 0.99)}


def turning_points(turns: DataFrame, text: str, event: str, terms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(video_id, role, turn, confidence, status): the best-supported turn of each role in its part of the time.

    A role's evidence is a word that begins with one of its terms; confidence is .45, up to .20 for two terms and .35 of
    the turn's event score, .55 at least, and the higher event score wins among equals, then the earlier turn. After a
    climax with evidence, a resolution must follow it.
    """
    terms = terms or L.EVENT_TERMS
    total = F.max("end_seconds").over(Window.partitionBy("video_id"))
    t = turns.withColumn("_at", (F.col("start_seconds") + F.col("end_seconds")) / 2 / total)
    kinds = turns.sparkSession.createDataFrame([(r, lo, hi, list(terms[r])) for r, (lo, hi) in ROLES.items()], "role string, lo double, hi double, terms array<string>")
    j = t.join(F.broadcast(kinds), (F.col("_at") >= F.col("lo")) & (F.col("_at") <= F.col("hi")))  # four rows
    words = F.split(F.lower(F.col(text)), r"[^\p{L}]+")
    n = F.size(F.filter("terms", lambda x: F.exists(words, lambda w: F.startswith(w, x))))
    sure = F.least(F.lit(1.0), 0.45 + 0.35 * F.coalesce(F.col(event).cast("double"), F.lit(0.0)) + 0.20 * F.least("_n", F.lit(2)) / 2)
    j = j.withColumn("_n", n).where("_n >= 1").withColumn("confidence", F.round(sure, 3)).where(sure >= 0.55)

    def best(d: DataFrame) -> DataFrame:
        return d.groupBy("video_id", "role").agg(F.max_by(F.struct("turn", "confidence", "_at", "_n"), F.struct("confidence", F.coalesce(F.col(event), F.lit(0.0)), -F.col("_at"), -F.col("turn"))).alias("b"))

    climax = best(j.where("role = 'climax'")).where("b._n >= 2").select("video_id", F.col("b._at").alias("_climax"))
    late = j.where("role = 'resolution'").join(climax, "video_id", "left").where("_climax is null or _at > _climax").drop("_climax")
    d = best(j.where("role <> 'resolution'").unionByName(late))
    return d.select("video_id", "role", F.col("b.turn").alias("turn"), F.col("b.confidence").alias("confidence"), F.when(F.col("b._n") >= 2, "evidence_found").otherwise("candidate_unverified").alias("status"))
