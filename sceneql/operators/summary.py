"""The main plan of a summary: from scored shots to the segments of each video that fit a time budget.

Credits go, scores are smoothed and filtered, shots are chosen, expanded by context, snapped to shot edges and merged, as
window functions and joins on (video, time bucket). Two steps know a whole video at once, as arrays: which shots to choose,
and, once segments are aligned to what is said, which of them keep the budget. What is chosen is merged again and cuts into
no turn. Each of the steps is a function of its own here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.functions import vocabularies as L
from sceneql.operators import intervals as I
from sceneql.operators import scoring as P
from sceneql.operators import selection as S
from sceneql.operators import speech
from sceneql.operators import windows as W
from sceneql.operators.groups import by_arrays
from sceneql.operators.joins import overlap_join
from sceneql.operators.segments import CATEGORIES, speech_safe
from sceneql.sources.tables import shared_folder

#: Columns that a table of shots may have, and what stands in for one that it lacks.
OPTIONAL = {
    "credit_probability": "0.0D", "event": "0.0D", "story": "cast(null as string)", "position": "cast(null as double)", "action_score": "0.0D", "dialogue_score": "0.0D", "importance_score": "0.0D",
    "clip_action": "action_score", "clip_dialogue": "dialogue_score", "energy": "0.0D", "speech_ratio": "0.0D", "transcript_text": "cast(null as string)", "caption": "cast(null as string)", "judged": "0.0D", "hybrid": "cast(null as double)", "video_duration": "cast(null as double)",
}
KEY = ["video_id"]
#: From how many shots on regions are chosen from, and seconds of room around what is said.
FEWEST, PAD = 6, 0.45


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: the steps of the plan read it many times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded(target: float | None) -> bool:
    return target is not None and 0 < target < 9999


def prepared(shots: DataFrame, score: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Shots by their own names: score, raw and smoothed, and every column of OPTIONAL. Credits and nulls of them are gone."""
    named = dict(columns or {})
    d = shots.select("video_id", "scene_id", F.col("start_seconds").cast("double").alias("start_seconds"), F.col("end_seconds").cast("double").alias("end_seconds"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("raw_score"), *[F.col(named.get(c, c)).alias(c) for c in OPTIONAL if named.get(c, c) in shots.columns])
    for c, default in OPTIONAL.items():
        d = d.withColumn(c, F.expr(default) if c not in d.columns else F.coalesce(F.col(c), F.expr(default).cast(d.schema[c].dataType)))
    d = P.without_credits(d, "credit_probability").withColumn("story", F.col("story").cast("string"))
    d = d.withColumn("video_duration", F.coalesce("video_duration", F.max("end_seconds").over(Window.partitionBy(*KEY))).cast("double"))
    return W.smooth(d, "raw_score", "smoothed_score")


def middle() -> Column:
    return (F.col("start_seconds") + F.col("end_seconds")) / 2 / F.greatest("video_duration", F.lit(0.001))


def choose_shots(shots: DataFrame, category: str, target: float | None, distribution: str = "adaptive") -> DataFrame:
    """(video_id, scene_id, mmr_score) of the shots to build segments from; shots: prepared and eligible, with `required`.

    Importance with an adaptive distribution takes soft diversity over each story's two best; other categories, and
    importance by acts, take region_select: acts for importance, else three parts of the time where the target is short
    for ten regions, else ten. All shots where there is no budget or a video has fewer than six.
    """
    shortest, _, longest, pre, post, _ = CATEGORIES.get(category, CATEGORIES["importance"])
    importance = category == "importance"
    compact = bounded(target) and target < shortest * len(P.REGIONS)
    region = P.act(middle()) if importance else P.position_label(middle()) if compact else P.narrative_region(F.coalesce("position", middle()))
    quotas = S.ACT_QUOTAS if importance else S.COMPACT_QUOTAS if compact else {n: q for n, _, q in P.REGIONS}
    vector = ["clip_action", "clip_dialogue", "importance_score", "energy", "speech_ratio", "length", "middle"]
    d = shots.withColumn("length", F.least((F.col("end_seconds") - F.col("start_seconds")) / 20.0, F.lit(1.0))).withColumn("middle", P.clip(middle())).withColumn("region", region)
    d = d.withColumn("seconds", P.clip(F.col("end_seconds") - F.col("start_seconds") + pre + post, shortest, longest)).withColumn("at", F.coalesce("position", middle()))
    d = d.select("video_id", "start_seconds", "scene_id", "smoothed_score", "seconds", "at", "region", "story", "required", *vector)

    def choose(g: dict) -> list[tuple]:
        s = g["shots"]
        score, must = s["smoothed_score"], s["required"].astype(bool)
        if not bounded(target) or (len(score) < FEWEST and not (importance and distribution == "adaptive")):
            return [(i, float(x)) for i, x in zip(s["scene_id"].tolist(), score)]
        if importance and distribution == "adaptive":
            pick = S.adaptive_rows(score, s["seconds"], s["at"], s["story"], target, must)
            return [(int(s["scene_id"][i]), float(score[i])) for i in pick]
        x = np.stack([s[c].astype(float) for c in vector], axis=1)
        found = S.region_select(score, s["seconds"], s["region"], s["story"], x, quotas, target, S.DIVERSITY.get(category, S.DIVERSITY["importance"]), shortest, must, importance)
        return [(int(s["scene_id"][i]), m) for i, m, _ in found]

    return by_arrays({"shots": (d, ["start_seconds", "scene_id"])}, KEY, choose, "scene_id long, mmr_score double")


def conflict_bridges(chosen: DataFrame, shots: DataFrame, least_gap: float = 90.0, most: int = 2, floors: tuple[float, float] = (0.50, 0.80), quiet: float = 0.35) -> DataFrame:
    """(video_id, scene_id): the first shot of a sustained conflict in a long gap between chosen shots of the last act.

    A gap of 90 s or more, from .72 of the time on, to a shot at .80 to .94; the shot begins in its first 45 %, 180 s at
    most, and 5 s inside, has an action score of .5, an event score of .8, at most .35 of speech, and two more such shots
    begin within 30 s. Two a video.
    """
    w = Window.partitionBy(*KEY).orderBy("start_seconds", "scene_id")
    at = F.coalesce("position", F.col("start_seconds") / F.greatest("video_duration", F.lit(0.001)))
    g = chosen.withColumn("_at", at).withColumn("_from", F.lag("end_seconds").over(w)).withColumn("_before", F.lag("_at").over(w))
    gap = F.col("start_seconds") - F.col("_from")
    g = g.where((gap >= least_gap) & (F.col("_before") >= 0.72) & F.col("_at").between(0.80, 0.94))
    g = g.select("video_id", F.col("scene_id").alias("_gap"), (F.col("_from") + 5.0).alias("_lo"), F.least(F.col("start_seconds") - 5.0, F.col("_from") + F.least(0.45 * gap, F.lit(180.0))).alias("_hi")).where("_hi >= _lo")
    fit = shots.where((F.col("action_score") >= floors[0]) & (F.col("event") >= floors[1]) & (F.col("speech_ratio") <= quiet)).join(chosen.select("video_id", "scene_id"), ["video_id", "scene_id"], "left_anti")
    fit = fit.select("video_id", "scene_id", F.col("start_seconds").alias("_s"), F.col("start_seconds").alias("_e"))
    hits = overlap_join(g, fit, KEY, "_lo", "_hi", "_s", "_e", 60.0, -1e-9)
    hits = W.sustained(hits, "_s", 30.0, 3, "_on", ("video_id", "_gap")).where("_on")
    first = hits.groupBy("video_id", "_gap").agg(F.min(F.struct("_s", "scene_id")).alias("f"))
    order = Window.partitionBy(*KEY).orderBy("f")
    return first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("video_id", F.col("f.scene_id").alias("scene_id"))


def _marked(markers: Sequence[str]) -> Column:
    told = F.lower(F.concat_ws(" ", "transcript_text", "caption"))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(told, m))


def event_chains(chosen: DataFrame, shots: DataFrame, target: float, markers: Sequence[str] = L.CHAIN_MARKERS, reach: float = 26.0, cap: float = 30.0, horizon: float = 50.0) -> DataFrame:
    """(video_id, scene_id, chain_start, chain_end, late, anchor_value): the stretch around chosen shots of a high event value.

    A shot is an anchor by its event score (.94), a judge's score (.75), a hybrid score (.94) or a marker in what is said or
    seen; an act has one anchor, the second and third two, a video one for each 45 s of the target, two to eight. The chain
    begins with the shot before, if that ends within 4 s, and ends with the best of the shots that begin within 26 s; for a
    late event (.90, between .80 and .94 of the time) with the last strong one that ends within 50 s. It is cut at the
    beginning to 30 s, or 50. No chain under a target of 90 s.
    """
    w = Window.partitionBy(*KEY).orderBy("start_seconds", "scene_id")
    d = shots.withColumn("_n", F.row_number().over(w)).withColumn("_ps", F.lag("start_seconds").over(w)).withColumn("_pe", F.lag("end_seconds").over(w))
    value = 0.40 * F.col("event") + 0.30 * F.col("judged") + 0.20 * F.coalesce("hybrid", "smoothed_score") + 0.10 * F.col("importance_score") + F.when(_marked(markers), 0.20).otherwise(0.0)
    strong = (F.col("event") >= 0.94) | (F.col("judged") >= 0.75) | (F.coalesce("hybrid", F.lit(0.0)) >= 0.94) | _marked(markers)
    a = d.join(chosen.select("video_id", "scene_id"), ["video_id", "scene_id"], "left_semi").where(strong).withColumn("anchor_value", value).withColumn("_act", P.act(middle()))
    best = [F.desc("anchor_value"), "scene_id"]
    a = a.withColumn("_r", F.row_number().over(Window.partitionBy("video_id", "_act").orderBy(*best))).where(F.col("_r") <= F.when(F.col("_act") == "act_i", 1).otherwise(2))
    a = a.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*best))).where(F.col("_r") <= (max(2, min(8, round(target / 45.0))) if target >= 90.0 else 0))
    late = (F.col("event") >= 0.90) & (F.col("start_seconds") / F.greatest("video_duration", F.lit(0.001))).between(0.80, 0.94)
    a = a.select("video_id", "scene_id", "anchor_value", "start_seconds", "end_seconds", F.col("_n").alias("_at"), late.alias("late"), F.when(F.col("start_seconds") - F.col("_pe") <= 4.0, F.col("_ps")).otherwise(F.col("start_seconds")).alias("_setup"))
    b = d.select("video_id", "_n", F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"), F.col("event").alias("_event"), (0.50 * F.col("event") + 0.25 * F.col("action_score") + 0.25 * F.col("importance_score")).alias("_worth"))
    ahead = overlap_join(a.withColumn("_to", F.col("end_seconds") + max(reach, horizon)), b, KEY, "start_seconds", "_to", "_s", "_e", 30.0, -1e-9).where(F.col("_n") > F.col("_at"))
    payoff = F.max(F.when(F.col("_s") <= F.col("end_seconds") + reach, F.struct("_worth", "_e")))
    after = F.max(F.when(F.col("late") & (F.col("_e") <= F.col("end_seconds") + horizon) & (F.col("_event") >= 0.90), F.struct("_n", "_e")))
    found = ahead.groupBy("video_id", "scene_id").agg(payoff.alias("_p"), after.alias("_l"))
    d = a.join(found, ["video_id", "scene_id"], "left").withColumn("chain_end", F.greatest("end_seconds", F.col("_p._e"), F.col("_l._e")))
    start = F.greatest(F.col("_setup"), F.col("chain_end") - F.when(F.col("late"), horizon).otherwise(cap))
    return d.select("video_id", "scene_id", F.round(start, 3).alias("chain_start"), F.round("chain_end", 3).alias("chain_end"), "late", F.round("anchor_value", 4).alias("anchor_value"))


def act_reserves(chosen: DataFrame, shots: DataFrame, per_act: int = 8) -> DataFrame:
    """(video_id, scene_id): each act's best shots of stories that nothing chosen or taken in an earlier act belongs to, one a
    story, per_act at most. A shot without a story is a story of its own."""
    key = F.coalesce(F.concat(F.lit("s"), "story"), F.concat(F.lit("r"), F.col("scene_id").cast("string")))
    d = shots.withColumn("_story", key).withColumn("_act", P.act(middle()))
    taken = d.join(chosen.select("video_id", "scene_id"), ["video_id", "scene_id"], "left_semi").select("video_id", "_story")
    order = [F.desc("smoothed_score"), F.desc("event"), "scene_id"]
    out = None
    for act in S.ACT_QUOTAS:  # three rounds
        pool = d.where(F.col("_act") == act).join(taken.distinct(), ["video_id", "_story"], "left_anti")
        once = pool.withColumn("_r", F.row_number().over(Window.partitionBy("video_id", "_story").orderBy(*order))).where("_r = 1")
        own = once.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where(F.col("_r") <= per_act).select("video_id", "scene_id", "_story")
        own = kept(own)
        out, taken = own if out is None else out.unionByName(own), taken.unionByName(own.select("video_id", "_story"))
    return out.select("video_id", "scene_id")


def with_edges(picked: DataFrame, shots: DataFrame, category: str) -> DataFrame:
    """picked with expanded_start and expanded_end, by role, and edges snapped to the nearest shot edges.

    An anchor keeps its chain, a bridge has 8 s around it, any other shot the category's context; for importance, up to two
    following shots while their event score is .90 or more. What is shorter than the shortest segment grows on both sides.
    """
    shortest, _, _, pre, post, _ = CATEGORIES.get(category, CATEGORIES["importance"])
    w = Window.partitionBy(*KEY).orderBy("start_seconds", "scene_id")
    first, second = F.coalesce(F.lead("event", 1).over(w) >= 0.90, F.lit(False)), F.coalesce(F.lead("event", 2).over(w) >= 0.90, F.lit(False))
    ahead = F.when(first & second, F.greatest(F.lead("end_seconds", 1).over(w), F.lead("end_seconds", 2).over(w))).when(first, F.lead("end_seconds", 1).over(w))
    lead = shots.select("video_id", "scene_id", ahead.alias("_ahead"))
    d = picked.join(lead, ["video_id", "scene_id"], "left")
    bridge, anchor = F.col("role") == "bridge", F.col("role") == "anchor"
    a = F.when(anchor, F.col("chain_start")).otherwise(F.col("start_seconds") - F.when(bridge, 8.0).otherwise(pre))
    z = F.when(anchor, F.col("chain_end")).otherwise(F.col("end_seconds") + F.when(bridge, 8.0).otherwise(post))
    if category == "importance":
        z = F.when(~anchor & (F.col("event") >= 0.90), F.greatest(z, F.col("_ahead"))).otherwise(z)
    d = d.withColumn("_a", F.greatest(F.lit(0.0), a)).withColumn("_z", z)
    d = d.withColumn("_pad", F.greatest(F.lit(0.0), shortest - (F.col("_z") - F.col("_a"))) / 2)
    d = d.withColumn("expanded_start", F.greatest(F.lit(0.0), F.col("_a") - F.col("_pad"))).withColumn("expanded_end", F.col("_z") + F.col("_pad")).withColumn("_to", F.least("video_duration", "expanded_end"))
    d = I.snap(I.snap(d, shots, KEY, "expanded_start", "start_seconds", "snapped_start"), shots, KEY, "_to", "end_seconds", "snapped_end")
    return d.withColumn("snapped_end", F.when(F.col("snapped_end") <= F.col("snapped_start"), F.col("snapped_start") + 1.0).otherwise(F.col("snapped_end"))).drop("_a", "_z", "_pad", "_ahead", "_to")


def with_core(snapped: DataFrame, shots: DataFrame, gap: float | None) -> DataFrame:
    """Segments: (video_id, segment_id, start_seconds, end_seconds, segment_score, peak_score, story, core, flags).

    gap: snapped ranges within it become one segment; None: each its own. A segment's core shots lie within the snapped and
    the expanded range; its score is .6 of their greatest and .4 of their mean smoothed score.
    """
    d = snapped.withColumn("segment_id", F.col("scene_id")) if gap is None else I.islands(snapped, KEY, "snapped_start", "snapped_end", gap, ["scene_id"], "segment_id")
    flags = [F.max("mandatory").alias("mandatory"), F.max("protected").alias("protected"), F.min("reserve").alias("reserve"), F.max(F.coalesce("late", F.lit(False))).alias("late"), F.max(F.col("role") == "anchor").alias("anchor")]
    whole = d.groupBy("video_id", "segment_id").agg(F.min("snapped_start").alias("start_seconds"), F.max("snapped_end").alias("end_seconds"), F.max("raw_score").alias("peak_score"), F.max("smoothed_score").alias("_peak"), F.max("video_duration").alias("video_duration"), *flags)
    s = shots.select("video_id", F.col("scene_id").alias("_id"), F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"), F.col("smoothed_score").alias("_x"), F.col("story").alias("_story"))
    core = overlap_join(d.select("video_id", "segment_id", "snapped_start", "snapped_end", "expanded_start", "expanded_end"), s, KEY, "snapped_start", "snapped_end", "_s", "_e", 30.0).where("_e > expanded_start and _s < expanded_end")
    core = core.select("video_id", "segment_id", "_id", "_x", "_story").distinct()
    sums = core.groupBy("video_id", "segment_id").agg(F.round(0.6 * F.max("_x") + 0.4 * F.avg("_x"), 4).alias("_score"), F.min(F.when(F.col("_story").isNotNull(), F.struct("_id", "_story"))).alias("_first"), F.count("*").alias("core"))
    out = whole.join(sums, ["video_id", "segment_id"], "left")
    return out.withColumn("segment_score", F.coalesce("_score", F.round("_peak", 4))).withColumn("story", F.col("_first._story")).withColumn("core", F.coalesce("core", F.lit(1))).drop("_score", "_peak", "_first")


def settled(a: float, z: float, said: speech.Said, category: str, late: bool) -> tuple[float, float, bool, bool, int, str]:
    """(start, end, has speech, whole, words, mode) of a segment aligned to what is said.

    Too short a result is aligned once more from a later end. Around speech there are .45 s of room; a cut utterance is
    made whole; edges leave whole turns.
    """
    shortest, _, longest, *_ = CATEGORIES.get(category, CATEGORIES["importance"])
    most = max(longest, z - a) if category == "action" else max(longest, min(50.0, z - a)) if late else longest
    got = speech.align(a, z, said, category, most)
    if got["end"] - got["start"] < shortest:
        got = speech.align(got["start"], min(said.duration, max(z, got["start"] + shortest)), said, category, longest)
    b, y, mode = got["start"], got["end"], got["mode"]
    told, whole, words = speech.window(b, y, said)
    if told:
        b, y = max(0.0, b - PAD), min(said.duration, y + PAD)
        told, whole, words = speech.window(b, y, said)
    if told and not whole:
        c, x = speech.expand_complete(b, y, said, PAD)
        if x > c:
            b, y, mode = c, x, "utterance"
            told, whole, words = speech.window(b, y, said)
    b, y = round(b, 3), round(y, 3)
    c, x = said.safe(b, y)
    if (c, x) != (b, y):
        b, y = c, x
        told, whole, words = speech.window(b, y, said)
    return b, y, told, whole, words, mode


def reserved(a: float, z: float, said: speech.Said, category: str, target: float) -> tuple[float, float, bool, bool, int, str] | None:
    """A reserve's edges, like `settled`; None where it can't be whole, is too short or longer than the target."""
    shortest, _, longest, *_ = CATEGORIES.get(category, CATEGORIES["importance"])
    got = speech.align(a, z, said, category, max(longest, z - a))
    b, y = got["start"], got["end"]
    if speech.window(b, y, said)[0]:
        b, y = speech.expand_complete(b, y, said, PAD)
    told, whole, words = speech.window(b, y, said)
    if y - b < shortest or y - b > target or (told and not whole):
        return None
    b, y = round(b, 3), round(y, 3)
    c, x = said.safe(b, y)
    if (c, x) != (b, y):
        b, y = c, x
        told, whole, words = speech.window(b, y, said)
    return None if y - b > target or (told and not whole) else (b, y, told, whole, words, "utterance" if told else got["mode"])


def act_of(start: float, end: float, duration: float) -> str:
    at = max(0.0, min(1.0, (start + end) / 2 / max(duration, 0.001)))
    return "act_i" if at < 0.25 else "act_ii" if at < 0.75 else "act_iii"


def trimmer(starts: Sequence[float], said: speech.Said, category: str) -> Callable[[int, float], tuple[float, float] | None]:
    """trim(place, room) for greedy_fill: the segment up to the last safe end within the room, with room for the last word's sound."""
    shortest = CATEGORIES.get(category, CATEGORIES["importance"])[0]

    def trim(i: int, room: float) -> tuple[float, float] | None:
        a = starts[i]
        z = speech.budget_end(a, a + room, said, category, shortest)
        if z is None:
            return None
        if speech.window(a, z, said)[0]:
            z = min(said.duration, z + PAD, a + room)
        a, z = said.safe(a, z)
        told, whole, _ = speech.window(a, z, said)
        return (a, z) if whole or not told else None

    return trim


def decide(rows: dict[str, np.ndarray], starts: list[float], ends: list[float], acts: list[str], said: speech.Said, category: str, target: float | None, distribution: str) -> tuple[dict[int, tuple[float, float]], str | None]:
    """place -> edges of the rows that keep the budget, and what prevents a summary; one of four ways to choose.

    All rows without a budget; soft diversity for importance; by acts for importance with acts from 90 s on; else the greedy
    fill. rows: score, story, flags, in the order in which they were found.
    """
    shortest, _, _, _, _, gap = CATEGORIES.get(category, CATEGORIES["importance"])
    n, score = len(starts), rows["segment_score"]
    order = sorted(range(n), key=lambda i: (not rows["protected"][i], -score[i]))
    length = [ends[i] - starts[i] for i in range(n)]
    as_is = {i: (starts[i], ends[i]) for i in range(n)}
    if not bounded(target):
        return as_is, None
    if category == "importance" and distribution == "adaptive":
        story = [("story", s) if s is not None else ("row", i) for i, s in enumerate(rows["story"])]
        middle_ = [(starts[i] + ends[i]) / 2 / max(said.duration, 0.001) for i in order]
        pick = [order[k] for k in S.soft_diversity([score[i] for i in order], [length[i] for i in order], middle_, [story[i] for i in order], target)]
        return {i: as_is[i] for i in pick or sorted(range(n), key=lambda i: -score[i])[:1]}, None
    must = [i for i in range(n) if rows["mandatory"][i]]
    if sum(length[i] for i in must) > target + 1e-6:
        return {}, "mandatory segments exceed the target"
    if category == "importance" and target >= 90.0:
        by = lambda c: [bool(rows[c][i]) for i in order]
        pick = S.balanced_acts([score[i] for i in order], [length[i] for i in order], [acts[i] for i in order], target, by("mandatory"), [x or y for x, y in zip(by("protected"), by("mandatory"))], by("anchor"), by("reserve"))
        return {order[k]: as_is[order[k]] for k in pick}, None
    given = must if category == "importance" else []
    return S.greedy_fill(starts, ends, order, target, gap, shortest, trimmer(starts, said, category), given, 0.10 if category == "importance" else 0.0), None


_STATUS = "segment_id long, kind string, start_seconds double, end_seconds double, segment_score double, peak_score double, has_speech boolean, complete boolean, words int, mode string, mandatory boolean, protected boolean, trimmed boolean, status string, problem string"


def budgeted(found: DataFrame, spare: DataFrame | None, utterances: DataFrame | None, words: DataFrame | None, shots: DataFrame, turns: DataFrame | None, category: str, target: float | None, distribution: str) -> DataFrame:
    """Segments and reserves with status: chosen, left or incomplete (it would cut an utterance). A video's segments, words and
    turns meet in one group."""
    shortest, _, _, _, _, gap = CATEGORIES.get(category, CATEGORIES["importance"])
    speaks = (F.col("speech_ratio") > 0.1) | (F.trim(F.coalesce("transcript_text", F.lit(""))) != "")
    frames = {"found": (found.withColumn("kind", F.lit("found")), ["start_seconds", "segment_id"]), "shots": (shots.select("video_id", "start_seconds", "end_seconds", speaks.alias("speaks")), ["start_seconds", "end_seconds"])}
    if spare is not None:
        frames["spare"] = (spare, ["segment_score", "start_seconds", "segment_id"])
    if words is not None:
        frames["words"] = (words.select("video_id", "start_seconds", "end_seconds"), ["start_seconds", "end_seconds"])
        frames["utterances"] = (utterances.select("video_id", "start_seconds", "end_seconds", "complete", T.continues("text").alias("continues"), T.asks("text").alias("asks")), ["start_seconds", "end_seconds"])
    if turns is not None:
        frames["turns"] = (turns.select("video_id", "start_seconds", "end_seconds"), ["start_seconds", "end_seconds"])

    def run(g: dict) -> list[tuple]:
        def columns(name: str, *more: str) -> list[tuple]:
            own = g.get(name, {})
            return list(zip(*(own[c] for c in ("start_seconds", "end_seconds", *more)))) if own else []

        rows = g["found"]
        said = speech.Said.of(columns("utterances", "complete", "continues", "asks"), columns("words"), columns("shots", "speaks"), columns("turns"), float(rows["video_duration"].max()))
        edges = [settled(float(a), float(z), said, category, bool(late)) for a, z, late in zip(rows["start_seconds"], rows["end_seconds"], rows["late"])]
        fit = [i for i, e in enumerate(edges) if e[3] or not e[2]]
        problem = "a mandatory segment cuts an utterance" if any(rows["mandatory"][i] for i in set(range(len(edges))) - set(fit)) else None
        kept = {c: rows[c][fit] for c in ("segment_id", "segment_score", "peak_score", "story", "mandatory", "protected", "reserve", "anchor")}
        info = [edges[i] for i in fit]
        kinds = ["found"] * len(fit)
        if "spare" in g and len(g["spare"]["segment_id"]):
            more = g["spare"]
            tried = [(i, r) for i in range(len(more["segment_id"]) - 1, -1, -1) if (r := reserved(float(more["start_seconds"][i]), float(more["end_seconds"][i]), said, category, target))]
            story = [more["story"][i] if more["story"][i] is not None else ("row", i) for i, _ in tried]
            add = S.refill([e[:2] for e in info], [r[0] for _, r in tried], [r[1] for _, r in tried], [float(more["segment_score"][i]) for i, _ in tried], story, target, gap, shortest, said.duration)
            at = [tried[k][0] for k in add]
            kept = {c: np.concatenate([kept[c], more[c][at]]) for c in kept}
            info += [tried[k][1] for k in add]
            kinds += ["reserve"] * len(add)
        starts, ends = [e[0] for e in info], [e[1] for e in info]
        acts = [act_of(a, z, said.duration) for a, z in zip(starts, ends)]
        chosen: dict = {}
        if not problem and info:
            chosen, problem = decide(kept, starts, ends, acts, said, category, target, distribution)
        out = []
        for i, (a, z, told, whole, n, mode) in enumerate(info):
            b, y = chosen.get(i, (a, z))
            cut = (b, y) != (a, z)
            if cut:
                told, whole, n = speech.window(b, y, said)
            out.append((int(kept["segment_id"][i]), kinds[i], b, y, float(kept["segment_score"][i]), float(kept["peak_score"][i]), told, whole, n, mode, bool(kept["mandatory"][i]), bool(kept["protected"][i]), cut, "chosen" if i in chosen else "left", problem))
        for i in sorted(set(range(len(edges))) - set(fit)):
            a, z, told, whole, n, mode = edges[i]
            out.append((int(rows["segment_id"][i]), "found", a, z, float(rows["segment_score"][i]), float(rows["peak_score"][i]), told, whole, n, mode, bool(rows["mandatory"][i]), bool(rows["protected"][i]), False, "incomplete", problem))
        return out

    return by_arrays(frames, KEY, run, _STATUS)


def plan(shots: DataFrame, category: str = "importance", target_sec: float | None = 60.0, score: str | None = None, words: DataFrame | None = None, turns: DataFrame | None = None, distribution: str = "adaptive", columns: Mapping[str, str] | None = None) -> DataFrame:
    """All segments that were weighed for each video, with status and problem: what `summarize` is made of.

    shots: video_id, scene_id, start_seconds, end_seconds, the score's column and any of OPTIONAL under its own name or the one
    that `columns` gives. words: video_id, start_seconds, end_seconds, word. turns: whole turns (speech.whole_turns).
    distribution: `adaptive`, or `acts`, for which turning points are mandatory, long gaps get bridges and strong events chains
    (importance alone). A problem says why a video has no summary.
    """
    shortest, _, _, _, _, gap = CATEGORIES.get(category, CATEGORIES["importance"])
    acts = category == "importance" and distribution == "acts"
    d = kept(prepared(shots, score or f"{category}_score", columns))
    if acts:
        told = d.withColumn("_text", F.concat_ws(" ", "transcript_text", "caption")).withColumnRenamed("scene_id", "turn")
        points = P.turning_points(told, "_text", "event").where("status = 'evidence_found'").select("video_id", F.col("turn").alias("scene_id")).distinct().withColumn("required", F.lit(True))
        d = kept(d.join(points, ["video_id", "scene_id"], "left").withColumn("required", F.coalesce("required", F.lit(False))))
    else:
        d = d.withColumn("required", F.lit(False))
    eligible = W.eligible(d, "smoothed_score", required=F.col("required"))
    ids = kept(choose_shots(eligible, category, target_sec, distribution).select("video_id", "scene_id"))
    chosen = d.join(ids.withColumn("role", F.lit("")), ["video_id", "scene_id"]).withColumn("reserve", F.lit(False))
    picked = chosen.withColumn("chain_start", F.lit(None).cast("double")).withColumn("chain_end", F.lit(None).cast("double")).withColumn("late", F.lit(False))
    if acts:
        bridges = conflict_bridges(chosen, d)
        more = d.join(bridges, ["video_id", "scene_id"]).withColumn("role", F.lit("bridge")).withColumn("reserve", F.lit(False))
        both = kept(chosen.unionByName(more))
        chains = event_chains(both, d, target_sec or 0.0).withColumn("_anchor", F.lit("anchor"))
        spared = d.join(act_reserves(both, d), ["video_id", "scene_id"]).withColumn("role", F.lit("")).withColumn("reserve", F.lit(True))
        picked = kept(both.unionByName(spared).join(chains, ["video_id", "scene_id"], "left").withColumn("role", F.coalesce("_anchor", "role")).drop("_anchor", "anchor_value"))
    picked = picked.withColumn("mandatory", F.col("required")).withColumn("protected", F.col("required") | F.col("role").isin("bridge", "anchor"))
    found = with_core(with_edges(picked, d, category), d, gap)
    spare = None
    if category != "importance" and bounded(target_sec):
        rest = eligible.join(ids, ["video_id", "scene_id"], "left_anti").select("*", F.lit("").alias("role"), F.lit(False).alias("reserve"), F.lit(None).cast("double").alias("chain_start"), F.lit(None).cast("double").alias("chain_end"), F.lit(False).alias("late"), F.lit(False).alias("mandatory"), F.lit(False).alias("protected"))
        one = with_core(with_edges(rest, d, category), d, None)
        spare = one.drop("segment_score").join(rest.select("video_id", F.col("scene_id").alias("segment_id"), F.round("smoothed_score", 4).alias("segment_score")), ["video_id", "segment_id"])
    utterances = speech.utterances(words, KEY) if words is not None else None
    return budgeted(found, spare, utterances, words, d, turns, category, target_sec, distribution)


def report(planned: DataFrame) -> DataFrame:
    """(video_id, found, reserves, incomplete, chosen, seconds, problem) of a plan."""
    n = lambda c: F.count(F.when(c, 1))
    chosen = F.col("status") == "chosen"
    return planned.groupBy("video_id").agg(n(F.col("kind") == "found").alias("found"), n(F.col("kind") == "reserve").alias("reserves"), n(F.col("status") == "incomplete").alias("incomplete"), n(chosen).alias("chosen"), F.round(F.coalesce(F.sum(F.when(chosen, F.col("end_seconds") - F.col("start_seconds"))), F.lit(0.0)), 3).alias("seconds"), F.max("problem").alias("problem"))


def summarize(shots: DataFrame, category: str = "action", target_sec: float | None = 60.0, score: str | None = None, turns: DataFrame | None = None, words: DataFrame | None = None, distribution: str = "adaptive", columns: Mapping[str, str] | None = None) -> DataFrame:
    """(video_id, start_seconds, end_seconds, duration, segment_score) of each video's summary, in time order.

    The chosen segments of `plan`, merged where they lie within the category's gap, whole turns and all, and within target_sec
    (None, 0 or 9999 and above: all). A video without a row has a problem in the plan's report, or nothing fits.
    """
    gap = CATEGORIES.get(category, CATEGORIES["importance"])[5]
    chosen = plan(shots, category, target_sec, score, words, turns, distribution, columns).where("status = 'chosen' and problem is null")
    final = I.merge(chosen, KEY, "start_seconds", "end_seconds", gap, ["segment_id"], [F.max("segment_score").alias("segment_score"), F.max("mandatory").alias("mandatory")]).drop("n")
    if turns is not None:
        ends = shots.groupBy(*KEY).agg(F.max("end_seconds").cast("double").alias("video_duration"))
        final = speech_safe(final.join(ends, KEY), turns, target_sec)
    return final.select("video_id", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), F.round(F.col("end_seconds") - F.col("start_seconds"), 3).alias("duration"), "segment_score")
