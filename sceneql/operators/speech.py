"""Speech: utterances, whole turns, windows on words, alignment of segments to what is said, and speakers of words."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.functions import vocabularies as L
from sceneql.operators.groups import by_arrays
from sceneql.operators.intervals import outside_turns

SILENCE, EPSILON, ANSWER, CONTINUATION, LEADING = 2.75, 0.02, 5.0, 12.0, 6.0
#: How far an edge may move to reach an utterance's edge, and whether sentences are preferred, by category.
POLICY = {"action": (0.6, False), "dialogue": (3.0, True), "importance": (8.0, True), "custom": (1.5, True)}


def utterances(words: DataFrame, keys: Sequence[str], dangling: Sequence[str] = L.DANGLING) -> DataFrame:
    """Words up to a sentence end, a silence of 2.75 s or the last word: (keys, start, end, n, text, closed_by, complete)."""
    w = Window.partitionBy(*keys).orderBy("start_seconds", "end_seconds", "word")
    final = T.ends_sentence("word")
    gap = F.col("start_seconds") - F.lag("end_seconds").over(w)
    new = F.lag(final).over(w).isNull() | F.lag(final).over(w) | (gap >= SILENCE)
    d = words.withColumn("_u", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_next", F.lead("start_seconds").over(w) - F.col("end_seconds"))
    g = d.groupBy(*keys, "_u").agg(
        F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_seconds", "end_seconds", "word"))), lambda x: x["word"]), " ").alias("text"), F.max_by("_next", F.struct("start_seconds", "end_seconds")).alias("_after"),
    )
    closed = F.when(T.ends_sentence("text"), "sentence").when(F.col("_after") >= SILENCE, "silence").otherwise("end")
    return g.withColumn("closed_by", closed).withColumn("complete", T.complete("text", dangling)).drop("_u", "_after")


def whole_turns(turns: DataFrame, keys: Sequence[str], longest: float = 90.0, gap: float = 0.8, most: float = 45.0) -> DataFrame:
    """(keys, start_seconds, end_seconds): turns that aren't blank or over-long, an unfinished one joined to the next within
    .8 s while both span at most 45 s. A fold, as the span counts from the joined turn's start."""
    t = turns.where((F.trim("text") != "") & (F.col("end_seconds") - F.col("start_seconds") <= longest)).select(*keys, "start_seconds", "end_seconds", T.ends_sentence("text").alias("final")).dropDuplicates()
    g = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_seconds", "end_seconds", "final"))).alias("ts"))
    kind = "array<struct<start_seconds:double,end_seconds:double,final:boolean>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        between = x["start_seconds"] - last["end_seconds"]
        joins = (F.size(acc) > 0) & ~last["final"] & (between >= 0) & (between <= gap) & (x["end_seconds"] - last["start_seconds"] <= most)
        both = F.struct(last["start_seconds"].alias("start_seconds"), F.greatest(last["end_seconds"], x["end_seconds"]).alias("end_seconds"), x["final"].alias("final"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    folded = F.aggregate("ts", F.array().cast(kind), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)).cast(kind))
    return g.select(*keys, F.explode(folded).alias("t")).select(*keys, "t.start_seconds", "t.end_seconds")


def describe(windows: DataFrame, words: DataFrame, keys: Sequence[str], row: str, width: float = 30.0) -> DataFrame:
    """(keys, row, has_speech, word_count, text) of the words that a window overlaps."""
    from sceneql.operators.joins import overlap_join

    w = words.select(*keys, F.col("start_seconds").alias("_ws"), F.col("end_seconds").alias("_we"), "word")
    hits = overlap_join(windows.select(*keys, row, "start_seconds", "end_seconds"), w, keys, "start_seconds", "end_seconds", "_ws", "_we", width)
    g = hits.groupBy(*keys, row).agg(F.count("*").alias("word_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ws", "_we", "word"))), lambda x: x["word"]), " ").alias("text"))
    d = windows.select(*keys, row).join(g, [*keys, row], "left")
    return d.select(*keys, row, F.coalesce(F.col("word_count") > 0, F.lit(False)).alias("has_speech"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("text", F.lit("")).alias("text"))


_NONE = np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Said:
    """What a video has to keep whole, as arrays in time order: utterances, words, shots with or without speech, whole turns."""

    starts: np.ndarray
    ends: np.ndarray
    complete: np.ndarray
    continues: np.ndarray
    asks: np.ndarray
    word_starts: np.ndarray
    word_ends: np.ndarray
    shot_starts: np.ndarray
    shot_ends: np.ndarray
    speaks: np.ndarray
    turns: np.ndarray
    duration: float

    @classmethod
    def of(cls, utterances: Sequence[tuple] = (), words: Sequence[tuple] = (), shots: Sequence[tuple] = (), turns: Sequence[tuple] = (), duration: float = math.inf) -> Said:
        """utterances: (start, end, complete, continues, asks); words and turns: (start, end); shots: (start, end, speaks)."""
        u, w, s, t = (np.array(list(x), dtype=float).reshape(-1, n) for x, n in ((utterances, 5), (words, 2), (shots, 3), (turns, 2)))
        return cls(u[:, 0], u[:, 1], u[:, 2] > 0, u[:, 3] > 0, u[:, 4] > 0, w[:, 0], w[:, 1], s[:, 0], s[:, 1], s[:, 2] > 0, t, duration)

    def within(self, a: float, z: float) -> np.ndarray:
        return ((self.ends > a) & (self.starts < z)).nonzero()[0] if len(self.starts) else _NONE

    def words_within(self, a: float, z: float) -> int:
        return int(np.count_nonzero((self.word_ends > a) & (self.word_starts < z))) if len(self.word_starts) else 0

    def after(self, k: int, gap: float) -> int | None:
        """The utterance that follows utterance k within the gap."""
        return k + 1 if k + 1 < len(self.starts) and 0.0 <= self.starts[k + 1] - self.ends[k] <= gap else None

    def cut_word(self, at: float) -> int | None:
        """The first word that `at` lies strictly inside."""
        if not len(self.word_starts):
            return None
        hit = ((self.word_starts + EPSILON < at) & (at < self.word_ends - EPSILON)).nonzero()[0]
        return int(hit[0]) if len(hit) else None

    def safe(self, a: float, z: float) -> tuple[float, float]:
        """The edges outside whole turns, by .22 s."""
        if not len(self.turns):
            return a, z
        starts, ends, reach = self._sorted_turns
        a, z = max(a, 0.0), min(z, self.duration)
        # as intervals.outside_turns moves an edge
        while (k := bisect_right(reach, a)) < len(reach) and starts[k] < a:
            to = max(0.0, starts[k] - 0.22)
            if abs(to - a) < 1e-6:
                break
            a = to
        while (k := bisect_right(reach, z)) < len(reach) and starts[k] < z:
            to = min(self.duration, ends[k] + 0.22)
            if abs(to - z) < 1e-6:
                break
            z = to
        return float(np.round(a, 3)), float(np.round(z, 3))

    @cached_property
    def _sorted_turns(self) -> tuple[list[float], list[float], list[float]]:
        """Starts, ends and the running last end of the turns in order."""
        t = self.turns[np.lexsort((self.turns[:, 1], self.turns[:, 0]))]
        return t[:, 0].tolist(), t[:, 1].tolist(), np.maximum.accumulate(t[:, 1]).tolist()


def window(a: float, z: float, said: Said) -> tuple[bool, bool, int]:
    """(has speech, whole utterances only, words) of a stretch of time.

    An utterance is whole if it lies within and is finished, or what follows it within 12 s lies within, too. Where no word
    overlaps, shots with speech tell whether there is any, and nothing is cut.
    """
    words = said.words_within(a, z)
    if not words:
        return bool(((said.shot_ends > a) & (said.shot_starts < z) & said.speaks).any()), True, 0
    for k in said.within(a, z):
        n = said.after(k, CONTINUATION)
        finished = said.complete[k] or (n is not None and z >= said.ends[n] - EPSILON)
        if a > said.starts[k] + EPSILON or z < said.ends[k] - EPSILON or not finished:
            return True, False, words
    return True, True, words


def expand_complete(a: float, z: float, said: Said, pad: float = 0.45) -> tuple[float, float]:
    """Edges moved out to whole utterances until nothing changes, an unfinished one followed by the next within 12 s; the
    pad only where it touches no utterance."""
    a, z = max(0.0, a), min(said.duration, z)
    while True:
        b, y = a, z
        for k in said.within(a, z):
            a, z = min(a, said.starts[k]), max(z, said.ends[k])
            n = None if said.complete[k] else said.after(k, CONTINUATION)
            z = z if n is None else max(z, said.ends[n])
        if (a, z) == (b, y):
            break
    b, y = max(0.0, a - pad), min(said.duration, z + pad)
    a, z = a if len(said.within(b, a)) else b, z if len(said.within(z, y)) else y
    return round(float(a), 3), round(float(z), 3)


def _by_shots(a: float, z: float, said: Said, reach: float, sentences: bool, longest: float) -> tuple[float, float, str, list[str]]:
    """Alignment of a video without words: to its shots with speech."""
    hit = np.flatnonzero((said.shot_ends > a) & (said.shot_starts < z) & said.speaks)
    start, end, why = a, z, []
    if sentences and len(hit):
        first, last = float(said.shot_starts[hit[0]]), float(said.shot_ends[hit[-1]])
        if z - a > longest and last - first <= longest:
            start, end = first, last
            why.append("speech_window")
        else:
            start = first if 0.0 < a - first <= reach else start
            end = last if 0.0 < last - z <= reach else end
        why.append("no_words")
    if end - start > longest:
        end = start + longest
        why.append("cut_to_longest")
    return start, end, "fallback" if "no_words" in why else "shot", why


def _last_end(said: Said, start: float, least: float, most: float, sentences: bool) -> tuple[float, str] | None:
    """The last end within [least, most] of a finished utterance, if sentences are kept, or else of a word."""
    for ends, mode in ((said.ends[said.complete], "sentence"),) * sentences + ((said.word_ends, "word"),):
        fit = ends[(ends >= least) & (ends <= most + EPSILON) & (ends > start)]
        if len(fit):
            return float(fit.max()), mode
    return None


def align(a: float, z: float, said: Said, category: str, longest: float) -> dict:
    """A segment's edges moved to what is said: start, end, mode and the reasons in order.

    Where sentences are kept: an unfinished neighbour joins, edges move to utterances within the category's reach, a question
    takes its answer or loses the silence behind it, and a thought that fits the longest segment is kept whole. Then no
    word is cut within reach, and what is too long ends with the last utterance or word that fits.
    """
    reach, sentences = POLICY.get(category, POLICY["importance"])
    a = max(0.0, a)
    z = max(a, z)
    if not len(said.word_starts):
        start, end, mode, why = _by_shots(a, z, said, reach, sentences, longest)
        return {"start": start, "end": end, "mode": mode, "reasons": ",".join(why)}
    start, end, mode, why = a, z, "shot", []
    inside = said.within(a, z)
    if sentences and len(inside):
        first, last = int(inside[0]), int(inside[-1])
        if first > 0 and (not said.complete[first - 1] or said.continues[first]) and said.after(first - 1, LEADING) == first and said.ends[last] - said.starts[first - 1] <= longest:
            first -= 1
            why.append("leading_context")
        n = None if said.complete[last] else said.after(last, CONTINUATION)
        if n is not None and said.ends[n] - said.starts[first] <= longest:
            last = n
            why.append("continuation")
        if EPSILON < a - said.starts[first] <= reach:
            start, mode = float(said.starts[first]), "sentence"
            why.append("start_expanded")
        if EPSILON < said.ends[last] - z <= reach:
            end, mode = float(said.ends[last]), "sentence"
            why.append("end_expanded")
        if said.asks[last]:
            n = said.after(last, ANSWER)
            if n is not None and said.ends[n] - start <= longest:
                end, mode = max(end, float(said.ends[n])), "exchange"
                why.append("answer")
            elif z > said.ends[last] + EPSILON:
                end, mode = float(said.ends[last]), "sentence"
                why.append("tail_trimmed")
        if said.ends[last] - said.starts[first] <= longest:
            if start > said.starts[first] + EPSILON:
                start, mode = float(said.starts[first]), "sentence"
                why.append("whole_start")
            if end < said.ends[last] - EPSILON:
                end, mode = float(said.ends[last]), "sentence"
                why.append("whole_end")
    w = said.cut_word(start)
    if w is not None and start - said.word_starts[w] <= reach:
        start, mode = float(said.word_starts[w]), mode if mode != "shot" else "word"
        why.append("word_start")
    w = said.cut_word(end)
    if w is not None and said.word_ends[w] - end <= reach:
        end, mode = float(said.word_ends[w]), mode if mode != "shot" else "word"
        why.append("word_end")
    if end - start > longest:
        end, mode = _last_end(said, start, start + 0.25, start + longest, sentences) or (start + longest, "fallback")
        why.append("cut_to_longest")
    if end <= start:
        start, end, mode = a, z, "fallback"
        why.append("reverted")
    return {"start": start, "end": end, "mode": mode, "reasons": ",".join(why)}


def budget_end(start: float, most: float, said: Said, category: str, shortest: float) -> float | None:
    """The last end up to `most`, `shortest` after the start at least, that cuts nothing: of a finished utterance where words
    are said, else of a shot that ends in no word, else of a word. None where there is none."""
    least = start + shortest
    if most < least:
        return None
    if said.words_within(start, most):
        k = said.within(start, most)
        fit = said.ends[k][said.complete[k] & (said.ends[k] >= least) & (said.ends[k] <= most + EPSILON)]
        return float(fit.max()) if len(fit) else None
    for end in sorted({float(e) for e in said.shot_ends if least <= e <= most + EPSILON}, reverse=True):
        if said.cut_word(end) is None:
            return end
    found = _last_end(said, start, least, most, POLICY.get(category, POLICY["importance"])[1])
    return found[0] if found else None


def viterbi(words: list[dict], turns: list[dict], switch: float = 0.35) -> list[str]:
    """The likeliest speaker of each word: its share of overlap with a speaker's turns (nearest: .1 if none), less the price
    of a change. A word's `forced` speaker is certain. Turns are found by their times, so a word costs those near it."""
    names = sorted({t["who"] for t in turns} | {w["forced"] for w in words if w.get("forced")})
    if not names:
        return [""] * len(words)
    number = {n: k for k, n in enumerate(names)}
    ordered = sorted(turns, key=lambda t: t["s"])
    start, end = np.array([t["s"] for t in ordered]), np.array([t["e"] for t in ordered])
    who = np.array([number[t["who"]] for t in ordered], dtype=int)
    far = np.maximum.accumulate(end) if len(end) else end
    score, back = np.zeros(len(names)), np.zeros((len(words), len(names)), dtype=int)
    for i, w in enumerate(words):
        say, length = np.zeros(len(names)), max(0.01, w["e"] - w["s"])
        lo, hi = np.searchsorted(far, w["s"], "right"), np.searchsorted(start, w["e"], "left")
        if lo < hi:
            np.add.at(say, who[lo:hi], np.maximum(0.0, np.minimum(w["e"], end[lo:hi]) - np.maximum(w["s"], start[lo:hi])) / length)
        if len(ordered) and not say.any():
            mid = (w["s"] + w["e"]) / 2
            away = np.maximum(np.maximum(start - mid, mid - end), 0.0)
            say[who[int(np.argmin(away))]] = 0.1
        if w.get("forced"):
            say = np.where(np.arange(len(names)) == number[w["forced"]], 1e6, -1e6)
        best = int(np.argmax(score))
        stays = score >= score[best] - switch
        back[i] = np.where(stays, np.arange(len(names)), best)
        score = np.where(stays, score, score[best] - switch) + say
    at, out = int(np.argmax(score)), []
    for i in range(len(words) - 1, -1, -1):
        out.append(names[at])
        at = int(back[i, at])
    return out[::-1]


def word_speakers(words: DataFrame, turns: DataFrame, switch: float = 0.35) -> DataFrame:
    """(video_id, start_seconds, speaker) of each word by `viterbi`. A video's words and turns meet once, as arrays.

    words: video_id, start_seconds, end_seconds; turns: video_id, start_seconds, end_seconds, speaker.
    """
    frames = {"words": (words.select("video_id", "start_seconds", "end_seconds"), ["start_seconds", "end_seconds"]), "turns": (turns.select("video_id", "start_seconds", "end_seconds", "speaker"), ["start_seconds", "end_seconds", "speaker"])}

    def path(g: dict) -> list[tuple]:
        t = g["turns"]
        told = [{"s": a, "e": z, "who": n} for a, z, n in zip(t["start_seconds"].tolist(), t["end_seconds"].tolist(), t["speaker"].tolist())]
        said = [{"s": a, "e": z} for a, z in zip(g["words"]["start_seconds"].tolist(), g["words"]["end_seconds"].tolist())]
        return [(w["s"], n) for w, n in zip(said, viterbi(said, told, switch))]

    return by_arrays(frames, ["video_id"], path, "start_seconds double, speaker string")


def safe_end(said: DataFrame, shots: DataFrame, words: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """(keys, end, mode): the last end up to the target of a complete utterance, else of a shot that ends in no word, else of a
    word, else the target."""
    from sceneql.operators.joins import point_join

    most = target + EPSILON
    a = said.where(F.col("complete") & (F.col("end_seconds") <= most)).groupBy(*keys).agg(F.max("end_seconds").alias("_u"))
    ends = shots.where(F.col("end_seconds") <= most).select(*keys, F.col("end_seconds").alias("_at")).distinct()
    inner = words.select(*keys, (F.col("start_seconds") + EPSILON).alias("_ws"), (F.col("end_seconds") - EPSILON).alias("_we")).where("_we > _ws")
    cut = point_join(ends, inner, keys, "_at", "_ws", "_we", 30.0).where("_at > _ws").select(*keys, "_at").distinct()
    b = ends.join(cut, [*keys, "_at"], "left_anti").groupBy(*keys).agg(F.max("_at").alias("_s"))
    c = words.where(F.col("end_seconds") <= most).groupBy(*keys).agg(F.max("end_seconds").alias("_w"))
    every = said.select(*keys).unionByName(shots.select(*keys)).distinct()
    d = every.join(a, list(keys), "left").join(b, list(keys), "left").join(c, list(keys), "left")
    mode = F.when(F.col("_u").isNotNull(), "sentence").when(F.col("_s").isNotNull(), "shot").when(F.col("_w").isNotNull(), "word").otherwise("target")
    return d.select(*keys, F.coalesce("_u", "_s", "_w", F.lit(target)).alias("end"), mode.alias("mode"))


def verified_edges(segments: DataFrame, words: DataFrame, keys: Sequence[str], row: str, duration: str, pad: float = 0.30, most: float = 1.5, slop: float = 0.05) -> DataFrame:
    """segments with edges moved out of words that straddle them by more than .05 s, .3 s beyond the word, 1.5 s at most.

    An end goes no further than the next segment's start and the video's end, a start no further than the end before it, as
    moved. An end depends on its own segment and the next one's start alone, so all ends move at once, then all starts.
    words: keys, start_seconds, end_seconds.
    """
    from sceneql.operators.joins import point_join

    w = Window.partitionBy(*keys).orderBy("start_seconds", "end_seconds", row)

    def straddling(at: Column, out: Column) -> DataFrame:
        points = segments.select(*keys, row, at.alias("_at"))
        return point_join(points, words.select(*keys, F.col("start_seconds").alias("_ws"), F.col("end_seconds").alias("_we")), keys, "_at", "_ws", "_we", 30.0).where("_at > _ws").groupBy(*keys, row).agg(out)

    d = segments.join(straddling(F.col("end_seconds") + slop, F.max("_we").alias("_far")), [*keys, row], "left")
    limit = F.least(F.lead("start_seconds").over(w), F.col(duration), F.col("end_seconds") + most)
    moved = F.least(F.col("_far") + pad, limit)
    d = d.withColumn("_end", F.when(moved > F.col("end_seconds") + slop, F.round(moved, 3)).otherwise(F.col("end_seconds")))
    d = d.join(straddling(F.col("start_seconds") - slop, F.min("_ws").alias("_near")), [*keys, row], "left")
    back = F.greatest(F.col("_near") - pad, F.coalesce(F.lag("_end").over(w), F.lit(0.0)), F.col("start_seconds") - most, F.lit(0.0))
    start = F.when(F.col("_near").isNotNull() & (back < F.col("start_seconds") - slop), F.round(back, 3)).otherwise(F.col("start_seconds"))
    return d.withColumn("_start", start).select(*[c for c in segments.columns if c not in ("start_seconds", "end_seconds")], F.col("_start").alias("start_seconds"), F.col("_end").alias("end_seconds"))


def repair(segments: DataFrame, chunks: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Good rows, and new rows whose midpoint lies in a bad one, numbered by time. chunks: keys, start_seconds, end_seconds, text."""
    from sceneql.operators.joins import point_join

    wrong = segments.where(bad).select(*keys, F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"))
    new = point_join(chunks.withColumn("_mid", (F.col("start_seconds") + F.col("end_seconds")) / 2), wrong, keys, "_mid", "_s", "_e", 60.0).select(*keys, "start_seconds", "end_seconds", "text", F.lit(True).alias("repaired"))
    kept = segments.where(~bad).select(*keys, "start_seconds", "end_seconds", "text", F.lit(False).alias("repaired"))
    return kept.unionByName(new).withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("start_seconds", "end_seconds", "text")))
