"""Golden cases of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneql.functions import text as T
from sceneql.functions import vectors as V
from sceneql.operators import clusters as C
from sceneql.operators import evaluate as E
from sceneql.operators import intervals as I
from sceneql.operators import joins as J
from sceneql.operators import segments as G
from sceneql.operators import selection as S
from sceneql.operators import speech as P
from sceneql.operators import summary as M
from sceneql.operators import topk as K
from sceneql.operators import windows as W


def test_smoothing(spark):
    d = spark.createDataFrame([(0, i + 1, s) for i, s in enumerate((0.2, 0.3, 0.9, 0.7, 0.2))], "video_id int, scene_id int, action_score double")
    got = {r.scene_id: r.x for r in W.smooth(d, "action_score", "x").collect()}
    assert got[3] == 0.74 and got[1] == round(0.8 * 0.2 + 0.2 * 0.3, 4)


def test_stable_percentile_of_ties_and_single_rows(spark):
    d = spark.createDataFrame([(0, 1, 5.0), (0, 2, 5.0), (0, 3, 1.0), (1, 1, 2.0)], "video_id int, scene_id int, v double")
    got = {(r.video_id, r.scene_id): r.p for r in W.stable_percentile(d, "v", "p").collect()}
    assert got == {(0, 3): 0.0, (0, 1): 0.5, (0, 2): 1.0, (1, 1): 0.0}


def test_merge_equals_a_sequential_merge(spark):
    rng = random.Random(1)
    rows = [(v, float(a), float(a + rng.randint(0, 5))) for v in range(3) for a in (rng.randint(0, 300) for _ in range(80))]
    got = {(r.video_id, r.s, r.e, r.n) for r in I.merge(spark.createDataFrame(rows, "video_id int, s double, e double"), ["video_id"], "s", "e", 1.0).collect()}
    want = set()
    for v in range(3):
        run = None
        for a, z in sorted((a, z) for w, a, z in rows if w == v):
            if run and a - run[1] <= 1.0:
                run = [run[0], max(run[1], z), run[2] + 1]
            else:
                if run:
                    want.add((v, *run))
                run = [a, z, 1]
        want.add((v, *run))
    assert got == want


def test_overlap_join_equals_a_theta_join(spark):
    rng = random.Random(2)
    mk = lambda: [(v, i, float(a), float(a + rng.choice([0, 1, 2, 40]))) for v in range(2) for i, a in enumerate(rng.randint(0, 200) for _ in range(60))]
    a, b = mk(), mk()
    got = J.overlap_join(spark.createDataFrame(a, "v int, i int, s double, e double"), spark.createDataFrame(b, "v int, j int, x double, y double"), ["v"], "s", "e", "x", "y", 10.0).select("v", "i", "j").collect()
    want = sorted((v, i, j) for v, i, s, e in a for w, j, x, y in b if v == w and min(e, y) - max(s, x) > 0)
    assert sorted(map(tuple, got)) == want


def test_outside_keeps_the_gap(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 2.0), (0, 2, 4.0, 5.0), (0, 3, 20.0, 21.0)], "v int, i int, s double, e double")
    b = spark.createDataFrame([(0, 7.0, 8.0)], "v int, x double, y double")
    assert sorted(r.i for r in J.outside(a, b, ["v"], "s", "e", "x", "y", 2.5, 5.0).collect()) == [1, 3]


def test_group_while_has_both_caps(spark):
    rows = [(0, i, 5.0 * i, 5.0 * i + 5) for i in range(30)]
    d = I.group_while(spark.createDataFrame(rows, "v int, i int, s double, e double"), ["v"], ["i"], "s", "e", F.lit(True), 45.0, 12)
    sizes = [r.n for r in d.groupBy("group_id").agg(F.count("*").alias("n"), F.min("i").alias("i")).orderBy("i").collect()]
    assert sizes == [9, 9, 9, 3]


def test_overlap_regions(spark):
    d = spark.createDataFrame([(0, "A", 0.0, 2.0), (0, "B", 1.0, 3.0)], "v int, who string, s double, e double")
    assert [tuple(r) for r in I.overlap_regions(d, ["v"], "s", "e", "who").collect()] == [(0, 1.0, 2.0, "A|B")]


def test_safe_bounds_leave_no_edge_in_a_turn(spark):
    t = spark.createDataFrame([(0, 1.0, 4.0), (0, 11.5, 13.5)], "v int, ts double, te double")
    d = spark.createDataFrame([(0, 2.0, 3.5), (0, 12.0, 13.0)], "v int, s double, e double")
    got = sorted((r.s, r.e) for r in I.safe_bounds(d, t, ["v"], "s", "e", "ts", "te").collect())
    assert got == [(0.78, 4.22), (11.28, 13.72)]


def brute(values, costs, capacity):
    return max(sum(values[i] for i in s) for n in range(len(values) + 1) for s in itertools.combinations(range(len(values)), n) if sum(costs[i] for i in s) <= capacity)


def test_knapsack_is_best():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        v, c, cap = [rng.random() for _ in range(n)], [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 25)
        pick = S.knapsack(v, c, cap, more_items=rng.random() < 0.5)
        assert sum(c[i] for i in pick) <= cap and math.isclose(sum(v[i] for i in pick), brute(v, c, cap))


def test_knapsack_fixture():
    pick = S.knapsack([0.90, 0.62, 0.61], [12, 8, 8], 16, more_items=True)
    assert pick == [1, 2]


def test_fullest_fills_before_it_scores():
    pick = S.fullest([0.6, 0.67, 0.75], [161, 73, 116], 300)
    assert pick == [0, 2]


def test_soft_diversity_fixture():
    got = S.soft_diversity([100, 98, 96, 80, 78, 76], [2.0] * 6, [0.0, 0.01, 0.02, 0.3, 0.6, 0.9], [1, 1, 1, 2, 3, 4], 6.0)
    assert got == [0, 3, 4]
    with pytest.raises(ValueError):
        S.soft_diversity([1.0], [20.0], [0.0], [1], 4.0, [True])


def test_mmr_prefers_another_story():
    got = S.mmr([0.9, 0.89, 0.5], [[1, 0], [1, 0], [0, 1]], [1, 1, 2], 2, 0.5)
    assert [i for i, _, _ in got] == [0, 2]


def test_guard_fixture():
    rows = [{"start": 2.0, "end": 3.5, "score": 0.9, "speech": True}, {"start": 12.0, "end": 13.0, "score": 0.2, "speech": True}]
    got = S.guard(rows, [(1.0, 4.0), (11.5, 13.5)], 4.0)
    assert [(r["start"], r["end"]) for r in got] == [(0.78, 4.22)]
    assert S.guard(rows[:1], [(1.0, 4.0)], 1.0) == []


def test_utterances_close_on_sentences_and_silences(spark):
    w = spark.createDataFrame([(0, 0.0, 0.4, "a"), (0, 3.3, 3.7, "b."), (0, 3.9, 4.2, "c")], "video_id int, start_seconds double, end_seconds double, word string")
    got = sorted((r.start_seconds, r.end_seconds, r.closed_by) for r in P.utterances(w, ["video_id"]).collect())
    assert got == [(0.0, 0.4, "silence"), (3.3, 3.7, "sentence"), (3.9, 4.2, "end")]


def test_whole_turns_fixture(spark):
    t = spark.createDataFrame([(0, 1.0, 2.0, "Bu konuşma"), (0, 2.3, 3.0, "devam ediyor."), (0, 5.0, 6.0, "Yeni cümle.")], "video_id int, start_seconds double, end_seconds double, text string")
    assert sorted((r.start_seconds, r.end_seconds) for r in P.whole_turns(t, ["video_id"]).collect()) == [(1.0, 3.0), (5.0, 6.0)]


def test_alignment_rules():
    said = [(1.0, 2.0, True, False, False), (4.0, 6.0, True, False, True), (7.0, 8.0, True, False, False)]
    words = [(a, z) for a, z, *_ in said]
    got = P.align(1.2, 1.8, P.Said.of(said[:1], words[:1]), "dialogue", 18.0)
    assert (got["start"], got["end"], got["mode"]) == (1.0, 2.0, "sentence")
    got = P.align(4.1, 5.9, P.Said.of(said, words), "dialogue", 18.0)
    assert got["end"] == 8.0 and got["mode"] == "exchange"
    assert P.align(0.0, 100.0, P.Said.of(), "action", 12.0)["end"] == 12.0


def test_viterbi_fixture():
    turns = [{"s": 0.0, "e": 1.05, "who": "OLD"}, {"s": 1.05, "e": 2.1, "who": "NEW"}]
    words = [{"s": 0.8, "e": 1.2}, {"s": 1.2, "e": 1.6}, {"s": 1.6, "e": 2.0}]
    assert P.viterbi(words, turns)[1:] == ["NEW", "NEW"]
    assert P.viterbi([{"s": 0.0, "e": 0.5, "forced": "NEW"}], turns) == ["NEW"]
    assert P.viterbi([], []) == []


def test_text_functions(spark):
    d = spark.createDataFrame([("Önce  şunu, de ?",)], "s string").select(T.tokens("s").alias("t"), T.bigrams(T.tokens("s")).alias("b"), T.asks("s").alias("q"), T.join_words(F.split("s", " ")).alias("j"), T.seconds_of(F.lit("1:02:03")).alias("c"), T.slug(F.lit("A b-C!")).alias("g")).first()
    assert d.t == ["önce", "şunu", "de"] and d.b == ["önce::şunu", "şunu::de"] and d.q and d.j.endswith("de?") and d.c == 3723 and d.g == "a_b_c_"


def test_vector_edges(spark):
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(V.norm("a").alias("n"), V.cosine("a", "z").alias("c"), V.normalise("z").alias("u"), V.cosine("a", "a").alias("s")).first()
    assert (d.n, d.c, d.u, round(d.s, 12)) == (5.0, 0.0, [0.0, 0.0], 1.0)


def test_clusters():
    x = [[1, 0], [0.99, 0.05], [0, 1], [0.02, 1]]
    assert C.agglomerate(x, 0.42) == [0, 0, 1, 1]
    assert C.merge_clusters(x, [0, 1, 2, 2], [(0, 0), (0, 1), (0, 2), (0, 3)]) == [0, 0, 1, 1]
    assert C.merge_clusters(x, [0, 1, 2, 2], [(0, 0), (0, 0), (0, 2), (0, 3)]) == [0, 1, 2, 2]
    rng = np.random.default_rng(0)
    two = np.concatenate([[1, 0, 0] + rng.normal(0, 0.05, (12, 3)), [0, 1, 0] + rng.normal(0, 0.05, (12, 3))])
    got = C.voices(two)
    assert len(set(got[:12])) == 1 and len(set(got)) == 2
    assert C.merge_speakers(x, ["A", "B", "C", "C"], [1] * 4, set()) == ["A", "A", "C", "C"]
    assert C.merge_speakers(x, ["A", "B", "C", "C"], [1] * 4, {("A", "B")}) == ["A", "B", "C", "C"]


def plain_merge(x, labels, frames):
    """All pairs of clusters compared anew in each round."""
    x = C.unit(x)
    groups = {}
    for i, c in enumerate(labels):
        groups.setdefault(c, []).append(i)
    while True:
        found = []
        for a, b in itertools.combinations(sorted(groups), 2):
            m, n = groups[a], groups[b]
            if {frames[i] for i in m} & {frames[i] for i in n}:
                continue
            centre = 1 - float(C.unit(x[m].mean(axis=0)) @ C.unit(x[n].mean(axis=0)))
            pair = min(1 - float(x[i] @ x[j]) for i in m for j in n)
            limits = ((0.38, 0.27), (0.42, 0.22)) if {frames[i][0] for i in m} & {frames[i][0] for i in n} else ((0.46, 0.40), (0.50, 0.32))
            if any(centre <= c and pair <= p for c, p in limits):
                found.append((0.7 * centre + 0.3 * pair, a, b))
        if not found:
            break
        _, a, b = min(found)
        groups[a] += groups.pop(b)
    out = {i: k for k, c in enumerate(sorted(groups)) for i in groups[c]}
    return [out[i] for i in range(len(labels))]


@pytest.mark.parametrize("seed", range(30))
def test_cluster_merge_equals_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 40))
    x = rng.normal(0, 1, (4, 6))[rng.integers(0, 4, n)] + rng.normal(0, 0.5, (n, 6))
    labels = np.unique(rng.integers(0, 12, n), return_inverse=True)[1].tolist()
    frames = [(int(s), int(f)) for s, f in zip(rng.integers(0, 5, n), rng.integers(0, 60, n))]
    assert C.merge_clusters(x, labels, frames) == plain_merge(x, labels, frames)


def test_a_turn_between_two_near_voices_is_corrected():
    """The margin counts against the assigned speaker, not the runner-up."""
    a, b, c = [1, 0, 0], [0.97, 0.24, 0], [0, 0, 1]
    got = C.reassign([a, a, b, b, c, c, [0.99, 0.1, 0.05]], ["A", "A", "B", "B", "C", "C", "C"], [5, 5, 5, 5, 5, 5, 0.1], [set()] * 7)
    assert got[6] in ("A", "B") and got[:6] == ["A", "A", "B", "B", "C", "C"]
    assert C.reassign([a, a, c, c, [0.99, 0.1, 0.05]], ["A", "A", "C", "C", "C"], [5, 5, 5, 5, 0.1], [set()] * 4 + [{"A"}])[4] == "C"


def test_short_interruptions_need_time_and_voice():
    x = [[1, 0], [0, 1], [1, 0.1]]
    assert C.smooth_interruptions(x, ["A", "B", "A"], [0, 1.0, 1.2], [1, 1.2, 3]) == ["A", "A", "A"]
    assert C.smooth_interruptions(x, ["A", "B", "A"], [0, 1.0, 1.4], [1, 1.4, 3]) == ["A", "B", "A"]
    assert C.smooth_interruptions(x, ["A", "B", "A"], [0, 1.1, 1.3], [1, 1.3, 3]) == ["A", "B", "A"]
    assert C.smooth_interruptions([[1, 0], [0, 1], [0, 1]], ["A", "B", "A"], [0, 1.0, 1.2], [1, 1.2, 3]) == ["A", "B", "A"]


@pytest.mark.parametrize("seed", range(20))
def test_outside_turns_equals_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 40))
    begin = np.round(rng.uniform(0, 60, n), 2)
    turns = np.stack([begin, np.round(begin + rng.uniform(0.1, 6, n), 2)], axis=1)
    start = np.round(rng.uniform(-2, 60, 25), 2)
    end = start + np.round(rng.uniform(0, 20, 25), 2)
    got = I.outside_turns(start, end, turns, 0.22, 63.0)
    ordered = sorted(map(tuple, turns.tolist()))
    for k in range(25):
        a, z = max(0.0, start[k]), min(63.0, end[k])
        for _ in range(n + 1):
            for s, e in ordered:
                a = max(0.0, s - 0.22) if s < a < e else a
                z = min(63.0, e + 0.22) if s < z < e else z
        assert abs(got[0][k] - a) < 1e-3 and abs(got[1][k] - z) < 1e-3


def plain_diversity(values, costs, windows, groups, capacity):
    weight = list(values)
    for _ in range(5):
        pick = S.knapsack(weight, costs, capacity, 1e-8)
        before = list(weight)
        for codes, share, decay in ((windows, 0.34, 0.86), (groups, 0.28, 0.78)):
            for code in {codes[i] for i in pick}:
                crowd = sorted((i for i in pick if codes[i] == code), key=lambda i: -values[i] / costs[i])
                if sum(costs[i] for i in crowd) > max(1, capacity * share):
                    for n in range(1, len(crowd)):
                        if sum(costs[i] for i in crowd[: n + 1]) > capacity * share:
                            weight[crowd[n]] = min(weight[crowd[n]], max(0.3 * values[crowd[n]], decay * weight[crowd[n]]))
        if all(b - w <= 1e-12 for b, w in zip(before, weight)):
            break
    return sorted(pick)


@pytest.mark.parametrize("seed", range(20))
def test_soft_diversity_equals_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    values, lengths, position = rng.random(n), rng.uniform(0.3, 8, n), np.sort(rng.random(n))
    groups = rng.integers(0, 4, n).tolist()
    got = S.soft_diversity(values.tolist(), lengths.tolist(), position.tolist(), groups, 30.0)
    costs = [S.ticks(x, 0.5, "round") for x in lengths]
    assert sorted(got) == plain_diversity(values.tolist(), costs, [int(10 * p) for p in position], groups, 60)
    assert got == sorted(got, key=lambda i: position[i])


def test_cut_matching_is_one_to_one(spark):
    p = spark.createDataFrame([(0, 1.0), (0, 1.2), (0, 9.0)], "v int, t double")
    t = spark.createDataFrame([(0, 1.1), (0, 20.0)], "v int, t double")
    assert tuple(E.match_cuts(p, t, ["v"], "t", 1.0).first()) == (0, 1, 3, 2)


def test_mask_scores_of_an_empty_side(spark):
    p = spark.createDataFrame([(0, 1), (0, 2)], "v int, f int")
    assert tuple(E.mask_scores(p, p.limit(0), ["v"], "f").first()) == (0, 0.0, 0.0, 0.0)


def test_priority_union_takes_the_first_lane(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert {r.i: r.source for r in K.priority_union([("a", a), ("b", b)], ["i"]).collect()} == {1: "a", 2: "a", 3: "b"}


def test_dialogue_cues(spark):
    rows = [(1, "I love hope."), (2, "They betray and kill, we must decide."), (3, "Nothing.")]
    d = spark.createDataFrame(rows, "i int, s string").select("i", T.dialogue_cues("s").alias("c")).select("i", "c.*")
    got = {r.i: r for r in d.collect()}
    assert got[1].polarity == 1.0 and got[2].polarity == -1.0 and got[2].decision == 1.0 and got[2].confidence == 0.75
    assert tuple(got[3])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_sound_labels(spark):
    d = spark.createDataFrame([("Glass, chink, clink",), ("Baby laughter",), ("Hum",)], "s string").select(T.translate_event("s").alias("t"))
    assert [r.t for r in d.collect()] == ["Glass clink", "Laughter", "Hum"]


SEGS = "video_id int, start_seconds double, end_seconds double, segment_score double, video_duration double"
TURNS = "video_id int, start_seconds double, end_seconds double"


def test_speech_safe_segments_within_the_budget(spark):
    segs = spark.createDataFrame([(0, 2.0, 3.5, 0.9, 100.0), (0, 12.0, 13.0, 0.2, 100.0), (1, 0.0, 16.1, 0.6, 100.0), (1, 40.0, 47.3, 0.67, 100.0), (1, 80.0, 91.6, 0.75, 100.0)], SEGS)
    turns = spark.createDataFrame([(0, 1.0, 4.0), (0, 11.5, 13.5), (2, 0.0, 50.0)], TURNS)
    got = [(r.start_seconds, r.end_seconds, r.speech) for r in G.speech_safe(segs.where("video_id = 0"), turns, 4.0).collect()]
    assert got == [(0.78, 4.22, True)]
    got = sorted((r.start_seconds, r.end_seconds) for r in G.speech_safe(segs.where("video_id = 1"), turns, 30.0).collect())
    assert [a for a, _ in got] == [0.0, 80.0] and 27 < sum(z - a for a, z in got) <= 30
    assert G.speech_safe(segs.where("video_id = 9"), turns, 30.0).count() == 0
    assert G.speech_safe(segs, turns.where("false")).count() == 5
    # a single silent segment is trimmed, one that nothing fits has no row
    one = spark.createDataFrame([(0, 50.0, 80.0, 0.5, 100.0), (2, 10.0, 20.0, 0.5, 100.0)], SEGS)
    assert [(r.video_id, r.start_seconds, r.end_seconds) for r in G.speech_safe(one, turns, 8.0).collect()] == [(0, 50.0, 58.0)]


def test_speech_safe_equals_the_plain_guard(spark):
    rnd = random.Random(5)
    rows, said = [], []
    for v in range(40):
        at = 0.0
        for _ in range(rnd.randrange(1, 9)):
            at += rnd.randrange(1, 80) / 10
            rows.append((v, at, at + rnd.randrange(5, 90) / 10, rnd.randrange(100) / 100, 90.0))
            at = rows[-1][2]
        said += [(v, a, a + rnd.randrange(3, 60) / 10) for a in (rnd.randrange(900) / 10 for _ in range(rnd.randrange(9)))]
    for target in (None, 12.0, 30.0):
        got = {}
        for r in G.speech_safe(spark.createDataFrame(rows, SEGS), spark.createDataFrame(said, TURNS), target).collect():
            got.setdefault(r.video_id, []).append((r.start_seconds, r.end_seconds, r.segment_score))
        for v in range(40):
            turns = [t[1:] for t in said if t[0] == v]
            safe = S.guard([{"start": a, "end": z, "score": s, "speech": False} for w, a, z, s, _ in rows if w == v], turns, None, duration=90.0)
            told = [r | {"speech": any(a < r["end"] and z > r["start"] for a, z in turns)} for r in safe]
            want = told if target is None else S.fill(told, target)
            assert sorted(got.get(v, [])) == sorted((r["start"], r["end"], r["score"]) for r in want)


def _best_worth(rows, places, room):
    """The most that any subset of rows is worth within room half seconds."""
    best = 0.0
    for n in range(len(places) + 1):
        for some in itertools.combinations(places, n):
            if sum(max(1, math.ceil(rows[i][1] / 0.5)) for i in some) <= room:
                best = max(best, sum(_worth(rows[i]) for i in some))
    return best


def _worth(r):
    return r[0] * math.sqrt(max(r[1], 1.0)) + (0.75 if r[2] else 0.0) + (0.0 if r[4] else 0.20)


def test_protected_rows_come_first():
    rnd = random.Random(11)
    for _ in range(120):
        rows = [(rnd.randrange(100) / 100, rnd.randrange(2, 40) / 4, rnd.random() < 0.3, rnd.random() < 0.4, rnd.random() < 0.5) for _ in range(rnd.randrange(8))]
        budget = rnd.randrange(0, 40) / 2
        room, kept = round(budget / 0.5), []
        for i in sorted((i for i in range(len(rows)) if rows[i][2]), key=lambda i: (not rows[i][3], -rows[i][0], i)):
            cost = max(1, math.ceil(rows[i][1] / 0.5))
            if cost <= room:
                kept.append(i)
                room -= cost
        got = S.protected_first([r[0] for r in rows], [r[1] for r in rows], budget, *[[r[k] for r in rows] for k in (2, 3, 4)])
        assert set(kept) <= set(got) and sum(rows[i][1] for i in got) <= budget + 1e-9
        rest = [i for i in range(len(rows)) if i not in kept]
        assert math.isclose(sum(_worth(rows[i]) for i in got if i not in kept), _best_worth(rows, rest, room), abs_tol=1e-9)


def test_balanced_acts():
    rnd = random.Random(12)
    for _ in range(60):
        n = rnd.randrange(1, 30)
        score, length = [rnd.randrange(100) / 100 for _ in range(n)], [rnd.randrange(4, 60) / 4 for _ in range(n)]
        act = [rnd.choice(list(S.ACT_QUOTAS)) for _ in range(n)]
        must = [i == 0 for i in range(n)]
        got = S.balanced_acts(score, length, act, 40.0, must)
        # a mandatory row over its act's share is not taken from the other acts' shares
        over = max(0.0, length[0] - S.ACT_QUOTAS[act[0]] * 40.0)
        assert 0 in got and sum(length[i] for i in got) <= 40.0 + over + 1e-6
        spent = {a: sum(length[i] for i in got if act[i] == a) for a in S.ACT_QUOTAS}
        for a, q in S.ACT_QUOTAS.items():
            assert spent[a] - (length[0] if act[0] == a else 0.0) <= 1.2 * q * 40.0 + 1e-6
        # nothing that is left fits both what remains and its act's limit
        for i in set(range(n)) - set(got):
            assert sum(length[j] for j in got) + length[i] > 40.0 + 1e-6 or spent[act[i]] + length[i] > 1.2 * S.ACT_QUOTAS[act[i]] * 40.0 + 1e-6
    with pytest.raises(ValueError):
        S.balanced_acts([1.0], [50.0], ["act_i"], 40.0, [True])
    assert S.balanced_acts([], [], [], 40.0) == []


def plain_chain(turns, overlaps):
    """The correction chain turn by turn. turns: dicts of start, end, who, vec; returns (turns after merging, counts)."""
    def norm(v):
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n > 1e-12 else list(v)

    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    mean = lambda rows, w: norm([sum(k * r[d] for r, k in zip(rows, w)) for d in range(len(rows[0]))])
    ts = [dict(t, vec=None if t["vec"] is None or t["end"] - t["start"] < 0.5 else norm(t["vec"])) for t in turns]
    told = [t for t in ts if t["vec"] is not None]
    weight = lambda t: min(5.0, t["end"] - t["start"])

    def centres():
        return {n: mean([t["vec"] for t in told if t["who"] == n], [weight(t) for t in told if t["who"] == n]) for n in sorted({t["who"] for t in told})}

    moved = 0
    before = [t["who"] for t in told]
    for _ in range(2):
        c, changed = centres(), False
        if len(c) < 2:
            break
        for t in told:
            best = max(c, key=lambda n: dot(t["vec"], c[n]))
            if best != t["who"] and dot(t["vec"], c[best]) >= 0.72 and dot(t["vec"], c[best]) - dot(t["vec"], c[t["who"]]) >= 0.15:
                t["to"] = best
        for t in told:
            if "to" in t:
                t["who"], changed = t.pop("to"), True
        if not changed:
            break
    moved = sum(a != t["who"] for a, t in zip(before, told))
    free = 1 + max([int(t["who"].split("_")[-1]) for t in ts if t["who"].split("_")[-1].isdigit()], default=-1)
    splits = 0
    for name in dict.fromkeys(t["who"] for t in told):
        own = [t for t in told if t["who"] == name]
        if len(own) < 2:
            continue
        i, j = min(((i, j) for i in range(len(own)) for j in range(len(own))), key=lambda p: dot(own[p[0]]["vec"], own[p[1]]["vec"]))
        a, b, label = own[i]["vec"], own[j]["vec"], None
        for _ in range(20):
            new = [int(dot(t["vec"], b) > dot(t["vec"], a)) for t in own]
            if new == label:
                break
            label = new
            if len(set(label)) < 2:
                break
            a, b = (norm([sum(t["vec"][d] for t, x in zip(own, label) if x == k) for d in range(len(a))]) for k in (0, 1))
        if len(set(label)) < 2:
            continue
        one = norm([sum(t["vec"][d] for t in own) for d in range(len(a))])
        gain = sum(dot(t["vec"], (a, b)[x]) - dot(t["vec"], one) for t, x in zip(own, label)) / len(own)
        if dot(a, b) >= 0.55 or gain < 0.10:
            continue
        goes = int(sum(label) < len(own) - sum(label)) if 2 * sum(label) != len(own) else label[-1]
        new = f"SPEAKER_{free:02d}"
        free, splits = free + 1, splits + 1
        for t, x in zip(own, label):
            t["who"] = new if x == goes else name
        for k, t in enumerate(ts):
            if t["vec"] is None and t["who"] == name:
                left = next((u["who"] for u in reversed(ts[:k]) if u["who"] in (name, new)), None)
                right = next((u["who"] for u in ts[k + 1 :] if u["who"] in (name, new)), None)
                if left == right == new:
                    t["who"] = new
    c = centres()
    pairs = sorted(((dot(c[p], c[q]), p, q) for p in c for q in c if p < q and dot(c[p], c[q]) >= 0.88 and (p, q) not in overlaps), reverse=True)
    into = {}
    for _, p, q in pairs:
        p, q = into.get(p, p), into.get(q, q)
        if p != q:
            into[q] = p
    names = set(c)
    for t in ts:
        while t["who"] in into:
            t["who"] = into[t["who"]]
    merged = sum(n in into for n in names)
    short = 0
    for k in range(1, len(ts) - 1):
        l, t, r = ts[k - 1 : k + 2]
        close = t["end"] - t["start"] <= 0.25 + 1e-9 and t["start"] - l["end"] <= 0.08 + 1e-9 and r["start"] - t["end"] <= 0.08 + 1e-9
        if l["who"] == r["who"] != t["who"] and close and l["vec"] and r["vec"] and dot(l["vec"], r["vec"]) >= 0.75:
            t["who"] = l["who"]
            short += 1
    out = []
    for t in ts:
        if out and out[-1][2] == t["who"] and 0 <= t["start"] - out[-1][1] <= 0.08:
            out[-1] = (out[-1][0], t["end"], t["who"])
        else:
            out.append((t["start"], t["end"], t["who"]))
    return out, (moved, splits, merged, short)


def random_turns(seed):
    rng = np.random.default_rng(seed)
    voices, at, turns = rng.normal(size=(4, 6)), 0.0, []
    for _ in range(int(rng.integers(1, 40))):
        at = round(at + float(rng.choice([0.0, 0.05, 0.5])), 3)
        length = round(float(rng.choice([0.2, 0.4, 1.0, 3.0, 9.0])), 3)
        who = int(rng.integers(4))
        vec = voices[who] + rng.normal(size=6) * float(rng.choice([0.05, 0.4]))
        turns.append({"start": at, "end": round(at + length, 3), "who": f"S_{int(rng.integers(3)) if rng.random() < 0.3 else who % 3}", "vec": vec.tolist() if rng.random() < 0.9 else None})
        at = turns[-1]["end"]
    return turns, {("S_0", "S_1")} if seed % 3 == 0 else set()


def test_correction_chain_equals_the_plain_version(spark):
    rows, pairs, want = [], [], {}
    for seed in range(40):
        turns, overlaps = random_turns(seed)
        rows += [(seed, t["start"], t["end"], t["who"], t["vec"]) for t in turns]
        pairs += [(seed, a, b) for a, b in overlaps]
        want[seed] = plain_chain(turns, overlaps)
    got = {v: [] for v in want}
    for r in C.corrected_turns(spark.createDataFrame(rows, "video_id long, start_seconds double, end_seconds double, speaker string, vec array<double>"), spark.createDataFrame(pairs, "video_id long, a string, b string")).collect():
        got[r.video_id].append(((r.start_seconds, r.end_seconds, r.speaker), (r.reassigned, r.splits, r.merged, r.interruptions)))
    for v, (turns, counts) in want.items():
        assert sorted(t for t, _ in got[v]) == turns and {c for _, c in got[v]} == {counts}, v
    assert all(any(c[k] for _, c in want.values()) for k in range(4))


def test_the_larger_half_keeps_its_name():
    x = [[1, 0]] * 5 + [[0, 1]]
    assert C.split_speakers(x, ["S_0"] * 6) == (["S_0"] * 5 + ["SPEAKER_01"], 1)
    assert C.split_speakers([[1, 0], [0, 1]], ["S_0"] * 2) == (["S_0", "SPEAKER_01"], 1)
    assert C.split_speakers([None, None], ["A", "A"]) == (["A", "A"], 0)


@pytest.mark.parametrize("seed", range(12))
def test_viterbi_equals_the_best_of_all_paths(seed):
    rng = random.Random(seed)
    turns = [{"s": a, "e": a + rng.randrange(1, 12) / 4, "who": rng.choice("ABC")} for a in (rng.randrange(0, 24) / 4 for _ in range(rng.randrange(1, 7)))]
    words = sorted(({"s": a, "e": a + rng.randrange(1, 4) / 4} for a in (rng.randrange(0, 32) / 4 for _ in range(6))), key=lambda w: (w["s"], w["e"]))
    if seed % 3 == 0:
        words[2]["forced"] = "B"
    names = sorted({t["who"] for t in turns} | {w["forced"] for w in words if "forced" in w})

    def says(w):
        if "forced" in w:
            return {n: 1e6 if n == w["forced"] else -1e6 for n in names}
        out = {n: sum(max(0.0, min(w["e"], t["e"]) - max(w["s"], t["s"])) for t in turns if t["who"] == n) / (w["e"] - w["s"]) for n in names}
        mid = (w["s"] + w["e"]) / 2
        if not any(out.values()):
            out[min(turns, key=lambda t: (max(t["s"] - mid, mid - t["e"], 0.0), t["s"]))["who"]] = 0.1
        return out

    emit = [says(w) for w in words]
    worth = lambda path: sum(e[n] for e, n in zip(emit, path)) - 0.35 * sum(a != b for a, b in zip(path, path[1:]))
    best = max(worth(p) for p in itertools.product(names, repeat=len(words)))
    assert math.isclose(worth(P.viterbi(words, turns)), best, abs_tol=1e-6)


def test_plane_equals_a_decomposition(spark):
    from sceneql.operators import retrieval as Q

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [5, 2, 1, 0.5, 0.1] + 3
    got, shares = Q.plane(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), "i", "v")
    left, single, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    raw = left[:, :2] * single[:2]
    raw *= np.sign(raw[np.abs(raw).argmax(axis=0), [0, 1]])
    lo, hi = np.percentile(raw, [2, 98], axis=0)
    want = 0.06 + 0.88 * np.clip((raw - lo) / (hi - lo), 0, 1)
    assert np.allclose(shares, (single**2 / (single**2).sum())[:2], atol=1e-4)
    assert np.allclose([[r.x, r.y] for r in got.orderBy("i").collect()], want, atol=1e-6)
    assert [(r.x, r.y) for r in Q.plane(spark.createDataFrame([(1, [1.0, 2.0])], "i long, v array<double>"), "i", "v")[0].collect()] == [(0.5, 0.5)]


def test_query_banks_are_bounded(spark):
    from sceneql.operators import retrieval as Q

    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "i long, v array<double>")
    q = v.where("i % 4 = 0").select("i", F.col("v").alias("qv"))
    items = v.select(F.col("i").alias("j"), "v")
    rows = lambda most: sorted(map(tuple, Q.top_cosine(q, items, "i", "qv", "j", "v", 3, most=most).collect()))
    assert len(Q.banks(q, "qv", 6)) == 5 and rows(6) == rows(1 << 24) and len(rows(6)) == 30


def test_segment_masks_fall_back(spark):
    seg = np.array([0, 4]), np.array([3, 9])
    assert E.best_segments(np.array([0.1] * 4 + [0.9] * 6), *seg, 0.6).tolist() == [False] * 4 + [True] * 6
    assert E.best_segments(np.arange(10.0), *seg, 0.15).nonzero()[0].tolist() == [9]
    assert E.best_segments(np.ones(10), *seg, 0.15).nonzero()[0].tolist() == [0, 1]


def test_character_grams(spark):
    d = spark.createDataFrame([("a bcd",), ("",), (None,)], "s string").select(T.char_grams("s").alias("g"))
    assert d.first().g == [" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "]
    assert [r.g for r in d.collect()][1:] == [[], None]
