"""The main plan of a summary against a plain version: one video after the other, everything recomputed from lists."""

import math
import random

import pytest

from sceneql.operators import scoring as P
from sceneql.operators import segments as G
from sceneql.operators import selection as S
from sceneql.operators import speech
from sceneql.operators import summary as M
from sceneql.operators import topk as K

SHOTS = "video_id long, scene_id long, start_seconds double, end_seconds double, action_score double, dialogue_score double, importance_score double, event double, story string, speech_ratio double, credit_probability double, energy double"
WORDS = "video_id long, start_seconds double, end_seconds double, word string"
TURNS = "video_id long, start_seconds double, end_seconds double"


def plain_knapsack(values, costs, room, margin=0.0, by_items=True):
    """The choice of a table filled item by item, with the sets written out."""
    table = [(0.0, ())] * (room + 1)
    for i, (v, c) in enumerate(zip(values, costs)):
        old = list(table)
        for k in range(c, room + 1):
            if old[k - c][0] + v > old[k][0] + margin:
                table[k] = (old[k - c][0] + v, (*old[k - c][1], i))
    best = max(table, key=lambda t: (t[0], len(t[1]))) if by_items else max(table, key=lambda t: t[0])
    return list(best[1])


def alike(a, b):
    x, y = math.sqrt(sum(v * v for v in a)), math.sqrt(sum(v * v for v in b))
    return 0.0 if min(x, y) <= 1e-12 else min(1.0, max(0.0, sum(p * q for p, q in zip(a, b)) / (x * y)))


def plain_mmr(pool, taken, weight, k):
    """Marginal relevance with every similarity computed anew in each round."""
    left, out = list(pool), []
    while left and len(out) < k:
        def worst(r):
            return max([0.0] + [1.0 if r["story"] is not None and r["story"] == t["story"] else alike(r["x"], t["x"]) for t in [*taken, *(o for o, _ in out)]])

        scored = [(r["score"] - weight * worst(r), r) for r in left]
        m, r = max(scored, key=lambda t: t[0])
        out.append((r, round(m, 6)))
        left.remove(r)
    return out


def plain_regions(rows, quotas, budget, weight, shortest, distinct):
    taken, told = [r for r in rows if r["must"]], {}
    name = lambda r: r["story"] if r["story"] is not None else ("own", r["id"])
    for r in taken:
        told[name(r)] = told.get(name(r), 0) + 1

    def pass_(pool, room):
        slots = max(1, math.ceil(room / max(shortest, 0.5)))
        pool = sorted(pool, key=lambda r: -r["score"])[: min(400, max(80, 4 * slots))]
        ranked, seen = [], set()
        for r, m in plain_mmr(pool, taken, weight, max(16, 2 * slots)):
            if not distinct or name(r) not in seen:
                ranked.append((r, m))
                seen.add(name(r))
        pick = plain_knapsack([max(m, 1e-6) for _, m in ranked], [max(1, round(r["cost"] / 0.5)) for r, _ in ranked], round(room / 0.5))
        for r, _ in sorted((ranked[i] for i in pick), key=lambda t: -t[1]):
            if told.get(name(r), 0) < 2:
                taken.append(r)
                told[name(r)] = told.get(name(r), 0) + 1

    for region, share in quotas.items():
        used = sum(r["cost"] for r in taken if r["region"] == region)
        pass_([r for r in rows if r["region"] == region and not r["must"]], max(0.0, round(budget * share, 3) - used))
    room = max(0.0, budget - sum(r["cost"] for r in taken))
    rest = [r for r in rows if r not in taken]
    if room >= 0.5 and rest:
        pass_(rest, room)
    return [r["id"] for r in taken] or [max(rows, key=lambda r: r["score"])["id"]]


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("quotas", [{n: q for n, _, q in P.REGIONS}, S.ACT_QUOTAS, S.COMPACT_QUOTAS], ids=["ten", "acts", "compact"])
def test_region_select_equals_the_plain_version(seed, quotas):
    rnd = random.Random(seed)
    acts = quotas is S.ACT_QUOTAS
    rows = [{"id": i, "score": rnd.randrange(1000) / 1000, "cost": rnd.randrange(8, 60) / 4, "region": rnd.choice(list(quotas)), "story": None if rnd.random() < 0.2 else rnd.randrange(12), "x": [rnd.random() for _ in range(7)] if rnd.random() < 0.95 else [0.0] * 7, "must": acts and rnd.random() < 0.05} for i in range(rnd.randrange(1, 70))]
    budget, weight = rnd.choice([20.0, 60.0, 150.0]), rnd.choice([0.12, 0.25])
    got = S.region_select([r["score"] for r in rows], [r["cost"] for r in rows], [r["region"] for r in rows], [r["story"] for r in rows], [r["x"] for r in rows], quotas, budget, weight, 4.0, [r["must"] for r in rows], acts)
    assert sorted(i for i, *_ in got) == sorted(plain_regions(rows, quotas, budget, weight, 4.0, acts))
    assert [rows[i]["score"] for i, *_ in got] == sorted((rows[i]["score"] for i, *_ in got), reverse=True)


def test_region_select_fixtures():
    n = 12
    score, at = [0.95 - 0.01 * i for i in range(n)], [(10.0 * i + 1.0) / 120.0 for i in range(n)]
    where = ["intro" if x <= 0.20 else "ending" if x >= 0.75 else "middle" for x in at]
    got = S.region_select(score, [5.5] * n, where, [None] * n, [[s, 0.2 * (i % 3), 0, 0, 0, 0.1, x] for i, (s, x) in enumerate(zip(score, at))], S.COMPACT_QUOTAS, 30.0, 0.20, 4.0)
    assert {where[i] for i, *_ in got} == {"intro", "middle", "ending"}
    assert [i for i, *_ in S.region_select([0.1, 0.9], [50.0, 60.0], ["x", "x"], [1, 2], [[1.0], [1.0]], {"x": 1.0}, 5.0, 0.2, 4.0)] == [1]
    assert S.region_select([], [], [], [], [], {"x": 1.0}, 5.0, 0.2, 4.0) == []


def plain_union(intervals, gap):
    total, end = 0.0, None
    for a, z in sorted(intervals):
        total += z - a if end is None or a > end + gap else max(0.0, z - end)
        end = z if end is None or a > end + gap else max(end, z)
    return total


def plain_diversity(scores, lengths, positions, groups, budget):
    """Soft diversity with its own knapsack; scores may be 0."""
    value, room = [max(s, 1e-6) for s in scores], max(1, int(budget / 0.5))
    cost, weight, pick = [max(1, round(max(0.05, d) / 0.5)) for d in lengths], None, []
    weight = list(value)
    for _ in range(5):
        pick = plain_knapsack(weight, cost, room, 1e-8, False)
        before = list(weight)
        for code, share, decay in ((lambda i: int(10 * min(max(positions[i], 0), 0.999999)), 0.34, 0.86), (lambda i: groups[i], 0.28, 0.78)):
            for c in {code(i) for i in pick}:
                crowd = sorted((i for i in pick if code(i) == c), key=lambda i: -value[i] / cost[i])
                if sum(cost[i] for i in crowd) > max(1, room * share):
                    for n in range(1, len(crowd)):
                        if sum(cost[i] for i in crowd[: n + 1]) > room * share:
                            weight[crowd[n]] = min(weight[crowd[n]], max(0.3 * value[crowd[n]], decay * weight[crowd[n]]))
        if all(b - w <= 1e-12 for b, w in zip(before, weight)):
            break
    return pick


@pytest.mark.parametrize("seed", range(20))
def test_diversity_takes_rows_of_score_zero(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 25)
    scores, lengths, at = [rnd.choice([0.0, 0.0, rnd.randrange(1, 100) / 100]) for _ in range(n)], [rnd.randrange(2, 30) / 4 for _ in range(n)], sorted(rnd.random() for _ in range(n))
    groups = [rnd.randrange(4) for _ in range(n)]
    assert sorted(S.soft_diversity(scores, lengths, at, groups, 25.0)) == sorted(plain_diversity(scores, lengths, at, groups, 25.0))
    assert sorted(S.soft_diversity([0.0, 0.0, 0.5], [1.0] * 3, [0.1, 0.5, 0.9], [1, 2, 3], 60.0)) == [0, 1, 2]


def plain_refill(taken, spare, target, gap, shortest, duration):
    clear = lambda s, others: all(s[1] + gap < a or s[0] - gap > z for a, z in others)
    missing = max(0.0, target - plain_union(taken, 0.0), min(12.0, 0.4 * target))
    if missing < shortest:
        return []
    free = [k for k, s in enumerate(spare) if clear(s, taken)]
    pick = plain_diversity([spare[k][2] for k in free], [spare[k][1] - spare[k][0] for k in free], [(spare[k][0] + spare[k][1]) / 2 / duration for k in free], [spare[k][3] for k in free], min(target, 1.15 * missing))
    first = [free[i] for i in pick]
    out, now = [], list(taken)
    for k in sorted(first, key=lambda k: (-spare[k][2], k)) + sorted((k for k in free if k not in first), key=lambda k: (-spare[k][2], k)):
        if clear(spare[k], now):
            out.append(k)
            now.append(spare[k][:2])
            if sum(spare[j][1] - spare[j][0] for j in out) >= 1.15 * missing:
                break
    return out


@pytest.mark.parametrize("seed", range(30))
def test_refill_equals_the_plain_version(seed):
    rnd = random.Random(seed)
    taken = [(a, a + rnd.randrange(8, 40) / 4) for a in (rnd.randrange(0, 1200) / 4 for _ in range(rnd.randrange(5)))]
    spare = [(a, a + rnd.randrange(16, 60) / 4, rnd.randrange(1000) / 1000, rnd.randrange(9)) for a in (rnd.randrange(0, 1200) / 4 for _ in range(rnd.randrange(30)))]
    target = rnd.choice([15.0, 40.0, 90.0])
    assert S.refill(taken, *zip(*spare), target, 2.5, 4.0, 300.0) == plain_refill(taken, spare, target, 2.5, 4.0, 300.0) if spare else S.refill(taken, [], [], [], [], target, 2.5, 4.0, 300.0) == []


def plain_greedy(rows, order, target, gap, shortest, trim, given, slack):
    out, total = {i: rows[i] for i in given}, sum(rows[i][1] - rows[i][0] for i in given)
    for i in order:
        if i in out:
            continue
        if len(out) >= max(1, round(target / 3.0)) and total >= 0.85 * target:
            break
        cost = plain_union([*out.values(), rows[i]], gap)
        if cost <= total + 0.001:
            continue
        if cost > target * (1 + slack):
            if total < 0.80 * target and target - total >= shortest:
                cut = trim(i, target - total)
                if cut and plain_union([*out.values(), cut], gap) <= target * (1 + slack) + 0.001:
                    out[i] = cut
                    total = plain_union(out.values(), gap)
            if total >= target:
                break
            continue
        out[i] = rows[i]
        total = cost
        if total >= target:
            break
    return out


@pytest.mark.parametrize("seed", range(40))
def test_greedy_fill_equals_recomputing_every_union(seed):
    rnd = random.Random(seed)
    rows = [(a, a + rnd.randrange(8, 60) / 4) for a in (rnd.randrange(0, 1600) / 4 for _ in range(rnd.randrange(1, 60)))]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    given = order[:1] if seed % 4 == 0 else []
    trim = lambda i, room: (rows[i][0], rows[i][0] + math.floor(room)) if i % 3 else None
    target = rnd.choice([12.0, 45.0, 120.0])
    got = S.greedy_fill([a for a, _ in rows], [z for _, z in rows], order, target, 2.5, 4.0, trim, given, 0.10 * bool(given))
    assert got == plain_greedy(rows, order, target, 2.5, 4.0, trim, given, 0.10 * bool(given))


# --- the whole plan -------------------------------------------------------------------------------------------------


def plain_utterances(words):
    out, run = [], []
    for k, w in enumerate(words):
        run.append(w)
        last = k + 1 == len(words)
        if w[2].rstrip("\"')")[-1] in ".!?…" or last or words[k + 1][0] - w[1] >= 2.75:
            text = " ".join(x[2] for x in run)
            letters = ["".join(c for c in x[2].lower() if c.isalpha()) for x in run]
            named = [x for x in letters if x]
            from sceneql.functions import vocabularies as L

            out.append({"s": run[0][0], "e": run[-1][1], "whole": text[-1] not in ",;:" and not (named and named[-1] in L.DANGLING), "goes_on": bool(named) and named[0] in L.CONTINUATION, "asks": text[-1] == "?"})
            run = []
    return out


class Plain:
    """One video: what is said, as lists."""

    def __init__(self, words, turns, shots, duration):
        self.w, self.u, self.t, self.shots, self.end = words, plain_utterances(words), sorted(turns), shots, duration

    def over(self, a, z):
        return [k for k, u in enumerate(self.u) if u["e"] > a and u["s"] < z]

    def next(self, k, gap):
        return k + 1 if k + 1 < len(self.u) and 0 <= self.u[k + 1]["s"] - self.u[k]["e"] <= gap else None

    def look(self, a, z):
        n = sum(1 for w in self.w if w[1] > a and w[0] < z)
        if not n:
            return any(s["end"] > a and s["start"] < z and s["talk"] for s in self.shots), True, 0
        ok = True
        for k in self.over(a, z):
            u, m = self.u[k], self.next(k, 12.0)
            ok &= a <= u["s"] + 0.02 and z >= u["e"] - 0.02 and (u["whole"] or (m is not None and z >= self.u[m]["e"] - 0.02))
        return True, ok, n

    def align(self, a, z, category, most):
        reach, sentences = {"action": (0.6, False), "dialogue": (3.0, True), "importance": (8.0, True), "custom": (1.5, True)}[category]
        if not self.w:
            talk = [s for s in self.shots if s["end"] > a and s["start"] < z and s["talk"]]
            b, y = a, z
            if sentences and talk:
                f, l = talk[0]["start"], talk[-1]["end"]
                if z - a > most and l - f <= most:
                    b, y = f, l
                else:
                    b, y = (f if 0 < a - f <= reach else a), (l if 0 < l - z <= reach else z)
            return b, min(y, b + most)
        b, y, over = a, z, self.over(a, z)
        if sentences and over:
            f, l = over[0], over[-1]
            if f and (not self.u[f - 1]["whole"] or self.u[f]["goes_on"]) and 0 <= self.u[f]["s"] - self.u[f - 1]["e"] <= 6.0 and self.u[l]["e"] - self.u[f - 1]["s"] <= most:
                f -= 1
            m = self.next(l, 12.0)
            if not self.u[l]["whole"] and m is not None and self.u[m]["e"] - self.u[f]["s"] <= most:
                l = m
            us, ue = self.u[f]["s"], self.u[l]["e"]
            b = us if 0.02 < a - us <= reach else b
            y = ue if 0.02 < ue - z <= reach else y
            if self.u[l]["asks"]:
                m = self.next(l, 5.0)
                if m is not None and self.u[m]["e"] - b <= most:
                    y = max(y, self.u[m]["e"])
                elif z > ue + 0.02:
                    y = ue
            if ue - us <= most:
                b, y = (us if b > us + 0.02 else b), (ue if y < ue - 0.02 else y)
        cut = lambda t: next((w for w in self.w if w[0] + 0.02 < t < w[1] - 0.02), None)
        w = cut(b)
        b = w[0] if w and b - w[0] <= reach else b
        w = cut(y)
        y = w[1] if w and w[1] - y <= reach else y
        if y - b > most:
            ends = [u["e"] for u in self.u if u["whole"]] if sentences else []
            fit = [e for e in ends if b + 0.25 <= e <= b + most + 0.02] or [w[1] for w in self.w if b + 0.25 <= w[1] <= b + most + 0.02]
            y = max(fit) if fit else b + most
        return (a, z) if y <= b else (b, y)

    def widen(self, a, z):
        a, z = max(0.0, a), min(self.end, z)
        for _ in range(len(self.u) + 1):
            for k in self.over(a, z):
                a, z = min(a, self.u[k]["s"]), max(z, self.u[k]["e"])
                m = self.next(k, 12.0)
                if not self.u[k]["whole"] and m is not None:
                    z = max(z, self.u[m]["e"])
        b, y = max(0.0, a - 0.45), min(self.end, z + 0.45)
        return round(a if self.over(b, a) else b, 3), round(z if self.over(z, y) else y, 3)

    def safe(self, a, z):
        if not self.t:
            return a, z
        a, z = max(0.0, a), min(self.end, z)
        for _ in range(len(self.t) + 1):
            for s, e in self.t:
                a = max(0.0, s - 0.22) if s < a < e else a
                z = min(self.end, e + 0.22) if s < z < e else z
        return round(a, 3), round(z, 3)

    def trim(self, a, room, shortest):
        if room < shortest:
            return None
        lo, hi = a + shortest, a + room
        if any(w[1] > a and w[0] < hi for w in self.w):
            ends = [self.u[k]["e"] for k in self.over(a, hi) if self.u[k]["whole"] and lo <= self.u[k]["e"] <= hi + 0.02]
        else:
            ends = [s["end"] for s in self.shots if lo <= s["end"] <= hi + 0.02 and not any(w[0] + 0.02 < s["end"] < w[1] - 0.02 for w in self.w)]
        if not ends:
            return None
        z = max(ends)
        z = min(self.end, z + 0.45, hi) if self.look(a, z)[0] else z
        a, z = self.safe(a, z)
        told, ok, _ = self.look(a, z)
        return (a, z) if ok or not told else None


def plain_plan(rows, words, turns, category, target):
    """(kind, segment start, end, status) of one video's plan: adaptive importance, action or dialogue."""
    shortest, _, longest, pre, post, gap = G.CATEGORIES[category]
    left = [r for r in rows if r["credit"] < 0.65] or rows
    end = max(r["end"] for r in left)
    for k, r in enumerate(left):
        x = r[category]
        before, after = (left[k - 1][category] if k else x), (left[k + 1][category] if k + 1 < len(left) else x)
        r["smooth"] = round(0.2 * before + 0.6 * x + 0.2 * after, 4)
    top, mean = max(r["smooth"] for r in left), sum(r["smooth"] for r in left) / len(left)
    fit = [r for r in left if not (r["smooth"] < 0.4 * top and r["smooth"] < mean)]
    mid = lambda r: (r["start"] + r["end"]) / 2 / end
    for r in fit:
        r["cost"] = min(max(r["end"] - r["start"] + pre + post, shortest), longest)
        r["score"], r["must"] = r["smooth"], False
        r["x"] = [r["action"], r["dialogue"], r["importance"], r["energy"], r["talks"], min((r["end"] - r["start"]) / 20, 1.0), min(max(mid(r), 0), 1)]
        r["region"] = "intro" if r["start"] / end <= -1 else None
    if category == "importance":
        told, pool = {}, []
        for r in sorted(fit, key=lambda r: -r["smooth"]):
            if told.get(r["story"], 0) < 2:
                pool.append(r)
                told[r["story"]] = told.get(r["story"], 0) + 1
        ids = [pool[i]["id"] for i in plain_diversity([r["smooth"] for r in pool], [r["cost"] for r in pool], [mid(r) for r in pool], [r["story"] for r in pool], target)] or [pool[0]["id"]]
    elif len(fit) < 6:
        ids = [r["id"] for r in fit]
    else:
        compact = target < shortest * 10
        for r in fit:
            r["region"] = ("intro" if mid(r) <= 0.20 else "ending" if mid(r) >= 0.75 else "middle") if compact else next((n for n, b, _ in P.REGIONS if mid(r) <= b), P.REGIONS[-1][0])
        ids = plain_regions(fit, S.COMPACT_QUOTAS if compact else {n: q for n, _, q in P.REGIONS}, target, S.DIVERSITY[category], shortest, False)

    def snapped(r):
        a, z = max(0.0, r["start"] - pre), r["end"] + post
        if category == "importance" and r["event"] >= 0.9:
            k = left.index(r)
            for n in left[k + 1 : k + 3]:
                if n["event"] < 0.9:
                    break
                z = max(z, n["end"])
        pad = max(0.0, shortest - (z - a)) / 2
        a, z = max(0.0, a - pad), z + pad
        b = min((s["start"] for s in left), key=lambda t: abs(t - a))
        y = min((s["end"] for s in left), key=lambda t: abs(t - min(z, end)))
        y = b + 1.0 if y <= b else y
        core = [s for s in left if s["end"] > b and s["start"] < y and s["end"] > a and s["start"] < z] or [r]
        return b, y, core

    said = Plain(words, turns, [{"start": r["start"], "end": r["end"], "talk": r["talks"] > 0.1} for r in left], end)
    merged = []
    for b, y, core in sorted((snapped(r) for r in left if r["id"] in ids), key=lambda t: t[0]):
        if merged and b - merged[-1][1] <= gap:
            merged[-1] = (merged[-1][0], max(merged[-1][1], y), merged[-1][2] + core)
        else:
            merged.append((b, y, core))
    found, out = [], []
    for b, y, core in merged:
        most = max(longest, y - b) if category == "action" else longest
        scores = {c["id"]: c["smooth"] for c in core}
        score = round(0.6 * max(scores.values()) + 0.4 * sum(scores.values()) / len(scores), 4)
        story = min((c["id"], c["story"]) for c in core)[1]
        a, z = said.align(b, y, category, most)
        if z - a < shortest:
            a, z = said.align(a, min(end, max(y, a + shortest)), category, longest)
        if said.look(a, z)[0]:
            a, z = max(0.0, a - 0.45), min(end, z + 0.45)
        told, ok, _ = said.look(a, z)
        if told and not ok:
            c, x = said.widen(a, z)
            a, z = (c, x) if x > c else (a, z)
        a, z = said.safe(round(a, 3), round(z, 3))
        told, ok, _ = said.look(a, z)
        (found if ok or not told else out).append((a, z, score, story) if ok or not told else ("found", a, z, "incomplete"))
    kinds = ["found"] * len(found)
    if category != "importance":
        spare = []
        for r in sorted((r for r in fit if r["id"] not in ids), key=lambda r: (-round(r["smooth"], 4), -r["start"])):
            b, y, _ = snapped(r)
            a, z = said.align(b, y, category, max(longest, y - b))
            if said.look(a, z)[0]:
                a, z = said.widen(a, z)
            told, ok, _ = said.look(a, z)
            if z - a < shortest or z - a > target or (told and not ok):
                continue
            a, z = said.safe(round(a, 3), round(z, 3))
            told, ok, _ = said.look(a, z)
            if z - a <= target and (ok or not told):
                spare.append((a, z, r["smooth"], r["story"]))
        add = plain_refill([f[:2] for f in found], spare, target, gap, shortest, end)
        found += [spare[k] for k in add]
        kinds += ["reserve"] * len(add)
    order = sorted(range(len(found)), key=lambda i: -found[i][2])
    if category == "importance":
        pick = plain_diversity([found[i][2] for i in order], [found[i][1] - found[i][0] for i in order], [(found[i][0] + found[i][1]) / 2 / end for i in order], [found[i][3] for i in order], target)
        chosen = {order[k]: found[order[k]][:2] for k in pick} or {i: found[i][:2] for i in order[:1]}
    else:
        chosen = plain_greedy([f[:2] for f in found], order, target, gap, shortest, lambda i, room: said.trim(found[i][0], room, shortest), [], 0.0)
    return sorted(out + [(kinds[i], *map(lambda t: round(t, 6), chosen.get(i, f[:2])), "chosen" if i in chosen else "left") for i, f in enumerate(found)])


def random_film(seed, video):
    rnd = random.Random(seed)
    rows, words, turns, at, told = [], [], [], 0.0, 0.0
    for k in range(rnd.randrange(3, 60)):
        length = rnd.randrange(6, 80) / 8
        rows.append({"id": k + 1, "start": at, "end": at + length, "action": rnd.randrange(1001) / 1000, "dialogue": rnd.randrange(1001) / 1000, "importance": rnd.randrange(1001) / 1000, "event": rnd.choice([0.2, 0.95]), "story": str(k // 3), "talks": rnd.choice([0.0, 0.5]), "credit": rnd.choice([0.1] * 9 + [0.9]), "energy": rnd.randrange(101) / 100})
        at += length
    if seed % 4:
        said = ["so", "we", "go,", "now.", "why?", "yes!", "ve", "ama", "here", "and", "then.", "ki"]
        while told < at - 2:
            told = round(told + rnd.choice([0.1, 0.1, 0.2, 0.5, 3.0, 7.0]), 3)
            length = rnd.randrange(2, 7) / 10
            words.append((told, round(told + length, 3), rnd.choice(said)))
            told = words[-1][1]
    if seed % 3:
        turns = [(s, s + rnd.randrange(4, 40) / 8) for s in (rnd.randrange(int(8 * at)) / 8 for _ in range(rnd.randrange(12)))]
    return rows, words, turns


@pytest.mark.parametrize("category,target", [("action", 30.0), ("dialogue", 60.0), ("importance", 60.0), ("action", 90.0)])
def test_plan_equals_the_sequential_version(spark, category, target):
    shots, words, turns, want = [], [], [], {}
    for v in range(20):
        rows, w, t = random_film(100 * len(category) + v, v)
        shots += [(v, r["id"], r["start"], r["end"], r["action"], r["dialogue"], r["importance"], r["event"], r["story"], r["talks"], r["credit"], r["energy"]) for r in rows]
        words += [(v, *x) for x in w]
        turns += [(v, *x) for x in t]
        want[v] = plain_plan(rows, w, t, category, target)
    p = M.plan(spark.createDataFrame(shots, SHOTS), category, target, words=spark.createDataFrame(words, WORDS), turns=spark.createDataFrame(turns, TURNS)).cache()
    got = {v: [] for v in want}
    for r in p.collect():
        got[r.video_id].append((r.kind, round(r.start_seconds, 6), round(r.end_seconds, 6), r.status))
    for v in want:
        assert sorted(got[v]) == want[v], v
    told = {r.video_id: r for r in M.report(p).collect()}
    for v, rows in want.items():
        assert (told[v].incomplete, told[v].chosen, told[v].reserves) == (sum(r[3] == "incomplete" for r in rows), sum(r[3] == "chosen" for r in rows), sum(r[0] == "reserve" for r in rows))
    p.unpersist()


def film(rows):
    return [(0, i, float(a), float(z), s, s, s, 0.0, None, 0.0, c, 0.0) for i, a, z, s, c in rows]


def test_plan_fixtures(spark):
    dense = spark.createDataFrame(film([(i, 0.8 * (i - 1), 0.8 * i, 0.85 + 0.03 * (i % 3), 0.0) for i in range(1, 21)]), SHOTS)
    got = M.summarize(dense, "action", 16.0).collect()
    assert 1 <= len(got) <= 3 and all(r.duration >= 4.0 for r in got)
    joined = spark.createDataFrame(film([(1, 20, 24, 0.88, 0.0), (2, 24, 25, 0.85, 0.0), (3, 25, 31, 0.90, 0.0)]), SHOTS)
    assert [(r.start_seconds, r.end_seconds) for r in M.summarize(joined, "action", 15.0).collect()] == [(20.0, 31.0)]
    credits = spark.createDataFrame(film([(1, 0, 8, 0.95, 0.90), (2, 8, 16, 0.90, 0.05)]), SHOTS)
    for category in G.CATEGORIES:
        got = M.summarize(credits, category, 20.0, score="importance_score").collect()
        assert len(got) == 1 and got[0].start_seconds >= 8.0
    peak = spark.createDataFrame(film([(1, 0, 10, 0.20, 0.0), (2, 10, 11.2, 0.95, 0.0), (3, 11.2, 25, 0.25, 0.0)]), SHOTS)
    got = M.summarize(peak, "importance", 10.0).collect()
    assert len(got) == 1 and got[0].duration >= 5.0
    assert M.summarize(dense.limit(0), "action", 60.0).count() == 0


def test_summary_keeps_the_budget(spark):
    d = spark.createDataFrame(film([(i + 1, 4.0 * i, 4.0 * i + 3, (i * 37 % 100) / 100, 0.0) for i in range(100)]), SHOTS)
    got = M.summarize(d, "action", 60.0).collect()
    assert 30 < sum(r.duration for r in got) <= 60.001
    assert M.summarize(d, "action", None).count() >= len(got)


def test_event_chain_reaches_its_payoff(spark):
    rows = [(0, i + 1, 5.0 * i, 5.0 * i + 4, 0.95 if i == 5 else 0.2, 0.0, 0.5, {3: 0.96, 5: 0.99}.get(i, 0.2), None, 0.0, 0.0, 0.0) for i in range(8)]
    d = M.prepared(spark.createDataFrame(rows, SHOTS), "importance_score")
    got = M.event_chains(d.where("scene_id = 4"), d, 180.0).collect()
    assert [r.scene_id for r in got] == [4] and got[0].chain_end >= 29.0 and got[0].chain_start == 10.0
    assert M.event_chains(d.where("scene_id = 4"), d, 60.0).count() == 0


def test_conflict_bridge_is_the_first_of_a_sustained_run(spark):
    rows = [(0, 1, 0.0, 740.0, 0.9, 0.0, 0.5, 0.1, None, 0.0, 0.0, 0.0), (0, 2, 740.0, 750.0, 0.9, 0.0, 0.5, 0.9, None, 0.0, 0.0, 0.0), *[(0, 3 + k, 760.0 + 8 * k, 768.0 + 8 * k, 0.6, 0.0, 0.5, 0.85, None, 0.0, 0.0, 0.0) for k in range(5)], (0, 9, 870.0, 880.0, 0.1, 0.0, 0.5, 0.1, None, 0.0, 0.0, 0.0), (0, 10, 880.0, 1000.0, 0.1, 0.0, 0.1, 0.1, None, 0.0, 0.0, 0.0)]
    d = M.prepared(spark.createDataFrame(rows, SHOTS), "importance_score")
    assert [r.scene_id for r in M.conflict_bridges(d.where("scene_id in (2, 9)"), d).collect()] == [3]
    assert M.conflict_bridges(d.where("scene_id in (2, 9)"), d.where("scene_id not in (3, 4, 5)")).count() == 0


def test_acts_keep_turning_points(spark):
    rows = []
    for i in range(60):
        text = {12: "the threat is near, we must attack", 50: "a final victory, they win"}.get(i, "")
        rows.append((0, i + 1, 10.0 * i, 10.0 * i + 8, 0.3, 0.3, 0.3 + 0.01 * (i % 7), 0.9 if text else 0.1, str(i // 3), 0.0, 0.0, 0.0, text))
    d = spark.createDataFrame(rows, SHOTS + ", transcript_text string")
    p = M.plan(d, "importance", 120.0, distribution="acts")
    must = p.where("mandatory").collect()
    assert must and all(r.status == "chosen" for r in must) and [any(r.start_seconds <= at < r.end_seconds for r in must) for at in (120.0, 500.0)] == [True, True]
    assert sum(r.duration for r in M.summarize(d, "importance", 120.0, distribution="acts").collect()) <= 120.0 * 1.2
    short = M.report(M.plan(d, "importance", 15.0, distribution="acts")).first()
    assert short.problem == "mandatory segments exceed the target" and short.chosen == 0


def test_mandatory_rows_of_the_guard(spark):
    segs = spark.createDataFrame([(0, 0.0, 16.0, 0.9, 100.0, False), (0, 40.0, 48.0, 0.1, 100.0, True), (0, 80.0, 90.0, 0.7, 100.0, False)], "video_id long, start_seconds double, end_seconds double, segment_score double, video_duration double, mandatory boolean")
    none = spark.createDataFrame([], TURNS)
    assert sorted(r.start_seconds for r in G.speech_safe(segs, none, 20.0).collect()) == [40.0, 80.0]
    assert G.speech_safe(segs, none, 6.0).count() == 0


def plain_pool(rows, local, required, limit):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    at, out, source = {r[0]: k for k, r in enumerate(rows)}, [], {}

    def add(ids, name):
        for i in ids:
            if i not in source and len(out) < limit:
                out.append(i)
                source[i] = name

    share = lambda x: max(2, round(limit * x))
    room = lambda x: max(0, min(limit, len(out) + share(x)) - len(out))
    add(required, "required")
    add(local[: share(0.35)], "local")
    begin, span, bins = rows[0][1], max(r[2] for r in rows) - rows[0][1], 8 if limit <= 32 else 12 if limit <= 48 else 16
    cells = {}
    for r in rows:
        cells.setdefault(min(int(bins * ((r[1] + r[2]) / 2 - begin) / span), bins - 1), []).append(r)
    add([max(cells[b], key=lambda r: (r[3], -r[0]))[0] for b in sorted(cells)], "time")
    add([max(cells[b], key=lambda r: (r[4], r[3], -r[0]))[0] for b in sorted(cells)][: room(0.15)], "event")
    add([rows[k][0] for i in local for k in (at[i] - 1, at[i] + 1) if 0 <= k < len(rows)][: room(0.10)], "neighbour")
    ranked, first = sorted(rows, key=lambda r: (-r[3], r[0])), {}
    for r in ranked:
        first.setdefault(r[5], r[0])
    add(list(first.values())[: room(0.20)], "story")
    add([r[0] for r in ranked], "score")
    return [(i, source[i], k + 1) for k, i in enumerate(out)]


@pytest.mark.parametrize("limit", [16, 32, 48, 72])
def test_candidate_pool_equals_the_plain_version(spark, limit):
    rnd, rows, local, required, want = random.Random(limit), [], [], [], {}
    for v in range(12):
        own = [(i, 5.0 * i, 5.0 * i + rnd.randrange(1, 5), rnd.randrange(50) / 50, rnd.randrange(20) / 20, i // 4) for i in range(rnd.choice([3, 20, 120]))]
        ids = [r[0] for r in own]
        loc, req = rnd.sample(ids, min(len(ids), rnd.choice([0, 2, 40]))), sorted(rnd.sample(ids, min(len(ids), rnd.choice([0, 1, 15, 80]))))
        rows += [(v, *r) for r in own]
        local += [(v, i, n + 1) for n, i in enumerate(loc)]
        required += [(v, i) for i in req]
        want[v] = plain_pool(own, loc, req, limit)
    got = K.candidate_pool(spark.createDataFrame(rows, "video_id long, scene_id long, start_seconds double, end_seconds double, score double, event double, story long"), spark.createDataFrame(local, "video_id long, scene_id long, n long"), spark.createDataFrame(required, "video_id long, scene_id long"), "score", "event", "story", limit)
    by = {v: [] for v in want}
    for r in got.collect():
        by[r.video_id].append((r.scene_id, r.source, r.place))
    for v in want:
        assert sorted(by[v], key=lambda r: r[2]) == want[v]


def test_a_group_over_the_bound_is_an_error(spark):
    from sceneql.operators.groups import by_arrays

    d = spark.range(10).selectExpr("id % 2 as k", "id as x")
    f = lambda g: [(int(g["d"]["x"].sum()),)]
    assert {r.k: r.s for r in by_arrays({"d": (d, ["x"])}, ["k"], f, "s long").collect()} == {0: 20, 1: 25}
    with pytest.raises(Exception, match="more than 4 rows"):
        by_arrays({"d": (d, ["x"])}, ["k"], f, "s long", 4).collect()
