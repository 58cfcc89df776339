"""Many groups at once give what one group at a time gives."""

import random

import numpy as np
import pyarrow as pa

from sceneql.operators import evaluate as E
from sceneql.operators import intervals as I
from sceneql.operators import selection as S
from sceneql.operators.speech import Said
from sceneql.plans import adapters as A


def _table(seed: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, random.Random]:
    rng = random.Random(seed)
    first = np.append(0, np.cumsum([rng.choice([0, 1, 2, 4, 7, 7, 30]) for _ in range(groups)]))
    values = np.array([rng.choice([0.0, -0.5, 1e-6, 0.25, 0.5, 1.0, rng.random(), 1e7]) for _ in range(first[-1])])
    costs = np.array([rng.choice([1, 2, 3, 5, 8, 60]) for _ in range(first[-1])], dtype=np.int64)
    return values, costs, first, rng


def test_knapsacks_of_many_groups(monkeypatch):
    for seed in range(30):
        values, costs, first, rng = _table(seed, 60)
        room = np.array([rng.choice([0, 1, 7, 20, 41, 400]) for _ in first[1:]])
        how = {"margin": rng.choice([0.0, 1e-8, 1e-6]), "more_items": rng.random() < 0.5, "full_end": rng.random() < 0.5}
        monkeypatch.setattr(S, "CELLS", rng.choice([200, 5000, 1 << 22]))
        want = [int(a) + k for a, z, r in zip(first[:-1], first[1:], room) for k in S.knapsack(values[a:z].tolist(), costs[a:z].tolist(), int(r), **how)]
        assert np.flatnonzero(S.knapsacks(values, costs, first, room, **how)).tolist() == want


def test_protected_first_of_many_groups():
    for seed in range(30):
        scores, costs, first, rng = _table(seed, 60)
        length = costs * 0.5 + np.array([rng.choice([0.0, 0.2]) for _ in costs])
        flags = [np.array([rng.random() < 0.4 for _ in costs], dtype=bool) for _ in range(3)]
        want = [int(a) + k for a, z in zip(first[:-1], first[1:]) for k in S.protected_first(scores[a:z], length[a:z], 12.0, *(x[a:z] for x in flags))]
        assert np.flatnonzero(S.protected_first_of(scores, length, first, 12.0, *flags)).tolist() == want


def test_rows_keep_their_types_and_keys(spark):
    d = spark.createDataFrame([("a", 1, 2.0, 3.0, 1), ("a", 2, 9.0, 4.0, 2), (None, 1, 5.0, 2.0, 3), ("b", 1, 1.0, 99.0, 4)], "k string, o int, value double, cost double, x long")
    got = S.knapsack_rows(d, ["k"], ["o"], "value", "cost", 5.0)
    assert got.dtypes == [("k", "string"), ("o", "int"), ("value", "double"), ("cost", "double")]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["('a', 2, 9.0, 4.0)", "(None, 1, 5.0, 2.0)"]


def test_budget_select_takes_many_keys_a_partition(spark, monkeypatch):
    from sceneql.operators import tables as T

    T.register(spark)
    rng = random.Random(3)
    rows = [(k if k else None, o, rng.choice([0.0, 1.0, 2.0, rng.random()]), rng.choice([1.0, 3.0, 8.2])) for k in range(300) for o in range(rng.choice([1, 3, 9, 200 if k == 7 else 5]))]
    spark.createDataFrame(rows, "k long, ord long, value double, cost double").createOrReplaceTempView("many_keys")
    got = [sorted(map(str, map(tuple, spark.sql(f"SELECT k, ord, value, cost FROM budget_select(TABLE(many_keys) PARTITION BY ({p}) ORDER BY ({o}), 10.0D, 0.5D)").collect()))) for p, o in (("k", "ord"), ("pmod(hash(k), 3)", "k, ord"))]
    want = []
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        pick = S.knapsack([max(r[2], 1e-6) for r in own], [S.ticks(r[3], 0.5, "round") for r in own], 20, more_items=True)
        want += [str(own[i]) for i in pick]
    assert got[0] == got[1] == sorted(want)

    # keys that go on in the next batch
    for cut in (1, 7, 1000):
        f = T.BudgetSelect.func()
        monkeypatch.setattr(T, "AT_ONCE", 50)
        ordered = pa.RecordBatch.from_pylist([dict(zip("abcd", r)) for r in rows])
        out = [t for at in range(0, len(rows), cut) for t in f.eval(ordered.slice(at, cut), pa.array([10.0]), pa.array([0.5]))] + list(f.terminate())
        assert sorted(str(tuple(r.values())) for t in out for r in t.to_pylist()) == sorted(want)


def test_spans_are_the_masks(spark):
    rng = random.Random(5)
    frames, segments = [], []
    for video in range(12):
        at = 0
        for _ in range(rng.choice([1, 2, 9, 30])):
            n = rng.choice([1, 2, 3, 7])
            scores = [rng.choice([0.0, 0.0, 0.1, rng.random(), 5.0]) for _ in range(4)]
            segments.append((video, at, at + n - 1, *scores))
            frames += [(video, r, f, x) for f in range(at, at + n) for r, x in enumerate(scores)]
            at += n
    s = spark.createDataFrame(segments, "video_id long, first long, last long, a double, b double, c double, d double")
    f = spark.createDataFrame(frames, "video_id long, rater int, frame long, score double")
    videos = s.selectExpr("video_id", "'x' as category").distinct()
    spans, masks = E.segment_spans(s, ["a", "b", "c", "d"]), E.segment_masks(f, s.select("video_id", "first", "last"))
    each = spans.selectExpr("video_id", "rater", "explode(sequence(first, last)) as frame")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, masks.collect()))
    got = E.span_scores(spans.where("rater = 0 and video_id < 11"), spans.where("rater > 0").withColumnRenamed("rater", "user"), videos, 4, 3.0)
    want = E.user_scores(masks.where("rater = 0 and video_id < 11"), masks.where("rater > 0").withColumnRenamed("rater", "user"), videos, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_safe_edges_one_and_many(spark):
    rng = random.Random(8)
    rows, turns = [], []
    for video in [None, *range(20)]:
        for _ in range(rng.choice([0, 1, 6])):
            a = rng.choice([0.0, 1.0, round(rng.random() * 60, 4)])
            turns.append((video, a, a + rng.choice([0.1, 2.0, 9.5])))
        for i in range(rng.choice([0, 1, 5])):
            a = round(rng.random() * 60, 4)
            rows.append((video, a, a + rng.choice([0.5, 8.0]), f"n{i}" if i else None, 58.25))
    d = spark.createDataFrame(rows, "video_id long, a double, z double, name string, last double").repartition(3)
    t = spark.createDataFrame(turns, "video_id long, s double, e double")
    got = I.safe_bounds(d, t, ["video_id"], "a", "z", "s", "e", 0.22, "last")
    assert got.dtypes == d.dtypes
    want = []
    for v, a, z, name, last in rows:
        own = np.array([x[1:] for x in turns if x[0] == v], dtype=float).reshape(-1, 2)
        b, y = I.outside_turns(np.array([a]), np.array([z]), own, 0.22, last)
        want.append(str((v, float(b[0]), float(y[0]), name, last)))
        assert not len(own) or Said.of(turns=own.tolist(), duration=last).safe(a, z) == (float(b[0]), float(y[0]))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    # no group of pandas rows: the plan has no cogroup
    assert "CoGroup" not in got._jdf.queryExecution().toString()


def test_words_have_partitions_by_the_length_of_their_texts(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user", f"one two three {c}") for c in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    want = sorted(map(str, A.words(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(A, "TEXT", 50)
    got = A.words(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 20 and sorted(map(str, got.collect())) == want
