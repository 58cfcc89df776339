"""Rows at equal times meet their intervals once, and get what each of them would alone."""

import random

from sceneql.operators import joins as J


def test_equal_intervals_are_joined_once(spark):
    rng = random.Random(5)
    a = [(0, i, s, s + rng.randint(1, 3)) for i, s in enumerate(rng.randint(0, 6) for _ in range(300))] + [(0, 7, 3, 5), (0, 300, 90, 91)]
    b = [(0, rng.choice("xyz"), s, s + rng.randint(1, 4)) for s in (rng.randint(0, 8) for _ in range(200))]
    left, right = spark.createDataFrame(a, "v int, i int, s long, e long"), spark.createDataFrame(b, "v int, w string, x long, y long")
    assert J._shapes(left, ["v"], "i", "s", "e")[1].count() < 40
    sums, first, names = {}, {}, {}
    for _, i, s, e in a:
        for _, w, x, y in b:
            if min(e, y) > max(s, x):
                sums[i, w] = sums.get((i, w), 0) + min(e, y) - max(s, x)
                first[i, w] = min(first.get((i, w), (99, 99)), (x, y))
                names.setdefault(i, set()).add(w)
    want = {i: min((-sums[k], first[k], k[1]) for k in sums if k[0] == i) for i in names}
    got = J.largest_overlap(left, right, ["v"], "i", "s", "e", "x", "y", "w", 8.0).collect()
    assert sorted((r.i, r.seconds, r.w) for r in got) == sorted((i, -n, w) for i, (n, _, w) in want.items())
    got = J.met(left, right, ["v"], "i", "s", "e", "x", "y", "w", 8.0, "names").collect()
    assert sorted((r.i, r.names) for r in got) == sorted((i, sorted(w)) for i, w in names.items())


def test_equal_points_find_the_narrowest_container_once(spark):
    p = spark.createDataFrame([(0, i, 2.5) for i in range(50)] + [(0, 50, 9.0), (0, 3, 2.0)], "v int, i int, at double")
    c = spark.createDataFrame([(0, "b", 2, 4), (0, "a", 2, 4), (0, "c", 1, 4), (0, None, 0, 2)] * 3, "v int, w string, x long, y long")
    got = {r.i: r.w for r in J.smallest_container(p, c, ["v"], "i", "at", "x", "y", "w", 8.0).collect()}
    assert got == {i: None if i == 3 else "a" for i in range(50)}
