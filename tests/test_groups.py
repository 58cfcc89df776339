"""Groups reach their functions whole, and in Python only a bounded number of rows at once."""

import numpy as np

from sceneql.operators import groups as G


def test_pieces_are_bounded():
    assert list(G.pieces(np.array([3, 3, 9, 1, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(G.pieces(np.array([], dtype=int), 6)) == []


def test_many_groups_of_one_batch(spark):
    n = 3 * G.AT_ONCE
    d = spark.range(n).selectExpr("id % 5000 as k", "id", "cast(null as string) as s").coalesce(1)
    got = G.by_group(d, ["k"], ["id"], ["s"], lambda rows: [{"n": len(rows), "first": rows[0]["id"], "s": rows[-1]["s"]}], "n int, first long, s string")
    assert {(r.k, r.n, r["first"], r.s) for r in got.collect()} == {(k, n // 5000, k, None) for k in range(5000)}
